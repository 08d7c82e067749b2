"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores. Every query is run
in full and its rows are written to the ``noop`` sink, so no column is pruned away. One
untimed run of the flagship starts the JVM's compiler before the clock does. Every query runs
BENCH_REPEATS times (2) and its fastest run counts, so the first ones in the list do not pay for the warm-up.

``large`` repeats preparation (J2b) and evaluation (A17, A19 and what they need) on images of about one
megapixel, the test images enlarged, and gives seconds per megapixel.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from inkloom.operators import labels, quality
from inkloom.plans import catalog, derived
from inkloom.plans.spread import store
from inkloom.session import local_session

HEADLINE = [
    "flagship_main_inks", "A1_estimate_background", "A3_color_clusters", "A11_palette_auto",
    "A12_palette_exact", "A14_raw_color_histogram", "J1_assign_nearest", "J2b_prepare_corpus",
    "J3_contingency", "A17_sample_iou", "A18_edge_map", "A19_chamfer", "R0_binary_opening",
    "R1_connected_components", "A27_region_stats", "A25_ring_metrics", "A26_fit_circle",
    "G1_path_vertices", "G4_simplify_ring", "P13_validate_request", "A23_report_aggregates",
    "W3_keep_newest_runs",
]


LARGE_IMAGES, ENLARGED = 4, 42


def large(spark, sf_dir: str) -> dict:
    """Times on ``LARGE_IMAGES`` images of every kind, each side ``ENLARGED`` times as long."""
    px = derived.pixels(spark, sf_dir).filter(F.col("image_id") <= LARGE_IMAGES)
    palettes = store(derived.band_palettes(px))

    def enlarged(pixels):
        k = F.lit(ENLARGED)
        steps = F.sequence(F.lit(0), k - 1)
        return store(
            pixels.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(
                *(c for c in pixels.columns if c not in ("x", "y", "w", "h")),
                *((F.col(c) * k + F.col(f"d{c}")).alias(c) for c in "xy"), *((F.col(c) * k).alias(c) for c in "wh")))

    source, traced = enlarged(px), enlarged(derived.traced(px))
    sizes = palettes.select("image_id", "palette", "bg_r", "bg_g", "bg_b", *(
        (F.col(c) * ENLARGED).alias(c) for c in "wh"))
    mpx = source.count() / 1e6

    def timed(df) -> float:
        start = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    out = {"J2b": timed(lambda: labels.prepare_corpus(source, 4)),
           "evaluate": timed(lambda: quality.evaluate(source, traced, sizes))}
    return {"images": LARGE_IMAGES, "mpx": round(mpx, 2), **out, "s_per_mpx": round(sum(out.values()) / mpx, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    wanted = sys.argv[1:] or HEADLINE
    if wanted == ["all"]:
        wanted = list(queries)

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("flagship_main_inks")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    times = {name: min(run(name) for _ in range(repeats)) for name in wanted}
    images = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "large": large(spark, sf_dir), "images": images, "cores": int(os.environ.get("BENCH_CPUS", "8")),
    }))


if __name__ == "__main__":
    main()
