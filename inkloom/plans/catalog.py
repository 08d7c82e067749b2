"""Every operator as a query over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import colour as C
from inkloom.functions import requests as Rq
from inkloom.functions import svg as S
from inkloom.functions.colour import hex_palette
from inkloom.operators import evaluation as E
from inkloom.operators import geometry as G
from inkloom.operators import intake as I
from inkloom.operators import labels as L
from inkloom.operators import palette as P
from inkloom.operators import quality as Q
from inkloom.operators import regions as R
from inkloom.operators import reports as Rp
from inkloom.plans import derived
from inkloom.plans.spread import attach_image_facts, checkpoint, shared_table_path, store, tasks_for
from inkloom.sources import files as Fs
from inkloom.sources import images as Im
from inkloom.sources import sinks as Sk

def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def at() -> list[Column]:
    return long("image_id", "x", "y")


# --- colours and palettes -----------------------------------------------------------------


def _per_pixel(name: str, value):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return derived.pixels(spark, sf).select(*at(), value(P.px()).alias(name))

    return run


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The pixel table, stored once for queries that read it several times."""
    return store(derived.pixels(spark, sf))


def _with_bg(spark: SparkSession, sf: str) -> DataFrame:
    px = _stored(spark, sf)
    return attach_image_facts(px, P.estimate_background(px))


def _counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Exact colour counts of the full-size images and their backgrounds."""
    px = _stored(spark, sf)
    return P.color_counts(px), P.estimate_background(px)


def _ink(spark: SparkSession, sf: str) -> DataFrame:
    working = P.working_counts(derived.pixels(spark, sf))
    return P.ink_counts(working, P.background_from_counts(working))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return P.color_clusters(_ink(spark, sf))


def _swatches(column: Column, *fields: str) -> list[Column]:
    listed = F.transform(column, lambda s, i: F.struct(
        (i + 1).cast("bigint").alias("pos"), *(s[f].alias(f) for f in fields)))
    return [F.col("image_id"), F.inline(listed)]


def _swatch_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return P.cluster_arrays(_clusters(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Main inks of every image with their share of the image's main-ink pixels."""
    heavy = P.mass_filter(_clusters(spark, sf))
    total = heavy.groupBy("image_id").agg(F.sum("mass").alias("total"))
    return (
        P.top_k_by_mass(heavy, 8).join(total, "image_id")
        .select("image_id", "r", "g", "b", "mass", *long("rank"),
                six(F.col("mass") / F.col("total")).alias("share"))
    )


def palette_queries() -> dict:
    return {
        "flagship_main_inks": flagship,
        "P1_rgb_dist2": lambda s, d: _with_bg(s, d).select(
            *at(), C.rgb_dist2(P.px(), P.bg()).alias("d2")),
        "P2_is_near_white": _per_pixel("near_white", C.is_near_white),
        "P3_lightness": _per_pixel("lightness", lambda c: six(C.lightness(c))),
        "P4_saturation": _per_pixel("saturation", lambda c: six(C.saturation(c))),
        "P5_hue_deg": _per_pixel("hue", lambda c: six(C.hue_deg(c))),
        "P6_hsl_distance": lambda s, d: _with_bg(s, d).select(
            *at(), six(C.hsl_distance(P.px(), P.bg())).alias("hsl")),
        "P7_bucket4": lambda s, d: derived.pixels(s, d).groupBy(
            "image_id", *(c.alias(n) for c, n in zip(C.bucket4(P.px()), ("br", "bg", "bb")))
        ).agg(F.count(F.lit(1)).alias("n")),
        "P8_ink_mask": lambda s, d: _with_bg(s, d).filter(
            C.rgb_dist2(P.px(), P.bg()) > C.BG_DIST2).select(*at(), "r", "g", "b"),
        "P9_hex_color": lambda s, d: P.estimate_background(derived.pixels(s, d)).select(
            "image_id", C.hex_color(P.bg()).alias("bg_hex")),
        "P21_colour_families": lambda s, d: P.colour_families(*_counts(s, d)),
        "S4_has_alpha": lambda s, d: derived.pixels(s, d).groupBy("image_id").agg(
            (F.min("a") < 255).alias("has_alpha")),
        "A1_estimate_background": lambda s, d: P.estimate_background(
            derived.pixels(s, d)).drop("w", "h"),
        "A2_box_downsample": lambda s, d: P.box_downsample(derived.pixels(s, d), side=12),
        "A3_color_clusters": _clusters,
        "A4_mass_filter": lambda s, d: P.mass_filter(_clusters(s, d)).drop("br", "bg", "bb"),
        "A5_merge_by_hsl": lambda s, d: P.cluster_arrays(P.mass_filter(_clusters(s, d))).select(
            *_swatches(P.merge_by_hsl(F.col("swatches")), "r", "g", "b", "mass")),
        "A6_mass_aware_exact": lambda s, d: P.cluster_arrays(_clusters(s, d)).select(
            *_swatches(P.select_exact(F.col("swatches"), 2), "r", "g", "b", "mass")),
        "A7_mass_aware_up_to": lambda s, d: P.cluster_arrays(_clusters(s, d)).select(
            *_swatches(P.select_up_to(F.col("swatches"), 4), "r", "g", "b")),
        "A8_gradient_crush": lambda s, d: _swatch_arrays(s, d).select(
            *_swatches(P.gradient_crush(F.col("swatches")), "r", "g", "b", "mass")),
        "A9_collapse_gradient_ramps": lambda s, d: _swatch_arrays(s, d).select(
            *_swatches(P.collapse_gradient_ramps(F.col("swatches"), 2), "r", "g", "b", "mass")),
        "A10_bimodal_guard": lambda s, d: P.lightness_peaks(_ink(s, d)),
        "A11_palette_auto": lambda s, d: P.palette_rows(P.palette_auto(derived.pixels(s, d))),
        "A12_palette_exact": lambda s, d: P.palette_rows(P.palette_exact(derived.pixels(s, d), 2)),
        "A29_extract_colors": lambda s, d: P.extract_colors(derived.pixels(s, d)),
        "A13_unique_color_count": lambda s, d: P.unique_color_count(
            P.color_counts(derived.pixels(s, d))),
        "A13_unique_color_sketch": _sketched,
        "A14_raw_color_histogram": lambda s, d: P.raw_color_histogram(
            P.color_counts(derived.pixels(s, d))).select(
            "image_id", "rank", "r", "g", "b", "n", six("share").alias("share"),
            six("lightness").alias("lightness"), six("saturation").alias("saturation")),
        "A15_white_fraction": lambda s, d: P.white_fraction(derived.pixels(s, d)).select(
            "image_id", six("white_fraction").alias("white_fraction")),
        "A28_palette_trace": lambda s, d: P.palette_trace(*_counts(s, d)).select(
            "image_id", "rank", "r", "g", "b", "mass", six("share").alias("share"), "class",
            "family", six("ink_share").alias("ink_share"), six("bg_share").alias("bg_share")),
        "W1_top_k_by_mass": lambda s, d: P.top_k_by_mass(_clusters(s, d), 8).select(
            "image_id", *long("rank"), "r", "g", "b", "mass"),
        "W9_bg_dedupe": lambda s, d: P.bg_dedupe(*_counts(s, d)).drop("first_ord"),
    }


# --- labels and quality -------------------------------------------------------------------

# Two traces of the corpus: a good one, and one that is off by five columns.
VARIANTS = {"near": (11, 1), "late": (1, 5)}


def _tasks(px: DataFrame) -> int:
    """Tasks for operators on the pixels of a stored table, whose number is in its files."""
    return tasks_for(px.sparkSession, px.count())


def _labels(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Labels of the images, and the tasks for them."""
    px = _stored(spark, sf)
    tasks = _tasks(px)
    return L.assign_nearest(px, derived.band_palettes(px), tasks=tasks), tasks


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    px = _stored(spark, sf)
    palettes = checkpoint(derived.band_palettes(px))
    return L.assign_nearest(px, palettes), palettes


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Paired labels of the source and the traced images, the palettes used, and the tasks for the pairs."""
    px = _stored(spark, sf)
    palettes = checkpoint(derived.band_palettes(px))
    tasks = _tasks(px)
    return Q.label_pairs(px, derived.traced(px), palettes, tasks=tasks), palettes, tasks


def _table(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pairs, palettes, _ = _pairs(spark, sf)
    return checkpoint(Q.contingency(pairs)), palettes


def _masks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    table, palettes = _table(spark, sf)
    return table, Q.mask_iou(table, Q.pair_palettes(table, palettes))


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _, tasks = _pairs(spark, sf)
    edges = store(Q.edge_pair(pairs, tasks=tasks))
    near = Q.nearest_edge(edges.filter("out_edge"), edges.filter("ref_edge"), tasks=tasks)
    return near.select("image_id", "x", "y", "d2")


def _chamfer(spark: SparkSession, sf: str) -> DataFrame:
    pairs, palettes, tasks = _pairs(spark, sf)
    return Q.chamfer(store(Q.edge_pair(pairs, tasks=tasks)), palettes, tasks=tasks)


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    labels, tasks = _labels(spark, sf)
    return Q.neighbour_join(labels, ["slot"], tasks=tasks)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    labels, tasks = _labels(spark, sf)
    return Q.edge_map(labels, tasks=tasks)


def _xor(spark: SparkSession, sf: str) -> DataFrame:
    px = _stored(spark, sf)
    palettes = checkpoint(derived.band_palettes(px))
    pairs = store(Q.label_pairs(px, derived.traced(px, *VARIANTS["late"]), palettes))
    table = checkpoint(Q.contingency(pairs))
    masks = Q.mask_iou(table, Q.pair_palettes(table, palettes))
    return Q.xor_mask(pairs, masks).select(*at(), "slot")


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    px = _stored(spark, sf)
    variants = {name: derived.traced(px, *how) for name, how in VARIANTS.items()}
    return Q.evaluate_corpus(px, variants, derived.band_palettes(px), _nodes(spark, sf)).select(
        "image_id", "variant", *long("w", "h", "n_colors", "nodes"), "iou_mean", "iou_worst",
        "iou_aw", "iou_bg", "iou_unmatched", "chamfer", "degenerate")


UPSCALES = {"near": "off", "late": "2x"}


def _records(spark: SparkSession, sf: str) -> DataFrame:
    px = _stored(spark, sf)
    return E.evaluation_records(
        px, derived.rendered(px, VARIANTS), derived.band_palettes(px),
        derived.traces(spark, sf, px, UPSCALES), list(VARIANTS))


def _flat_records(spark: SparkSession, sf: str) -> DataFrame:
    masks = F.transform("per_mask", lambda m: F.format_string(
        "%s %s %.4f %.2f %d", m["color"], F.when(m["is_bg"], "bg").otherwise("ink"), m["iou"], m["area_pct"],
        m["area_px"]))
    return _records(spark, sf).withColumn("palette", hex_palette(F.col("palette"))).withColumn(
        "per_mask", F.array_join(masks, "; "))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """The reports of both variants, each from its records."""
    records = store(_records(spark, sf))
    return Rp.union_samples(*(
        Rp.report_lines(records.filter(F.col("variant") == v), f"v4-{v}", "2026-07-21").select(
            F.lit(v).alias("variant"), *long("section", "no"), "line") for v in VARIANTS))


def _matrix_report(spark: SparkSession, sf: str) -> DataFrame:
    return Rp.matrix_lines(store(_records(spark, sf)), list(VARIANTS), "2026-07-21").select(
        *long("section", "no"), "sample", "line")


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Sketched colour counts beside the exact ones, from sketches per strip."""
    px = _stored(spark, sf)
    exact = P.unique_color_count(P.color_counts(px))
    estimate = P.unique_color_estimate(P.color_sketches(px, 96)).withColumnRenamed("n_colors", "estimate")
    off = F.abs(F.col("estimate") - F.col("n_colors")) / F.col("n_colors")
    return exact.join(estimate, "image_id").select(
        "image_id", "n_colors", (off <= 4 * P.SKETCH_ERROR).alias("within"))


def _remapped(spark: SparkSession, sf: str) -> DataFrame:
    px = _stored(spark, sf)
    return L.remap_to_palette(px, derived.band_palettes(px), keep_alpha=True)


def _present(spark: SparkSession, sf: str) -> DataFrame:
    px = _stored(spark, sf)
    palettes = checkpoint(derived.band_palettes(px))
    return Q.present_colors(L.assign_nearest(px, palettes), palettes)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return derived.pixels(spark, sf).groupBy("image_id").agg(
        F.count_if(F.col("pk") % 7 == 0).alias("nodes"))


def quality_queries() -> dict:
    return {
        "J1_assign_nearest": lambda s, d: _labels(s, d)[0].select(*at(), "slot", "r", "g", "b"),
        "J2_remap_to_palette": lambda s, d: _remapped(s, d).select(*at(), "slot", "r", "g", "b"),
        "J2b_prepare_corpus": lambda s, d: L.prepare_corpus(_stored(s, d), 4).select(
            *at(), "slot", "r", "g", "b", "a"),
        "P20_alpha_rule": lambda s, d: _remapped(s, d).select(*at(), "a"),
        "J3_contingency": lambda s, d: Q.contingency(_pairs(s, d)[0]),
        "J4_pair_palettes": lambda s, d: Q.pair_palettes(*_table(s, d)),
        "J5_nearest_edge": _nearest,
        "J6_neighbour_join": lambda s, d: _neighbours(s, d).select(
            *at(), "slot", "slot_left", "slot_right", "slot_up", "slot_down"),
        "J8_present_colors": _present,
        "A16_mask_iou": lambda s, d: _masks(s, d)[1].drop("iou_raw"),
        "A17_sample_iou": lambda s, d: Q.sample_iou(*_masks(s, d)),
        "A18_edge_map": lambda s, d: _edges(s, d).select(*at()),
        "A19_chamfer": _chamfer,
        "A20_degenerate_flag": lambda s, d: Q.degenerate_flag(
            _table(s, d)[0], _nodes(s, d)),
        "A21_ink_coverage": lambda s, d: L.ink_coverage(derived.pixels(s, d)).select(
            "image_id", six("ink_coverage").alias("ink_coverage")),
        "A24_self_test": lambda s, d: Q.self_test(*_labelled(s, d)).select(
            "image_id", "n_edges", "iou_mean", "chamfer", "shift_iou",
            six("shift_chamfer").alias("shift_chamfer"), "passed"),
        "E1_evaluate_corpus": _evaluated,
        "E1_evaluation_records": _flat_records,
        "E1_report": _report,
        "E1_matrix_report": _matrix_report,
        "W6_xor_mask": _xor,
    }


# --- regions ------------------------------------------------------------------------------

# The images are 24 pixels wide, so the disk test runs with limits that fit them.
SMALL_DISKS = dict(min_area_frac=0.06, max_aspect=4.0, min_radius=2, min_ring=10,
                   max_radius_cv=0.5, min_disk_fill=0.5)


def _mask(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    labels, tasks = _labels(spark, sf)
    return R.with_ink_code(labels), tasks


def _opened(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    mask, tasks = _mask(spark, sf)
    return R.binary_opening(mask, tasks=tasks), tasks


def _components(mask: DataFrame, tasks: int) -> DataFrame:
    return R.connected_components(mask, tasks=tasks)


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return _components(*_opened(spark, sf))


def _snapped(spark: SparkSession, sf: str, keep_alpha: bool = False) -> DataFrame:
    px = _stored(spark, sf)
    tasks = _tasks(px)
    labels = store(L.assign_nearest(px, derived.band_palettes(px), keep_alpha=keep_alpha, tasks=tasks))
    regions = _components(R.binary_opening(R.with_ink_code(labels), tasks=tasks), tasks)
    return R.snap_disks(labels, R.region_stats(regions, **SMALL_DISKS), tasks)


def region_queries() -> dict:
    return {
        "R0_binary_opening": lambda s, d: _opened(s, d)[0].select(*at(), "c"),
        "R1_connected_components": lambda s, d: R.region_pixels(
            _components(*_mask(s, d))).select(*at(), "c", "region"),
        "A27_region_stats": lambda s, d: R.region_stats(_regions(s, d), **SMALL_DISKS).select(
            "image_id", "c", "region", "area", "bx0", "bx1", "by0", "by1",
            six("aspect").alias("aspect"), six("radius").alias("radius"), "ring_px",
            six("ring_cv").alias("ring_cv"), six("fill").alias("fill"), "is_disk"),
        "R2_snap_disks": lambda s, d: _snapped(s, d).select(*at(), "r", "g", "b"),
        "R2_snap_disks_alpha": lambda s, d: _snapped(s, d, keep_alpha=True).select(
            *at(), "r", "g", "b", "a"),
    }


# --- outlines and SVG text ----------------------------------------------------------------


def _outlines(spark: SparkSession, sf: str) -> DataFrame:
    return derived.vertices(spark, sf).select(
        "path_id", F.lit(0).cast("bigint").alias("ring"), F.col("seq").cast("bigint").alias("seq"),
        "x", "y")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.svg_docs(derived.vertices(spark, sf))


def _mixed_docs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.mixed_docs(derived.vertices(spark, sf))


def _requested(spark: SparkSession, sf: str) -> DataFrame:
    """Palettes as accepted requests ask for them; a request's number is its image's."""
    checked = I.validate_requests(derived.requests(spark, sf)).filter("reject_code IS NULL")
    settings = checked.select(F.col("req_id").alias("image_id"), "n", "mode")
    return P.palette_rows(P.palette_by_settings(_stored(spark, sf), settings)).select(
        "image_id", "slot", "r", "g", "b")


def _two_path_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of two paths; the second has the outline and a square as its rings, and an empty
    path stands between them."""
    outline = F.get(S.svg_d_extract(F.col("svg")), F.lit(0))
    square = "M 0.00 0.00 L 9.00 0.00 L 9.00 9.00 L 0.00 9.00 Z"
    more = F.concat(F.lit(' <path d=""/> <path d="'), outline, F.lit(f' {square}"/></svg>'))
    return _docs(spark, sf).select("path_id", F.replace("svg", F.lit("</svg>"), more).alias("svg"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(six(c).alias(c) if c in names else F.col(c) for c in df.columns))


def _blemished(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with zero-length paths added to every third one, and none in every fifth."""
    zero = ' <path d="M 0.00 0.00 L 0.00 0.00 Z"/>'
    key = F.col("path_id")
    return _docs(spark, sf).select("path_id", F.when(key % 5 == 0, "<svg></svg>").when(
        key % 3 == 0, F.replace("svg", F.lit("</svg>"), F.repeat(F.lit(zero), 3))
    ).otherwise(F.col("svg")).alias("svg"))


def outline_queries() -> dict:
    return {
        "A25_ring_metrics": lambda s, d: _rounded(
            G.ring_metrics(_outlines(s, d)), "area", "perimeter", "circularity").drop("ring"),
        "A26_fit_circle": lambda s, d: _rounded(
            G.fit_circle(G.ring_body(_outlines(s, d))), "cx", "cy", "r").drop("ring"),
        "G1_path_vertices": lambda s, d: _rounded(
            G.path_vertices(_docs(s, d)), "x", "y").select(
            *long("path_id", "path_no", "ring", "seq"), "x", "y"),
        "G1_path_vertices_mixed": lambda s, d: _rounded(
            G.path_vertices(_mixed_docs(s, d)), "x", "y").select(
            *long("path_id", "path_no", "ring", "seq"), "x", "y"),
        "G2_collapse_collinear": lambda s, d: G.collapse_collinear(_outlines(s, d)).drop("ring"),
        "G3_simplify_polyline": lambda s, d: G.simplify_polyline(
            G.ring_body(_outlines(s, d))).drop("ring"),
        "G4_simplify_ring": lambda s, d: G.simplify_ring(_outlines(s, d)).drop("ring"),
        "G5_circle_candidates": lambda s, d: _rounded(
            G.circle_candidates(_outlines(s, d), 200.0 * 200.0), "area", "circularity", "cx",
            "cy", "r").drop("ring"),
        "G6_normalize_basic": lambda s, d: G.normalize_paths(_outlines(s, d), "basic"),
        "G6_normalize_strict": lambda s, d: G.normalize_paths(_outlines(s, d), "strict"),
        "G6_normalize_documents": lambda s, d: G.normalize_documents(_two_path_docs(s, d), "basic"),
        "P15_svg_d_extract": lambda s, d: _docs(s, d).select(
            "path_id", F.explode(S.svg_d_extract(F.col("svg"))).alias("d")),
        "P16_svg_node_count": lambda s, d: _docs(s, d).select(
            "path_id", S.svg_node_count(F.col("svg")).alias("nodes")),
        "P17_degenerate_path_share": lambda s, d: _blemished(s, d).select(
            "path_id", six(S.degenerate_path_share(F.col("svg"))).alias("share")),
        "P18_svg_fill_colors": lambda s, d: _blemished(s, d).select(
            "path_id", F.explode(S.svg_fill_colors(F.col("svg"))).alias("fill")),
        "P19_svg_rescale": lambda s, d: _docs(s, d).select("path_id", S.svg_rescale(
            F.col("svg"), (F.col("path_id") % 3 + 1) / F.lit(1.0), F.lit(100), F.lit(90)
        ).alias("svg")),
        "S8_read_svg_docs": lambda s, d: _blemished(s, d).unionByName(
            derived.table(s, d, "pages").select(
                (-F.col("page_id")).alias("path_id"), F.col("html").alias("svg"))
        ).select("path_id", S.looks_like_svg(F.col("svg")).alias("is_svg")),
    }


# --- requests, artifacts, run log, reports ------------------------------------------------


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Image sizes and upscale variants spread over the part table."""
    k = F.col("p_partkey")
    variants = F.array(*(F.lit(v) for v in ("off", "auto", "2x", "4x", "4x-smooth", "huge")))
    return derived.table(spark, sf, "part").select(
        k.alias("image_id"), (k % 4000 + 1).alias("w"), ((k * 37) % 5000 + 1).alias("h"),
        F.get(variants, (k % 6).cast("int")).alias("variant"),
    ).withColumn("scale", Rq.effective_scale(
        F.col("w"), F.col("h"), Rq.requested_scale(F.col("variant"))))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """File names and first bytes derived from events."""
    e = F.col("event_id")
    names = F.array(*(F.lit(v) for v in (
        "a/sample_", "sample_", "x.sample_", "scan.", "up.load/logo", ".hidden")))
    ends = F.array(*(F.lit(v) for v in (".jpg", ".png", ".JPEG", "", ".tar", ".webp", ".")))
    heads = F.array(*(F.lit(v) for v in (
        "FFD8FFE000104A464946000101", "89504E470D0A1A0A0000000D", "524946460000000057454250",
        "474946383961", "474946383761", "00FF", "52494646000000005741564500")))
    return derived.table(spark, sf, "events").select(
        e.alias("file_id"),
        F.concat(F.get(names, (e % 6).cast("int")), e.cast("string"),
                 F.get(ends, (e % 7).cast("int"))).alias("path"),
        F.unhex(F.get(heads, (F.floor(e / 3) % 7).cast("int"))).alias("content"))


# Folders of the files that are written for a query that reads nested ones.
FOLDERS = 1024
# Files that stand in the shared folder at once, give or take a few: each takes an inode and a block of its disk,
# however few its bytes, some 34 GB for these. Removing a file takes longer than writing it, so it is not fewer.
FILES = 1 << 23


def _written(rows: DataFrame, kind: str, folders: int = 0) -> str:
    """A new folder on the shared storage with a file per row of ``name, content``."""
    spark = rows.sparkSession
    folder = shared_table_path(spark, kind)
    if folders:  # many small files: their rows are few bytes, and few tasks would hold them
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    Fs.write_files(rows, folder, folders)
    return folder


def _image_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every image written as a bitmap, some of them torn, read back, decoded and taken apart."""
    torn = F.col("image_id") % 7 == 3
    rows = Fs.bitmaps(_stored(spark, sf)).select(
        F.format_string("image_%d.bmp", "image_id").alias("name"),
        F.when(torn, F.substring("content", 1, 30)).otherwise(F.col("content")).alias("content"))
    number = F.regexp_extract("path", r"image_(\d+)\.bmp$", 1).cast("bigint")
    files = store(Im.read_images(spark, _written(rows, "images")).withColumn("image_id", number))
    pixels = Im.explode_pixels(files).withColumn("reason", F.lit(None).cast("string"))
    bad = files.filter("reason IS NOT NULL").select("image_id", "reason")
    return pixels.select("image_id", "x", "y", "w", "h", "r", "g", "b", "reason").unionByName(
        bad, allowMissingColumns=True)


def _file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of name and content as real files; their heads read where the name is no help. The files are written
    and read in rounds, dealt by their number; a round's are removed before the next ones are written."""
    rows = _files(spark, sf).select(
        "file_id", F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit("-"),
                            F.regexp_replace("path", ".*/", "")).alias("name"), "content")
    rounds = max(1, -(-rows.count() // FILES))
    kinds, folder = [], None
    for k in range(rounds):
        if folder:
            Fs.remove_files(spark, folder, FOLDERS)
        some = rows.filter(F.pmod(F.xxhash64("file_id"), F.lit(rounds)) == k).select("name", "content")
        folder = _written(some, "kinds", FOLDERS)
        found = Im.read_file_kinds(spark, folder, nested=True)
        kinds.append(store(found.select(
            F.regexp_extract("path", r"/f(\d+)-[^/]*$", 1).cast("bigint").alias("file_id"), "length", "ext",
            F.col("head_bytes").cast("bigint").alias("head_bytes"))))
    return reduce(DataFrame.unionByName, kinds)


def _svg_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and web pages as files, read whole and told apart."""
    docs = _blemished(spark, sf).select(
        F.concat(F.lit("doc_"), F.col("path_id").cast("string"), F.lit(".svg")).alias("name"),
        F.col("svg").cast("binary").alias("content"))
    pages = derived.table(spark, sf, "pages").select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".svg")).alias("name"),
        F.col("html").cast("binary").alias("content"))
    good, bad = Im.read_svg_docs(spark, _written(docs.unionByName(pages), "documents", FOLDERS), nested=True)
    name = F.regexp_extract("path", r"([^/]*)\.svg$", 1).alias("name")
    return good.select(name, F.length("svg").cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("reason")
                       ).unionByName(bad.select(name, "reason"), allowMissingColumns=True)


def _source_vs_output(spark: SparkSession, sf: str) -> DataFrame:
    px = _stored(spark, sf)
    blank = px.withColumn("a", F.when(F.col("image_id") % 3 == 0, 0).otherwise(F.col("a")))
    return _rounded(I.source_vs_output(L.ink_coverage(px), L.ink_coverage(blank)),
                    "source_coverage", "output_coverage")


def _metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    metrics = derived.sample_metrics(spark, sf).drop("palette")
    return Sk.write_metrics(metrics, shared_table_path(spark, "metrics"))


def _run_log(spark: SparkSession, sf: str) -> DataFrame:
    records = I.run_records(derived.finished_runs(spark, sf))
    return Sk.append_runs(records, shared_table_path(spark, "runlog"))


def intake_queries() -> dict:
    averages = ("iou_mean_avg", "iou_aw_avg", "iou_bg_avg", "chamfer_avg", "nodes_avg",
                "svg_kb_avg", "time_avg", "time_total")
    return {
        "P10_effective_scale": lambda s, d: _rounded(_scaled(s, d), "scale"),
        "P11_scaled_thresholds": lambda s, d: _scaled(s, d).select(
            "image_id", Rq.scaled_speckle(F.col("scale")).alias("speckle"),
            Rq.scaled_segment(F.col("scale")).alias("segment")),
        "P12_palette_policy": lambda s, d: derived.requests(s, d).select(
            "req_id", F.inline(F.array(Rq.palette_policy(F.col("palette"), F.col("colors_mode"))))
        ).select("req_id", *long("n"), "mode", "error"),
        "P13_validate_request": lambda s, d: I.validate_requests(derived.requests(s, d)).select(
            *long("req_id", "reject_code", "n"), "reject_reason", "mode"),
        "E2_requested_palettes": _requested,
        "P14_safe_name": lambda s, d: derived.finished_runs(s, d).select(
            "filename_hint", Rq.safe_name(F.col("filename_hint")).alias("safe")),
        "P22_run_id": lambda s, d: derived.runs(s, d).select(
            "run_id", Rq.run_id(F.col("ts")).alias("id")),
        "S2_sample_filter": lambda s, d: I.sample_filter(_files(s, d)).select("path"),
        "S3_explode_pixels": lambda s, d: Im.explode_pixels(
            derived.raster_rows(derived.pixels(s, d))).select(
            "image_id", F.col("line").alias("y"), "x", "r", "g", "b", *long("a")),
        "S1_read_images": _image_files,
        "S5_file_kinds": _file_kinds,
        "S8_read_svg_files": _svg_files,
        "S5_sniff_format": lambda s, d: _files(s, d).select(
            "file_id", Rq.sniff_format(F.col("path"), F.col("content")).alias("ext")),
        "S6_write_metrics": lambda s, d: _metrics_table(s, d).select(
            "sample", "variant", "iou_mean", "nodes", "render_ok"),
        "S6_sample_report": lambda s, d: Rp.sample_report(derived.sample_metrics(s, d)),
        "S7_run_log_append": lambda s, d: _run_log(s, d).select(
            "id", "source", "filename_hint", *long("colors"), "colors_mode", "geom", "fmt",
            "input_bytes", "output_bytes", F.to_json("palette").alias("palette")),
        "J7_source_vs_output": _source_vs_output,
        "A22_artifact_qa": lambda s, d: I.artifact_qa(derived.artifacts(s, d)).select(
            "path_id", "status", "reason"),
        "A23_report_aggregates": lambda s, d: _rounded(
            Rp.report_aggregates(derived.sample_metrics(s, d)), *averages),
        "W2_worst_chamfer": lambda s, d: Rp.worst_chamfer(derived.sample_metrics(s, d)),
        "W3_keep_newest_runs": lambda s, d: I.keep_newest_runs(
            derived.run_files(s, d)).select("key", "keep"),
        "W4_latest_run": lambda s, d: I.latest_run(
            derived.runs(s, d), ["ts", "run_id"]).select("run_id", "source", "kind", "output_bytes"),
        "W5_variant_matrix": lambda s, d: Rp.variant_matrix(
            derived.sample_metrics(s, d), ["vA", "vN", "vR"]),
        "W5_variant_means": lambda s, d: _rounded(
            Rp.variant_means(derived.sample_metrics(s, d)), *Rp.MEAN_METRICS),
        "W7_render_failures": lambda s, d: Rp.render_failures(derived.sample_metrics(s, d)),
        "W8_union_samples": lambda s, d: Rp.union_samples(
            derived.runs(s, d).select("run_id", "kind"),
            derived.requests(s, d).select(F.col("req_id").alias("run_id"),
                                          F.col("format").alias("kind"))),
    }


def all_queries() -> dict:
    return {**palette_queries(), **quality_queries(), **region_queries(), **outline_queries(),
            **intake_queries()}
