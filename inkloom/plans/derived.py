"""Image, outline, request and run tables derived from the star-schema test tables.

These are the Spark forms of the tables defined in FIXTURES.md. The row number within a
supplier, which places a line item on its image, is computed from counts per key range, so a
supplier that owns a third of all rows is still numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions.requests import effective_scale, requested_scale, run_id
from inkloom.plans.spread import int_div, number_rows, tasks_for

IMAGE_WIDTH = 24
RANGE_ROWS = 1 << 20
# Outlines of a task; a row of ``part`` is a few bytes, its outline and document are much more.
TASK_OUTLINES = 1 << 14
# Quantity and part of the pixels that fill a last raster row: they add nothing to the plate colour.
FILL_QUANTITY, FILL_PART = 17, 2
ROW_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(lines: DataFrame) -> DataFrame:
    """``i`` = 0-based position of each row in its supplier's order, ``n`` = the supplier's rows."""
    # Ranges of the order key, about RANGE_ROWS rows each over all suppliers.
    span = lines.agg(F.max("l_orderkey").alias("top"), F.count(F.lit(1)).alias("rows"))
    ranges = int_div(F.col("rows"), RANGE_ROWS) + 1
    ranged = lines.crossJoin(F.broadcast(span)).withColumn(
        "rng", int_div(F.col("l_orderkey"), int_div(F.col("top"), ranges) + 1)
    ).drop("top", "rows").repartition(
        tasks_for(lines.sparkSession, lines.count()), "l_suppkey", "rng")
    return number_rows(ranged, ["l_suppkey"], "rng", list(ROW_ORDER), total="n")


def _base_channel(plate: dict[int, int], ramp: Column, blues: Column, reds: list[int],
                  hue: tuple[int, int, int]) -> Column:
    kind, ink, img = F.col("kind"), F.col("ink"), F.col("image_id")
    plate_value = F.when(kind == 1, plate[1]).when(kind == 2, plate[2]).otherwise(plate[0])
    near_reds = F.when(ink == 0, reds[0]).when(ink == 1, reds[1]).otherwise(reds[2])
    free = (img * hue[0] + ink * hue[1] + hue[2]) % 240 + 8
    return (
        F.when(ink < 0, plate_value)
        .when(kind == 2, ramp)
        .when(kind == 3, blues)
        .when(kind == 4, near_reds)
        .otherwise(free)
    )


def _channels() -> dict[str, Column]:
    ink = F.col("ink")
    return {
        "r": _base_channel({0: 250, 1: 20, 2: 12}, 90 + ink * 62, 20 + ink * 6,
                           [200, 214, 40], (53, 97, 40)),
        "g": _base_channel({0: 250, 1: 80, 2: 12}, 90 + ink * 62, 40 + ink * 10,
                           [40, 52, 50], (31, 61, 90)),
        "b": _base_channel({0: 250, 1: 50, 2: 12}, 90 + ink * 62, 120 + ink * 20,
                           [40, 50, 190], (17, 151, 10)),
    }


def _filling(lines: DataFrame) -> DataFrame:
    """``i, n`` of the places behind each supplier's last row, up to the end of the raster row."""
    n = F.col("n")
    return (
        lines.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
        .filter(n % IMAGE_WIDTH != 0)
        .withColumn("i", F.explode(F.sequence(n, n - n % IMAGE_WIDTH + IMAGE_WIDTH - 1)))
        .select("l_suppkey", "i", "n", F.lit(FILL_QUANTITY).cast("bigint").alias("q"),
                F.lit(FILL_PART).cast("bigint").alias("pk"))
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per supplier, 24 columns wide, six kinds of plate and bands. Every line item is
    a pixel; plate pixels fill the last row."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", *ROW_ORDER)
    i, n = F.col("i"), F.col("n")
    x, y, h, kind = F.col("x"), F.col("y"), F.col("h"), F.col("kind")
    ink = F.col("ink")
    base = _channels()
    frame = (kind == 5) | (x < 2) | (x > 21) | (y < 2) | (y >= h - 2)
    return (
        _numbered(lines)
        .select("l_suppkey", "i", "n", F.col("l_quantity").cast("bigint").alias("q"),
                F.col("l_partkey").alias("pk"))
        .unionByName(_filling(lines))
        .select(
            F.col("l_suppkey").alias("image_id"),
            (F.col("l_suppkey") % 6).alias("kind"),
            (i % IMAGE_WIDTH).cast("int").alias("x"),
            int_div(i, IMAGE_WIDTH).alias("y"),
            F.lit(IMAGE_WIDTH).alias("w"),
            int_div(n + IMAGE_WIDTH - 1, IMAGE_WIDTH).alias("h"),
            "q", "pk",
        )
        .withColumn("ink", F.when(frame, F.lit(-1)).otherwise(int_div(x - 2, 7)).cast("bigint"))
        .select(
            "image_id", "kind", "x", "y", "w", "h",
            (base["r"] + F.col("q") % 7 - 3).alias("r"),
            (base["g"] + F.col("q") % 5 - 2).alias("g"),
            (base["b"] + F.col("pk") % 5 - 2).alias("b"),
            F.when((F.col("image_id") % 4 == 0) & (ink < 0), 0).otherwise(255).alias("a"),
            "ink", "pk",
        )
    )


def band_palettes(px: DataFrame) -> DataFrame:
    """The colours the images were drawn with: plate in slot 0, then up to three bands."""
    size = px.groupBy("image_id", "kind").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    first, last = F.lit(-1).cast("bigint"), F.lit(2).cast("bigint")
    inks = F.sequence(first, F.when(F.col("kind") == 5, first).otherwise(last))
    base = _channels()
    rows = size.withColumn("ink", F.explode(inks)).select(
        "image_id", "w", "h",
        F.struct((F.col("ink") + 1).alias("slot"),
                 *(v.cast("bigint").alias(c) for c, v in base.items())).alias("p"),
    )
    palettes = rows.groupBy("image_id").agg(
        F.max("w").alias("w"), F.max("h").alias("h"),
        F.array_sort(F.collect_list("p")).alias("palette"),
    )
    plate = F.get("palette", F.lit(0))
    return palettes.select(
        "image_id", "w", "h", *(plate[c].alias(f"bg_{c}") for c in "rgb"), "palette")


def traced(px: DataFrame, modulus: int = 11, shift: int = 1) -> DataFrame:
    """A perturbed copy: each ``pk % modulus = 0`` pixel takes the colour ``shift`` places to its left.
    ``px`` is a stored table, whose number of rows is in its files."""
    left = Window.partitionBy("image_id", "y").orderBy("x")
    smear = F.col("pk") % modulus == 0

    def channel(c: str) -> Column:
        return F.when(smear, F.coalesce(F.lag(c, shift).over(left), F.col(c))).otherwise(F.col(c)).alias(c)

    dealt = px.repartition(tasks_for(px.sparkSession, px.count()), "image_id", "y")
    return dealt.select("image_id", "x", "y", "w", "h", channel("r"), channel("g"), channel("b"))


def rendered(px: DataFrame, variants: dict[str, tuple[int, int]]) -> DataFrame:
    """The perturbed copies of all variants; every nineteenth image could not be rendered."""
    out: DataFrame | None = None
    for name, how in variants.items():
        rows = traced(px.filter("image_id % 19 <> 0"), *how).withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def traces(spark: SparkSession, sf_dir: str, px: DataFrame, variants: dict[str, str]) -> DataFrame:
    """A trace per image and variant (name and upscale setting), its document that of the outline with the
    image's number; tracing failed for every seventeenth image."""
    key = F.col("image_id")
    docs = svg_docs(vertices(spark, sf_dir)).select(F.col("path_id").alias("image_id"), "svg")
    names = F.array(*(F.struct(
        F.lit(i).alias("i"), F.lit(v).alias("variant"), F.lit(up).alias("upscale"))
        for i, (v, up) in enumerate(variants.items())))
    images = px.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    failed = key % 17 == 0
    return images.join(docs, "image_id").withColumn("v", F.explode(names)).select(
        "image_id", "v.variant", F.format_string("sample_%05d.png", key).alias("file"),
        F.when(~failed, F.col("svg")).alias("svg"), F.lit(4).alias("colors_requested"), "v.upscale",
        effective_scale(F.col("w"), F.col("h"), requested_scale(F.col("v.upscale"))).alias("effective_scale"),
        F.lit("outline").alias("engine"), ((key * 7 + F.col("v.i") * 13) % 60 / 10.0).alias("elapsed"),
        F.when(failed, "trace failed").alias("error"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed outlines from ``part``: circle, ellipse, rippled circle, square."""
    key = F.col("p_partkey")
    shape, n, m, t, rad = (F.col(c) for c in ("shape", "n", "m", "t", "rad"))
    radius = rad + F.when(shape == 2, 3 * (m % 2)).otherwise(0)
    squash = F.when(shape == 1, 0.6).otherwise(1.0)
    square_x = F.when(m < 4, m * 10).when(m < 8, 40).when(m < 12, 40 - (m - 8) * 10).otherwise(0)
    square_y = (
        F.when(m < 4, 0).when(m < 8, (m - 4) * 10).when(m < 12, 40).otherwise(40 - (m - 12) * 10)
    )
    parts = table(spark, sf_dir, "part")
    return (
        parts.repartition(tasks_for(spark, parts.count(), TASK_OUTLINES))
        .select(
            key.alias("path_id"),
            (key % 4).alias("shape"),
            F.when(key % 4 == 3, 16).otherwise(12 + F.col("p_size") % 13).alias("n"),
            (20 + F.col("p_size") % 30).alias("rad"),
        )
        .withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n"))))
        .withColumn("m", F.col("seq") % n)
        .withColumn("t", F.lit(2.0) * F.pi() * m / n)
        .select(
            "path_id", "shape", "seq",
            F.when(shape < 3, F.round(100 + radius * F.cos(t), 2))
            .otherwise(square_x.cast("double")).alias("x"),
            F.when(shape < 3, F.round(100 + radius * squash * F.sin(t), 2))
            .otherwise(square_y.cast("double")).alias("y"),
        )
    )


def svg_docs(vx: DataFrame) -> DataFrame:
    """One SVG document per outline (an outline has at most 25 vertices here)."""
    step = F.concat(
        F.when(F.col("seq") == 0, "M ").otherwise("L "),
        F.col("x").cast("decimal(9,2)").cast("string"), F.lit(" "),
        F.col("y").cast("decimal(9,2)").cast("string"),
    )
    steps = F.array_sort(F.collect_list(F.struct("seq", step.alias("s"))))
    d = F.array_join(F.transform(steps, lambda e: e["s"]), " ")
    return vx.groupBy("path_id").agg(
        F.concat(F.lit('<svg width="200" height="200"><path d="'), d,
                 F.lit(' Z" fill="#c53837"/></svg>')).alias("svg")
    )


def mixed_docs(vx: DataFrame) -> DataFrame:
    """The outlines in other spellings: relative lines for odd paths, cubics for even ones.

    The relative ones leave their last edge to the closing command. The cubics have both controls on the segment's ends, so their samples lie on it.
    """
    two = "decimal(9,2)"
    w = Window.partitionBy("path_id").orderBy("seq")
    x, y = F.col("x").cast(two), F.col("y").cast(two)
    px, py = F.lag(x).over(w), F.lag(y).over(w)

    def text(*values: Column) -> Column:
        return F.concat_ws(" ", *(v.cast("string") for v in values))

    odd = F.col("path_id") % 2 == 1
    relative = F.when(F.col("seq") == 0, F.concat(F.lit("m "), text(x, y), F.lit(" l"))).otherwise(
        text((x - px).cast(two), (y - py).cast(two)))
    cubic = F.when(F.col("seq") == 0, F.concat(F.lit("M"), text(x, y))).otherwise(
        F.concat(F.lit("C"), text(px, py, x, y, x, y)))
    steps = F.array_sort(F.collect_list(F.struct("seq", "t")))
    return (
        vx.select("path_id", "seq", F.when(odd, relative).otherwise(cubic).alias("t"),
                  F.lead("seq").over(w).isNull().alias("last"))
        .filter(~(odd & F.col("last")))
        .groupBy("path_id")
        .agg(F.concat(F.lit('<svg width="200" height="200"><path d="'),
                      F.array_join(F.transform(steps, lambda e: e["t"]), " "),
                      F.lit('z"/></svg>')).alias("svg"))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion requests with good and bad fields, one per event."""
    e = F.col("event_id")

    def pick(modulus: int, values: list[str | None], default: str | None) -> Column:
        out = F.when(e % modulus == 0, values[0])
        for k, v in enumerate(values[1:], 1):
            out = out.when(e % modulus == k, v)
        return out.otherwise(default)

    return table(spark, sf_dir, "events").select(
        e.alias("req_id"),
        pick(9, ["auto", "", "2", " 16 ", "17", "0", "abc", "AUTO"], None).alias("palette"),
        pick(5, ["auto", "up_to", "exact", ""], "bogus").alias("colors_mode"),
        pick(7, ["svg", "png"], "PDF").alias("format"),
        pick(8, ["basic", "wild"], "off").alias("geom"),
        F.when(e % 13 == 0, 0).otherwise(F.round(F.col("value") * 100).cast("bigint") * 1000)
        .cast("bigint").alias("n_bytes"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), "ts", F.col("user_id").alias("source"),
        F.col("event_type").alias("kind"), F.col("value").alias("output_bytes"),
    )


def sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows per supplier (sample) and return flag (variant), with failed renders."""
    def units(c: str) -> Column:
        return F.sum(F.round(F.col(c) * 100).cast("bigint"))

    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), units("l_discount").alias("d"), units("l_tax").alias("t"),
        units("l_quantity").alias("q"))
    key, n = F.col("l_suppkey"), F.col("n")
    failed = (key + n) % 17 == 0

    def part(value: Column, scale: int) -> Column:
        return F.when(~failed, F.floor(value * float(scale) / n) / float(scale))

    bg = F.struct(F.lit(0).cast("bigint").alias("slot"), *(
        ((key * m) % 256).alias(c) for m, c in ((3, "r"), (5, "g"), (7, "b"))))
    return sums.select(
        F.format_string("sample_%05d", key).alias("sample"),
        F.concat(F.lit("v"), "l_returnflag").alias("variant"),
        part(n - F.col("d") / 100.0, 10000).alias("iou_mean"),
        part(n - F.col("t") / 100.0, 10000).alias("iou_aw"),
        F.when(n % 4 != 0, part(n - F.col("d") / 200.0, 10000)).alias("iou_bg"),
        part(F.col("t") / 10.0, 100).alias("chamfer"),
        F.when(~failed, n * 3).alias("nodes"), F.col("q").alias("svg_bytes"),
        (F.floor(n % 60) / 10.0).alias("elapsed"), (~failed).alias("render_ok"),
        (~failed & (n % 29 == 0)).alias("degenerate"),
        F.when(failed & (key % 2 == 0), "trace failed").alias("error"),
        F.array(bg).alias("palette"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output files in good and bad states, one per outline document."""
    key = F.col("path_id")
    zero = ' <path d="M 0.00 0.00 L 0.00 0.00 Z"/>'
    docs = svg_docs(vertices(spark, sf_dir))
    suffix = F.when(key % 4 == 0, ".pdf").when(key % 11 == 0, ".eps").otherwise(".svg")
    content = (
        F.when((key % 4 == 0) & (key % 3 != 0), F.concat(F.lit("%PDF-1.7 "), "svg"))
        .when(key % 7 == 0, F.replace("svg", F.lit("</svg>"), F.repeat(F.lit(zero), 3)))
        .when(key % 13 == 0, "plain text").otherwise(F.col("svg")))
    return docs.select(
        "path_id", (key % 10 != 0).alias("present"), suffix.alias("suffix"),
        content.alias("content"), (F.length("svg") + key % 400).cast("bigint").alias("n_bytes"),
        ((key % 50) / 1000.0).alias("ink_coverage"),
        F.when(key % 3 != 0, (key % 90) / 100.0).alias("source_coverage"))


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files per event named after its run id, and some with short names."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", run_id(F.col("ts")).alias("id"))
    named = e.select("ts", "event_id", F.explode(F.array(
        F.concat("id", F.lit(".jpg")), F.concat("id", F.lit("_meta.json")))).alias("name"))
    return named.select("ts", F.when(F.col("event_id") % 50 == 0, F.concat(
        F.lit("ui_"), F.col("event_id").cast("string"))).otherwise(F.col("name")).alias("name"))


def finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with hint names in several spellings and sizes that may be zero."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "ts", F.lit("api").alias("source"),
        F.concat_ws("", F.when(e % 3 == 0, "/tmp/up load/").otherwise("__.lo go"),
                    F.col("event_type"), e.cast("string"),
                    F.when(e % 4 == 0, "?.PNG/").otherwise(".jpg_")).alias("filename_hint"),
        (e % 16 + 1).cast("int").alias("colors"), F.lit("exact").alias("colors_mode"),
        F.lit("off").alias("geom"), F.when(e % 7 == 0, "svg").otherwise("pdf").alias("fmt"),
        F.array(F.struct((e % 256).alias("r"), (e % 200).alias("g"), (e % 100).alias("b"))
                ).alias("palette"),
        F.when(e % 13 == 0, 0).otherwise(e * 10).cast("bigint").alias("input_bytes"),
        F.round(F.col("value") * 100).cast("bigint").alias("output_bytes"))


def raster_rows(px: DataFrame) -> DataFrame:
    """Pixels packed back to image bytes: one four-channel image of height 1 per pixel row."""
    at = F.format_string("%02X%02X%02X%02X", "b", "g", "r", "a")
    cells = F.array_sort(F.collect_list(F.struct("x", at.alias("t"))))
    return px.groupBy("image_id", "y", "w").agg(
        F.unhex(F.array_join(F.transform(cells, lambda c: c["t"]), "")).alias("data")
    ).select("image_id", F.col("y").alias("line"), "w", F.lit(1).alias("h"),
             F.lit(4).alias("n_channels"), "data")
