"""Corpus reports over sample metrics: one row per sample and variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.colour import hex_palette
from inkloom.plans.spread import checkpoint

MATRIX_METRICS = ("iou_aw", "chamfer", "nodes", "elapsed")
MEAN_METRICS = ("iou_mean", "iou_aw", "chamfer", "nodes", "svg_kb", "elapsed")


def report_aggregates(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, minima and maxima; missing values are skipped, zero times as well."""
    fair = F.when(~F.col("degenerate"), F.col("chamfer"))
    time = F.nullif("elapsed", F.lit(0.0))

    def spread(name: str, value) -> list:
        return [F.avg(value).alias(f"{name}_avg"), F.min(value).alias(f"{name}_min"),
                F.max(value).alias(f"{name}_max")]

    return metrics.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("samples"),
        *spread("iou_mean", F.col("iou_mean")), *spread("iou_aw", F.col("iou_aw")),
        *spread("iou_bg", F.col("iou_bg")), *spread("chamfer", fair),
        *spread("nodes", F.col("nodes")),
        (F.avg("svg_bytes") / 1024).alias("svg_kb_avg"),
        F.avg(time).alias("time_avg"), F.sum(time).alias("time_total"),
        F.count_if("degenerate").alias("degenerates"),
    )


def worst_chamfer(metrics: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` samples with the largest Chamfer distance, degenerate ones included."""
    return (
        metrics.filter(F.col("chamfer").isNotNull())
        .orderBy(F.desc("chamfer"), "sample", "variant").limit(k)
        .select("sample", "variant", "chamfer", "iou_mean")
    )


def render_failures(metrics: DataFrame) -> DataFrame:
    return metrics.filter(~F.coalesce("render_ok", F.lit(True))).select(
        "sample", "variant", F.coalesce("error", F.lit("render-back failed")).alias("reason"))


def union_samples(*parts: DataFrame) -> DataFrame:
    """Concatenation of corpora or variants by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def variant_matrix(metrics: DataFrame, variants: list[str]) -> DataFrame:
    """One row per sample, one column per metric and variant."""
    return (
        metrics.groupBy("sample").pivot("variant", variants)
        .agg(*(F.first(m, ignorenulls=True).alias(m) for m in MATRIX_METRICS))
    )


def variant_means(metrics: DataFrame) -> DataFrame:
    """Mean of every matrix metric per variant."""
    sized = metrics.withColumn("svg_kb", F.col("svg_bytes") / 1024)
    return sized.groupBy("variant").agg(*(F.avg(m).alias(m) for m in MEAN_METRICS))


# --- report text --------------------------------------------------------------------------


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows in global order with ``no`` from 1, numbered per sorted partition.

    The offsets table has one row per partition.
    """
    sorted_ = checkpoint(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = sorted_.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("c"))
    offsets = sizes.agg(F.array_sort(F.collect_list(F.struct("_part", "c"))).alias("all")).select(
        F.expr("inline(transform(all, (s, i) -> struct(s._part AS _part, "
               "aggregate(slice(all, 1, i), 0L, (acc, e) -> acc + e.c) AS before)))"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        "no", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("before") + 1).drop(
        "_part", "_at", "before")


def sample_report(metrics: DataFrame) -> DataFrame:
    """Markdown table lines, one per sample: ``no, line``. Write them with ``df.write.text``."""
    def text(name: str, pattern: str):
        value = F.col(name)
        return F.when(value.isNull(), "—").otherwise(F.format_string(pattern, value))

    line = F.concat(
        F.lit("| "), F.col("no").cast("string"), F.lit(" | `"), F.coalesce("sample", F.lit("")), F.lit("` | "),
        F.concat_ws(" | ", hex_palette(F.col("palette")),
                    F.concat(text("iou_mean", "%.4f"),
                             F.when(F.coalesce("degenerate", F.lit(False)), " ⚠").otherwise("")),
                    text("iou_aw", "%.4f"), text("iou_bg", "%.4f"), text("chamfer", "%.2f"),
                    text("nodes", "%d"), F.when(F.col("svg_bytes").isNull(), "—").otherwise(
                        F.format_string("%.1f", F.bround(F.col("svg_bytes") / 1024, 1))),
                    F.when(F.coalesce("elapsed", F.lit(0.0)) == 0, "—").otherwise(
                        F.format_string("%.1fs", "elapsed"))),
        F.lit(" |"),
    )
    return _numbered(metrics, "sample", "variant").select("no", line.alias("line"))


DASH = "—"


def _text(name: str, pattern: str) -> Column:
    value = F.col(name)
    return F.when(value.isNull(), DASH).otherwise(F.format_string(pattern, value))


def _fixed(lines: list[str], spark) -> DataFrame:
    """Lines that stand in every report."""
    return spark.createDataFrame(list(enumerate(lines)), "no bigint, line string")


def _some(lines: list[Column], frame: DataFrame) -> DataFrame:
    """The lines that are not null, from a frame of one row."""
    listed = F.array_compact(F.array(*lines))
    return frame.select(F.posexplode(listed).alias("no", "line")).select(F.col("no").cast("bigint"), "line")


def _span(label: str, name: str, digits: int, unit: str = "", ends: int | None = None) -> Column:
    """``- **label mean unit  (min: .., max: ..)``, null where nothing was measured."""
    def number(part: str, places: int) -> Column:
        value = F.col(f"{name}_{part}").cast("double")
        return F.format_string(f"%.{places}f", F.bround(value, places))

    ends = digits if ends is None else ends
    return F.when(F.col(f"{name}_avg").isNotNull(), F.concat(
        F.lit(f"- **{label} "), number("avg", digits), F.lit(f"{unit}  (min: "), number("min", ends),
        F.lit(", max: "), number("max", ends), F.lit(")")))


def report_lines(records: DataFrame, version: str, date: str) -> DataFrame:
    """The whole report of one variant's records: ``section, no, line`` in reading order.

    Sections: head, samples, note on degenerate metrics, masks, aggregates, worst Chamfer, failures. Only
    one aggregated row and the few worst samples are gathered; sample and mask lines stay spread.
    """
    spark = records.sparkSession
    rows = checkpoint(_numbered(records, "file"))
    degenerate = F.coalesce("degenerate", F.lit(False))
    totals = checkpoint(report_aggregates(rows).crossJoin(rows.agg(
        F.min_by("upscale", "no").alias("upscale"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(F.size("per_mask")), F.lit(-1)).alias("masks"))))
    shown = (F.col("upscale").isNotNull() & ~F.col("upscale").isin("", "off"))
    head = _some([
        F.lit(f"# Evaluation ({version})"), F.lit(""),
        F.concat(F.lit("**Samples:** "), F.col("n").cast("string")), F.lit(f"**Date:** {date}"), F.lit(""),
        F.when(shown, F.concat(F.lit("**Upscale:** "), F.col("upscale"))), F.when(shown, F.lit("")),
        F.lit("## Per-Sample Metrics"), F.lit(""),
        F.lit("| # | Sample | Size | Inks | IoU mean | IoU aw | IoU worst | IoU bg | Chamfer | Nodes | SVG KB | Time |"),
        F.lit("|---|--------|------|------|----------|--------|-----------|--------|---------|-------|--------|------|"),
    ], totals)
    name = F.concat(F.lit("`"), F.col("file"), F.lit("`"))
    sample = rows.select("no", F.concat(
        F.lit("| "), F.concat_ws(
            " | ", F.col("no").cast("string"), name,
            F.concat(F.col("w").cast("string"), F.lit("×"), F.col("h").cast("string")),
            hex_palette(F.col("palette")),
            F.concat(_text("iou_mean", "%.4f"), F.when(degenerate, " ⚠").otherwise("")),
            _text("iou_aw", "%.4f"), _text("iou_worst", "%.4f"), _text("iou_bg", "%.4f"),
            _text("chamfer", "%.2f"), F.coalesce(F.col("nodes").cast("string"), F.lit("None")),
            F.format_string("%.1f", F.bround(F.col("svg_bytes") / 1024, 1)),
            F.when(F.coalesce("elapsed", F.lit(0.0)) == 0, DASH).otherwise(F.format_string("%.1fs", "elapsed"))),
        F.lit(" |")).alias("line"))
    note = _some([F.when(F.col("degenerates") > 0, F.lit(t)) for t in ("", "> ⚠ = degenerate metric")], totals)
    any_mask = F.col("masks") > 0
    mask_head = _some([F.when(any_mask, F.lit(t)) for t in (
        "", "## Per-Mask Detail", "", "| Sample | Color | Is BG | IoU | Area % |",
        "|--------|-------|-------|-----|--------|")], totals)
    mask = rows.select("no", "file", F.inline("per_mask")).select(
        # At most 17 slots a sample.
        (F.col("no") * 32 + F.col("ref_slot")).alias("no"),
        F.concat(F.lit("| "), F.concat_ws(
            " | ", name, "color", F.when(F.col("is_bg"), "bg").otherwise("ink"), F.format_string("%.4f", "iou"),
            F.format_string("%.1f%%", F.bround("area_pct", 1))), F.lit(" |")).alias("line"))
    aggregate = _some([
        F.lit(""), F.lit("## Aggregate"), F.lit(""), _span("IoU mean:** ", "iou_mean", 4),
        _span("IoU area-weighted:**", "iou_aw", 4), _span("IoU bg mean:**", "iou_bg", 4),
        _span("Chamfer mean:**", "chamfer", 2, " px"), _span("Nodes mean:** ", "nodes", 0),
        F.when(F.col("svg_kb_avg").isNotNull(), F.concat(
            F.lit("- **SVG size mean:** "), F.format_string("%.1f", F.bround("svg_kb_avg", 1)), F.lit(" KB"))),
        F.when(F.col("time_avg").isNotNull(), F.concat(
            F.lit("- **Time mean:** "), F.format_string("%.1f", F.bround("time_avg", 1)), F.lit("s  (total: "),
            F.format_string("%.0f", F.bround("time_total", 0)), F.lit("s)"))),
        F.when(F.col("degenerates") > 0, F.concat(
            F.lit("- **Degenerate samples:** "), F.col("degenerates").cast("string"))),
    ], totals)
    worst = rows.filter("chamfer IS NOT NULL").orderBy(F.desc("chamfer"), "no").limit(3)
    worst_line = F.concat(F.lit("- "), name, F.lit(" — Chamfer "), F.format_string("%.2f", "chamfer"),
                          F.lit(" px, IoU mean "), _text("iou_mean", "%.4f"))
    # Three rows at most; their order is that of the distance.
    listed = worst.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("chamfer")).alias("d"), "no", worst_line.alias("line")))).alias("w"))
    worst = listed.filter(F.size("w") > 0).select(F.posexplode(F.concat(
        F.array(*(F.lit(t) for t in ("", "## Worst Chamfer", ""))), F.col("w.line"))).alias("no", "line")).select(
        F.col("no").cast("bigint"), "line")
    failed = rows.filter(~F.coalesce("render_ok", F.lit(True)))
    failed_head = failed.limit(1).select(F.posexplode(F.array(F.lit(""), F.lit("## Render Failures"))).alias(
        "no", "line")).select((F.col("no") - 2).cast("bigint").alias("no"), "line")
    failed = failed_head.unionByName(failed.select("no", F.concat(
        F.lit("- "), name, F.lit(" — "), F.coalesce("error", F.lit("render-back failed"))).alias("line")))
    out: DataFrame | None = None
    for i, part in enumerate((head, sample, note, mask_head, mask, aggregate, worst, failed)):
        part = part.select(F.lit(i).alias("section"), "no", "line")
        out = part if out is None else out.unionByName(part)
    return out


MATRIX = [("IoU aw", "iou_aw", 4), ("Chamfer (px)", "chamfer", 2), ("Nodes", "nodes", 0), ("Time (s)", "elapsed", 1)]
MEANS = [("IoU mean", "iou_mean", 4), ("IoU aw", "iou_aw", 4), ("Chamfer", "chamfer", 2), ("Nodes", "nodes", 0),
         ("SVG KB", "svg_kb", 1), ("Time (s)", "elapsed", 1)]


def _number(value: Column, digits: int) -> Column:
    return F.when(value.isNull(), DASH).otherwise(
        F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits)))


def matrix_lines(records: DataFrame, variants: list[str], date: str) -> DataFrame:
    """The comparison of variants: ``section, sample, no, line``, to be read in the order of section, sample
    (heads have an empty one) and no. One table per metric, one row per sample; then the variants' means."""
    spark = records.sparkSession
    heads = "".join(f" {v} |" for v in variants)
    rule = "--------|" * (len(variants) + 1)
    count = records.agg(F.count_distinct("sample").alias("n"))
    parts = [_some([
        F.lit("# Variant Comparison"), F.lit(""), F.concat(F.lit("**Samples:** "), F.col("n").cast("string")),
        F.lit(f"**Date:** {date}"), F.lit("")], count).select(F.lit(0).alias("section"), F.lit("").alias("sample"), "no", "line")]
    matrix = variant_matrix(records, variants)
    for k, (title, metric, digits) in enumerate(MATRIX, 1):
        first = _fixed([*([""] if k > 1 else []), f"## {title}", "", "| Sample |" + heads, "|" + rule], spark)
        parts.append(first.select(F.lit(k).alias("section"), F.lit("").alias("sample"), "no", "line"))
        cells = [F.concat(F.lit(" "), _number(F.col(f"{v}_{metric}"), digits), F.lit(" |")) for v in variants]
        parts.append(matrix.select(
            F.lit(k).alias("section"), "sample", F.lit(0).cast("bigint").alias("no"),
            F.concat(F.lit("| `"), F.col("sample"), F.lit("` |"), *cells).alias("line")))
    means = variant_means(records).groupBy().pivot("variant", variants).agg(
        *(F.first(m, ignorenulls=True).alias(m) for m in MEAN_METRICS))
    last = _some([
        F.lit(t) for t in ("", "## Aggregate (mean across samples)", "", "| Metric |" + heads, "|" + rule)
    ] + [F.concat(F.lit(f"| {title} |"), *(
        F.concat(F.lit(" "), _number(F.col(f"{v}_{metric}"), digits), F.lit(" |")) for v in variants))
        for title, metric, digits in MEANS], means)
    parts.append(last.select(F.lit(len(MATRIX) + 1).alias("section"), F.lit("").alias("sample"), "no", "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
