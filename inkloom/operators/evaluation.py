"""The full evaluation record of every sample and variant, from one pass over the corpus.

Variants are part of the key: rendered pixels of all variants meet the source in one join, and image
and variant together number the traces, on which labels, masks, edges and distances are computed
side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.colour import Rgb, hex_color
from inkloom.functions.svg import svg_node_count
from inkloom.operators import palette as P
from inkloom.operators.labels import attach_palettes, label_with
from inkloom.operators.quality import (
    beside, chamfer, contingency, differs, identical_masks, mask_iou, pair_palettes, sample_iou,
)
from inkloom.plans.spread import STRIP_PIXELS, store, tasks_for, with_halo

#: Columns of a record, in order; ``per_mask`` is an array ordered by palette slot.
RECORD = [
    "sample", "file", "variant", "w", "h", "colors_requested", "palette", "bg_color", "iou_mean",
    "iou_worst", "iou_bg", "iou_aw", "iou_unmatched", "chamfer", "nodes", "svg_bytes", "render_ok",
    "degenerate", "upscale", "effective_scale", "engine", "elapsed", "error", "per_mask",
]


def _trace_id(variants: list[str]) -> Column:
    place = F.array_position(F.array(*map(F.lit, variants)), F.col("variant")) - 1
    return F.col("image_id") * len(variants) + place


def label_traces(
    source: DataFrame, rendered: DataFrame, palettes: DataFrame, variants: list[str],
    strip_pixels: int = STRIP_PIXELS, tasks: int | None = None,
) -> DataFrame:
    """Both labels of each rendered pixel and whether they are edges, with the trace's number as
    ``image_id``.

    Both rasters are one table: labelled by one pass of the palettes, dealt once by trace and strip
    with the rows next to the strip. Pairing is a grouping inside the strips and edges are windows there, so
    pixels are exchanged a single time. For ``tasks`` see ``with_halo``."""
    n = len(variants)
    colours = ["image_id", "x", "y", "w", "h", "r", "g", "b"]
    both = rendered.select(*colours, _trace_id(variants).alias("trace_id")).unionByName(
        source.select(*colours, F.lit(None).cast("bigint").alias("trace_id")))
    labelled = label_with(attach_palettes(both, palettes, strip_pixels, tasks=tasks), "slot", P.px())
    # A source pixel belongs to the traces of all variants.
    trace = F.col("trace_id")
    of = F.when(trace.isNull(), F.sequence(F.col("image_id") * n, F.col("image_id") * n + n - 1)).otherwise(
        F.array(trace))
    rows = labelled.select(
        F.explode(of).alias("image_id"), *(F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w", "h")),
        F.when(trace.isNull(), F.col("slot")).alias("ref_slot"),
        F.when(trace.isNotNull(), F.col("slot")).alias("out_slot"))
    pairs = (
        with_halo(rows, 1, strip_pixels, tasks)
        .groupBy("image_id", "strip", "x", "y", "w", "h", "own")
        .agg(F.max("ref_slot").alias("ref_slot"), F.max("out_slot").alias("out_slot"))
        .filter("ref_slot IS NOT NULL AND out_slot IS NOT NULL"))
    return beside(pairs, ["ref_slot", "out_slot"]).select(
        "image_id", "x", "y", "w", "h", "ref_slot", "out_slot",
        differs("ref_slot").alias("ref_edge"), differs("out_slot").alias("out_edge"))


def evaluation_records(
    source: DataFrame, rendered: DataFrame, palettes: DataFrame, traces: DataFrame,
    variants: list[str], strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """One record (``RECORD``) per row of ``traces``.

    ``traces`` has image_id (a bigint), variant (one of ``variants``, a handful), file, svg, colors_requested,
    upscale, effective_scale, engine, elapsed and error; a row with an error has no trace. ``rendered``
    holds the pixels of the variants' renderings; a trace without any could not be rendered. Both kinds
    keep their record, without measures.
    """
    source, palettes = store(source), store(palettes)
    n = len(variants)
    # Every trace has the pixels of its source beside its own.
    tasks = tasks_for(source.sparkSession, source.count() * 2 * n)
    pairs = store(label_traces(source, rendered, palettes, variants, strip_pixels, tasks))
    table = store(contingency(pairs))
    of_trace = palettes.withColumn("image_id", F.explode(F.sequence(
        F.col("image_id") * n, F.col("image_id") * n + n - 1)))
    masks = store(mask_iou(table, pair_palettes(table, of_trace)))
    images = table.select("image_id").distinct()
    colour = F.get("palette", F.col("ref_slot").cast("int"))
    per_mask = (
        masks.join(of_trace.select("image_id", "palette"), "image_id")
        .groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(
            "ref_slot", hex_color(Rgb.of(colour)).alias("color"), "is_bg", "iou", "area_pct",
            "area_px"))).alias("per_mask")))
    measured = (
        sample_iou(table, masks)
        .join(chamfer(pairs, images, strip_pixels, tasks), "image_id")
        .join(identical_masks(table), "image_id").join(per_mask, "image_id")
        .withColumnRenamed("image_id", "trace_id"))
    facts = source.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h")).join(
        palettes.select("image_id", "palette"), "image_id", "left")
    traced = F.col("error").isNull()
    ok = traced & F.col("identical").isNotNull()
    nodes = F.when(traced, svg_node_count(F.col("svg")))
    background = F.get("palette", F.lit(0))

    def when_ok(name: str) -> Column:
        return F.when(ok, F.col(name)).alias(name)

    rows = (
        traces.withColumn("trace_id", _trace_id(variants)).join(facts, "image_id")
        .join(measured, "trace_id", "left").withColumn("nodes", nodes)
        .withColumn("bg_color", F.when(traced, hex_color(Rgb.of(background))))
        .withColumn("palette", F.when(traced, F.col("palette")).otherwise(F.slice("palette", 1, 0)))
    )
    return rows.select(
        F.regexp_replace("file", r"\.[^.]*$", "").alias("sample"), "file", "variant",
        *(F.col(c).cast("bigint").alias(c) for c in ("w", "h", "colors_requested")), "palette", "bg_color",
        *map(when_ok, ("iou_mean", "iou_worst", "iou_bg", "iou_aw")),
        F.when(ok, F.col("iou_unmatched")).otherwise(F.lit(0)).cast("bigint").alias("iou_unmatched"),
        when_ok("chamfer"), F.col("nodes").cast("bigint").alias("nodes"),
        F.when(traced, F.octet_length("svg")).otherwise(0).cast("bigint").alias("svg_bytes"),
        F.coalesce(ok, F.lit(False)).alias("render_ok"),
        F.coalesce(ok & F.col("identical") & (F.col("nodes") > 0), F.lit(False)).alias("degenerate"),
        "upscale", "effective_scale", "engine", "elapsed", "error", when_ok("per_mask"),
    )
