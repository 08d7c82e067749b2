"""Comparison of a rendered result with its source, both labelled with the same palette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.colour import Rgb, let, rgb_dist2
from inkloom.operators import palette as P
from inkloom.operators.labels import attach_palettes, label_with
from inkloom.plans.spread import (
    STRIP_PIXELS, attach_image_facts, checkpoint, store, strip_of, tasks_for, whole_groups,
    with_halo,
)


# --- paired label rasters and their contingency table -------------------------------------


def pair_labels(ref: DataFrame, out: DataFrame) -> DataFrame:
    """Equi-join of two label rasters on the pixel: ``ref_slot, out_slot``."""
    right = out.select("image_id", "x", "y", F.col("slot").alias("out_slot"))
    left = ref.select("image_id", "x", "y", "w", "h", F.col("slot").alias("ref_slot"))
    return left.join(right, ["image_id", "x", "y"])


def label_pairs(
    source: DataFrame, rendered: DataFrame, palettes: DataFrame, strip_pixels: int = STRIP_PIXELS,
    tasks: int | None = None,
) -> DataFrame:
    """Both labels of each pixel. Pairing the colours first attaches the palette only once. ``tasks`` names
    the number of tasks."""
    right = rendered.select("image_id", "x", "y", *(F.col(c).alias(f"out_{c}") for c in "rgb"))
    left = source.select("image_id", "x", "y", "w", "h", "r", "g", "b")
    pixel = ["image_id", "x", "y"]
    if tasks:
        left, right = left.repartition(tasks, *pixel), right.repartition(tasks, *pixel)
    both = attach_palettes(left.join(right, pixel), palettes, strip_pixels, tasks=tasks)
    both = label_with(both, "ref_slot", P.px())
    both = label_with(both, "out_slot", Rgb.cols("out_r", "out_g", "out_b"))
    return both.select("image_id", "x", "y", "w", "h", "ref_slot", "out_slot")


def contingency(pairs: DataFrame) -> DataFrame:
    """Pixel counts per image, reference slot and output slot: all masks derive from it."""
    return pairs.groupBy("image_id", "ref_slot", "out_slot").agg(F.count(F.lit(1)).alias("n"))


def present_colors(labels: DataFrame, palettes: DataFrame) -> DataFrame:
    """Palette rows whose slot occurs in a label raster."""
    return P.palette_rows(palettes).join(
        labels.select("image_id", "slot").distinct(), ["image_id", "slot"], "left_semi"
    )


# --- greedy pairing and IoU ---------------------------------------------------------------


def _greedy_pairs(ref: Column, out: Column, palette: Column) -> Column:
    """Each reference slot, in order, takes its nearest output slot still free."""

    def colour(slot: Column) -> Rgb:
        return Rgb.of(F.get(palette, slot.cast("int")))

    def step(done: Column, r: Column) -> Column:
        free = F.filter(out, lambda o: ~F.exists(done, lambda d: d["out_slot"] == o))
        best = F.array_min(F.transform(free, lambda o: F.struct(
            rgb_dist2(colour(r), colour(o)).alias("d2"), o.alias("o"))))
        return let(best, lambda b: F.when(b.isNull(), done).otherwise(F.concat(done, F.array(
            F.struct(r.alias("ref_slot"), b["o"].alias("out_slot"))))))

    none = F.array().cast("array<struct<ref_slot:bigint,out_slot:bigint>>")
    return F.aggregate(ref, none, step)


def pair_palettes(table: DataFrame, palettes: DataFrame) -> DataFrame:
    """``image_id, ref_slot, out_slot`` from the slots present on either side (17 at most)."""
    present = table.groupBy("image_id").agg(
        F.array_sort(F.collect_set("ref_slot")).alias("ref"),
        F.array_sort(F.collect_set("out_slot")).alias("out"),
    )
    return present.join(palettes.select("image_id", "palette"), "image_id").select(
        "image_id",
        F.inline(_greedy_pairs(F.col("ref"), F.col("out"), F.col("palette"))),
    )


def mask_iou(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per paired mask: rounded IoU, area and whether it is the background."""
    ref = table.groupBy("image_id", "ref_slot").agg(F.sum("n").alias("area_px"))
    out = table.groupBy("image_id", "out_slot").agg(F.sum("n").alias("out_px"))
    total = table.groupBy("image_id").agg(F.sum("n").alias("total_px"))
    inter = F.coalesce(F.col("n"), F.lit(0))
    iou = inter / (F.col("area_px") + F.col("out_px") - inter)
    return (
        pairs.join(ref, ["image_id", "ref_slot"])
        .join(out, ["image_id", "out_slot"])
        .join(total, "image_id")
        .join(table, ["image_id", "ref_slot", "out_slot"], "left")
        .select(
            "image_id", "ref_slot", "out_slot", (F.col("ref_slot") == 0).alias("is_bg"),
            iou.alias("iou_raw"), F.bround(iou, 4).alias("iou"), "area_px",
            F.bround(F.col("area_px") / F.col("total_px") * 100, 2).alias("area_pct"),
        )
    )


def sample_iou(table: DataFrame, masks: DataFrame) -> DataFrame:
    """Per image: mean, worst and area-weighted IoU over rounded mask values.

    The sums run on whole ten-thousandths, so a result does not depend on the row order.
    """
    refs = table.groupBy("image_id").agg(F.count_distinct("ref_slot").alias("refs"))
    units = F.round(F.col("iou") * 10000).cast("bigint")
    weighted = F.sum(units * F.col("area_px")) / F.sum("area_px")
    return (
        masks.groupBy("image_id")
        .agg(
            (F.bround(F.sum(units) / F.count(F.lit(1)), 0) / 10000).alias("iou_mean"),
            F.min("iou").alias("iou_worst"),
            (F.bround(weighted, 0) / 10000).alias("iou_aw"),
            F.bround(F.avg(F.when(F.col("is_bg"), F.col("iou_raw"))), 4).alias("iou_bg"),
            F.count(F.lit(1)).alias("pairs"),
        )
        .join(refs, "image_id")
        .withColumn("iou_unmatched", F.col("refs") - F.col("pairs"))
        .drop("refs", "pairs")
    )


def identical_masks(table: DataFrame) -> DataFrame:
    """Whether both label rasters agree on every pixel."""
    differ = F.sum(F.when(F.col("ref_slot") != F.col("out_slot"), F.col("n")).otherwise(0))
    return table.groupBy("image_id").agg((differ == 0).alias("identical"))


def degenerate_flag(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Traces with nodes whose raster is exactly the reference's."""
    return identical_masks(table).join(nodes, "image_id").select(
        "image_id", (F.col("identical") & (F.col("nodes") > 0)).alias("degenerate")
    )


def xor_mask(
    pairs: DataFrame, masks: DataFrame, below: float = 0.5, strip_pixels: int = STRIP_PIXELS
) -> DataFrame:
    """Pixels in exactly one of the two masks of a badly matched colour.

    The reference slot is used on both sides, also where the pairing chose another slot.
    """
    size = pairs.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    bad = (
        masks.filter(F.col("iou") < below)
        .groupBy("image_id").agg(F.collect_set("ref_slot").alias("bad"))
        .join(size, "image_id")
    )
    slot = F.explode(F.array_distinct(F.array("ref_slot", "out_slot")))
    return (
        attach_image_facts(pairs.filter(F.col("ref_slot") != F.col("out_slot")), bad, strip_pixels)
        .select("image_id", "x", "y", "bad", slot.alias("slot"))
        .filter(F.array_contains("bad", F.col("slot")))
        .drop("bad")
    )


# --- neighbours and edges -----------------------------------------------------------------


def neighbour_join(
    labels: DataFrame, columns: list[str], strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    """Each pixel with the left, right, up and down values of ``columns``.

    One shuffle by strip; the row and column windows then sort within it. For ``tasks`` see ``with_halo``.
    """
    placed = with_halo(labels.select("image_id", "x", "y", "w", "h", *columns), 1, strip_pixels, tasks)
    return beside(placed, columns)


def beside(placed: DataFrame, columns: list[str]) -> DataFrame:
    """The same for pixels that are placed by strip with the rows next to it."""
    row = Window.partitionBy("image_id", "strip", "y").orderBy("x")
    col = Window.partitionBy("image_id", "strip", "x").orderBy("y")
    seen = placed.select(
        "image_id", "x", "y", "w", "h", "own", *columns,
        *(F.lag(c).over(row).alias(f"{c}_left") for c in columns),
        *(F.lead(c).over(row).alias(f"{c}_right") for c in columns),
        *(F.lag(c).over(col).alias(f"{c}_up") for c in columns),
        *(F.lead(c).over(col).alias(f"{c}_down") for c in columns),
    )
    return seen.filter("own").drop("own")


def differs(c: str) -> Column:
    sides = [F.coalesce(F.col(f"{c}_{s}") != F.col(c), F.lit(False))
             for s in ("left", "right", "up", "down")]
    return sides[0] | sides[1] | sides[2] | sides[3]


def edge_map(
    labels: DataFrame, column: str = "slot", strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    """Pixels with a differing 4-neighbour; both sides of a boundary are edges."""
    near = neighbour_join(labels, [column], strip_pixels, tasks)
    return near.filter(differs(column)).select("image_id", "x", "y", "w", "h")


def edge_pair(
    pairs: DataFrame, strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    """Edges of both label rasters in one pass: flags ``ref_edge`` and ``out_edge``."""
    near = neighbour_join(pairs, ["ref_slot", "out_slot"], strip_pixels, tasks)
    return (
        near.select("image_id", "x", "y", "w", "h",
                    differs("ref_slot").alias("ref_edge"), differs("out_slot").alias("out_edge"))
        .filter(F.col("ref_edge") | F.col("out_edge"))
    )


# --- nearest edge and Chamfer -------------------------------------------------------------


def _ragged_argmin(cost, starts: np.ndarray) -> np.ndarray:
    """Place of the first least value in each run of ``cost`` that begins at ``starts``."""
    place = np.arange(len(cost)) - np.repeat(starts, np.diff(np.append(starts, len(cost))))
    return np.minimum.reduceat(cost << 20 | place, starts) & ((1 << 20) - 1)


def _rows_nearest(
    row: np.ndarray, x: np.ndarray, columns, last: np.ndarray, gap: np.ndarray
) -> np.ndarray:
    """min over columns c of (x - columns(row, c))^2 + gap[row, c]^2 for queries sorted by (row, x);
    ``last`` is the place of each row's last column.

    In one row the best column moves right with x, so the middle query's best column bounds the
    search of both halves; all rows halve their intervals together.
    """
    out = np.zeros(len(x), np.int64)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    q0, q1 = first, np.append(first[1:], len(x))
    c0, c1 = np.zeros(len(q0), np.int64), last[row[first]]
    while len(q0):
        mid = (q0 + q1) // 2
        n = c1 - c0 + 1
        starts = np.cumsum(n) - n
        c = np.arange(n.sum()) - np.repeat(starts - c0, n)
        q = np.repeat(mid, n)
        cost = (x[q] - columns(row[q], c)) ** 2 + gap[row[q], c] ** 2
        best = c0 + _ragged_argmin(cost, starts)
        out[mid] = cost[starts + best - c0]
        q0, q1, c0, c1 = (np.concatenate(v) for v in (
            (q0, mid + 1), (mid, q1), (c0, best), (best, c1)))
        some = q0 < q1
        q0, q1, c0, c1 = q0[some], q1[some], c0[some], c1[some]
    return out


#: Cells (rows times columns) of the strips that are worked on at once; a larger strip comes alone.
STRIP_CELLS = 1 << 20


def _strips_nearest(part: pd.DataFrame, strip: np.ndarray, cells: int = STRIP_CELLS) -> pd.DataFrame:
    """Queries of whole strips with ``d2``; ``strip`` numbers the strip of each row, from 0 in order.
    A strip holds its queries (kind 0), its targets (1) and for each column with targets those next to the
    strip (2: ``y`` above, ``below``).

    Many strips share one table: their rows below each other, their columns side by side from the left.
    """
    kind, x, y, below = (part[c].to_numpy().astype(np.int64) for c in ("kind", "x", "y", "below"))
    n = int(strip[-1]) + 1 if len(strip) else 0
    own = kind != 2
    top, bottom = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(top, strip[own], y[own])
    np.maximum.at(bottom, strip[own], y[own])
    # Distinct columns with targets of every strip, and each row's place among them.
    goal = np.flatnonzero(kind != 0)
    order = goal[np.lexsort((x[goal], strip[goal]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (strip[order][1:] != strip[order][:-1]) | (x[order][1:] != x[order][:-1])
    width = np.bincount(strip[order][fresh], minlength=n)
    before = np.cumsum(width) - width
    listed = x[order][fresh]
    place = np.zeros(len(part), np.int64)
    place[order] = np.cumsum(fresh) - 1 - before[strip[order]]
    # Queries of a strip without targets have no answer.
    asked = np.flatnonzero((kind == 0) & (width[strip] > 0))
    asked = asked[np.lexsort((x[asked], y[asked], strip[asked]))]
    wanted = np.unique(strip[asked])
    found = np.zeros(len(asked), np.int64)
    height = np.where(bottom >= top, bottom - top + 1, 0)
    a = 0
    while a < len(wanted):
        rows, most, b = 0, 0, a
        while b < len(wanted):
            rows, most = rows + height[wanted[b]], max(most, width[wanted[b]])
            if b > a and rows * most > cells:
                break
            b += 1
        some = wanted[a:b]
        at = slice(*np.searchsorted(strip[asked], [some[0], some[-1] + 1]))
        found[at] = _table_nearest(
            some, height[some], width[some], before[some], top, strip, kind, x, y, below, place, listed, asked[at])
        a = b
    return part.iloc[asked].assign(d2=found)


def _table_nearest(
    some: np.ndarray, height: np.ndarray, width: np.ndarray, before: np.ndarray, top: np.ndarray,
    strip: np.ndarray, kind: np.ndarray, x: np.ndarray, y: np.ndarray, below: np.ndarray,
    place: np.ndarray, listed: np.ndarray, asked: np.ndarray,
) -> np.ndarray:
    """``d2`` of the queries ``asked`` of the strips ``some``, see ``_strips_nearest``."""
    first = np.cumsum(height) - height
    far = 1 << 29  # farther than any pixel
    # Values of a later strip are larger, so that running maxima and minima stay within a strip.
    step = np.int64(1) << 32
    slot = np.full(int(strip[-1]) + 1, -1)
    slot[some] = np.arange(len(some))
    base = np.repeat(np.arange(len(some)) * step, height)
    above = np.repeat((base - far)[:, None], width.max(), axis=1)
    under = np.repeat((base + far)[:, None], width.max(), axis=1)
    i = np.flatnonzero((kind == 1) & (slot[strip] >= 0))
    s = slot[strip[i]]
    local = y[i] - top[strip[i]]
    above[first[s] + local, place[i]] = under[first[s] + local, place[i]] = s * step + local
    i = np.flatnonzero((kind == 2) & (slot[strip] >= 0))
    s = slot[strip[i]]
    up = s * step + np.where(y[i] < 0, -far, y[i] - top[strip[i]])
    down = s * step + np.where(below[i] < 0, far, below[i] - top[strip[i]])
    np.maximum.at(above, (first[s], place[i]), up)
    np.minimum.at(under, (first[s] + height[s] - 1, place[i]), down)
    here = (base + np.arange(len(base)) - np.repeat(first, height))[:, None]
    gap = np.minimum(here - np.maximum.accumulate(above, axis=0),
                     np.minimum.accumulate(under[::-1], axis=0)[::-1] - here)
    s = slot[strip[asked]]
    start = np.repeat(before, height)
    return _rows_nearest(first[s] + y[asked] - top[strip[asked]], x[asked],
                         lambda row, c: listed[start[row] + c], np.repeat(width - 1, height), gap)


def _strip_table(
    queries: DataFrame, targets: DataFrame, keys: list[str], strip_pixels: int
) -> DataFrame:
    """What the strips need, as ``_strips_nearest`` reads it: at most one row per query, per
    target, and per strip and column."""
    strip = strip_of(F.col("y"), F.col("w"), strip_pixels).alias("strip")
    place = [F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")]
    asked = queries.select(*keys, strip, *place)
    goal = targets.select(*keys, strip, *place)
    # A row per column with targets and strip with targets or queries of its group.
    held = goal.groupBy(*keys, "x", "strip").agg(F.min("y").alias("first"), F.max("y").alias("last"))
    wanted = held.select(*keys, "x").distinct().join(
        asked.select(*keys, "strip").distinct(), keys)
    order = Window.partitionBy(*keys, "x")
    span = (Window.unboundedPreceding, -1)
    edges = (
        held.unionByName(wanted, allowMissingColumns=True)
        .groupBy(*keys, "x", "strip").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("above", F.max("last").over(order.orderBy("strip").rowsBetween(*span)))
        .withColumn("below", F.min("first").over(order.orderBy(F.desc("strip")).rowsBetween(*span)))
        .filter("above IS NOT NULL OR below IS NOT NULL")
    )

    def rows(df: DataFrame, kind: int, y: str = "y", below: str = "-1L") -> DataFrame:
        return df.selectExpr(*keys, "strip", f"{kind} AS kind", "x", f"coalesce({y}, -1L) AS y",
                             f"coalesce({below}, -1L) AS below")

    return rows(asked, 0).unionByName(rows(goal, 1)).unionByName(
        rows(edges, 2, "above", "below"))


def nearest_edge(
    queries: DataFrame, targets: DataFrame, keys: list[str] | None = None,
    strip_pixels: int = STRIP_PIXELS, tasks: int | None = None,
) -> DataFrame:
    """Exact squared distance ``d2`` from each query pixel to its group's nearest target.

    A separable distance transform on strips, without rounds. Per column, the last target above
    and the first below each strip come from running maxima and minima over the strips; inside a
    strip one task finds the vertical gaps and then, per row, the best column. No step has more
    rows than the frames have pixels, no task more than a strip, wherever the targets lie. Queries
    of a group without targets are dropped. Frames may have up to 2^20 rows and columns.
    """
    keys = keys or ["image_id"]
    together = _strip_table(queries, targets, keys, strip_pixels)
    group = [*keys, "strip"]
    kinds = dict(together.dtypes)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame[group].to_numpy()
        strip = np.concatenate(([0], np.cumsum((rows[1:] != rows[:-1]).any(axis=1))))
        return _strips_nearest(frame, strip)[[*keys, "x", "y", "d2"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x bigint", "y bigint", "d2 bigint"])
    return whole_groups(together, group, [], work, schema, tasks)


def chamfer(
    edges: DataFrame, images: DataFrame, strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    """Symmetric mean nearest-edge distance per image of ``images``, 0 if either side is empty.

    ``edges`` holds ``ref_edge``/``out_edge`` flags; both directions run in the same rounds.
    """
    def side(flag: str, direction: int) -> DataFrame:
        return edges.filter(flag).select(
            "image_id", F.lit(direction).alias("dir"), "x", "y", "w", "h")

    queries = side("ref_edge", 0).unionByName(side("out_edge", 1))
    targets = side("out_edge", 0).unionByName(side("ref_edge", 1))
    near = nearest_edge(queries, targets, ["image_id", "dir"], strip_pixels, tasks)
    d = F.sqrt(F.col("d2").cast("double"))
    means = near.groupBy("image_id").agg(
        F.avg(F.when(F.col("dir") == 0, d)).alias("c1"),
        F.avg(F.when(F.col("dir") == 1, d)).alias("c2"),
    )
    value = F.bround((F.coalesce("c1", F.lit(0.0)) + F.coalesce("c2", F.lit(0.0))) / 2, 2)
    return images.select("image_id").join(means, "image_id", "left").select(
        "image_id", value.alias("chamfer")
    )


def evaluate(
    source: DataFrame, rendered: DataFrame, palettes: DataFrame, strip_pixels: int = STRIP_PIXELS,
    tasks: int | None = None,
) -> DataFrame:
    """Sample metrics of a corpus: IoU columns, Chamfer and whether the masks are identical."""
    pairs = store(label_pairs(source, rendered, palettes, strip_pixels, tasks))
    table = checkpoint(contingency(pairs))
    masks = mask_iou(table, pair_palettes(table, palettes))
    images = table.select("image_id").distinct()
    return (
        sample_iou(table, masks)
        .join(chamfer(store(edge_pair(pairs, strip_pixels, tasks)), images, strip_pixels, tasks), "image_id")
        .join(identical_masks(table), "image_id")
    )


def evaluate_corpus(
    source: DataFrame, variants: dict[str, DataFrame], palettes: DataFrame, nodes: DataFrame,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """``evaluate`` for every variant of the renderings: one row per image and variant, with the
    image's size, the number of its colours, the trace's ``nodes`` and the degenerate flag.

    ``variants`` names a handful of settings; every one is a pass over the whole corpus. Images that a
    variant did not render have a row without measures.
    """
    source, palettes = store(source), store(palettes)
    tasks = tasks_for(source.sparkSession, source.count())
    facts = (
        source.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
        .join(palettes.select("image_id", F.size("palette").cast("bigint").alias("n_colors")), "image_id")
        .join(nodes, "image_id", "left"))
    out: DataFrame | None = None
    for name, rendered in variants.items():
        rows = facts.join(
            evaluate(source, rendered, palettes, strip_pixels, tasks), "image_id", "left"
        ).select(
            "image_id", F.lit(name).alias("variant"), "w", "h", "n_colors", "nodes", "iou_mean",
            "iou_worst", "iou_aw", "iou_bg", "iou_unmatched", "chamfer",
            (F.col("identical") & (F.col("nodes") > 0)).alias("degenerate"))
        out = rows if out is None else out.unionByName(rows)
    return out


def self_test(
    labels: DataFrame, palettes: DataFrame, strip_pixels: int = STRIP_PIXELS
) -> DataFrame:
    """Invariants per image: a raster matches itself, and a one-pixel shift is noticed.

    Both comparisons run the same contingency, pairing, IoU and edge operators as ``evaluate``.
    """
    here = labels.select("image_id", "x", "y", "w", "h", "slot")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    shifted = here.withColumn("moved", F.coalesce(F.lead("slot").over(row), F.col("slot")))
    near = store(neighbour_join(shifted, ["slot", "moved"], strip_pixels))

    def iou(out: str, name: str) -> DataFrame:
        table = store(contingency(near.select(
            "image_id", F.col("slot").alias("ref_slot"), F.col(out).alias("out_slot"))))
        masks = mask_iou(table, pair_palettes(table, palettes))
        return sample_iou(table, masks).select("image_id", F.col("iou_mean").alias(name))

    edges = store(near.select(
        "image_id", "x", "y", "w", "h",
        differs("slot").alias("ref_edge"), differs("moved").alias("out_edge"),
    ))
    base = edges.filter("ref_edge").select("image_id", "x", "y", "w", "h")
    moved = edges.filter("out_edge").select("image_id", "x", "y", "w", "h")

    def mean(targets: DataFrame, name: str) -> DataFrame:
        d = F.sqrt(F.col("d2").cast("double"))
        return nearest_edge(base, targets, strip_pixels=strip_pixels).groupBy("image_id").agg(
            F.avg(d).alias(name))

    images = edges.groupBy("image_id").agg(F.count_if("ref_edge").alias("n_edges"))
    zero = F.lit(0.0)
    return (
        images.join(mean(base, "self"), "image_id", "left")
        .join(mean(moved, "shift"), "image_id", "left")
        .join(iou("slot", "iou_mean"), "image_id")
        .join(iou("moved", "shift_iou"), "image_id")
        .select(
            "image_id", "n_edges", "iou_mean",
            F.bround(F.coalesce("self", zero), 2).alias("chamfer"), "shift_iou",
            F.coalesce("shift", zero).alias("shift_chamfer"),
        )
        .withColumn("passed", (F.col("iou_mean") > 0.999) & (F.col("chamfer") < 0.01)
                    & ((F.col("n_edges") == 0) | (F.col("shift_chamfer") > 0.01)))
    )
