"""Connected regions of label rasters, their shape statistics, and disk snapping.

Regions are kept as runs (maximal horizontal stretches of one colour), which is what their
statistics need; ``region_pixels`` expands them again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.colour import Rgb
from inkloom.operators import palette as P
from inkloom.plans.spread import (
    STRIP_PIXELS, checkpoint, strip_of, whole_groups, with_halo,
)

WHITE_MIN = 250
WHITE_CODE = 0xFFFFFF
OPENING_HALO = 4
# Fixed value: a region's ring begins at this share of its radius.
RING_FROM = 0.88


def colour_code(c: Rgb) -> Column:
    return (c.r * 65536 + c.g * 256 + c.b).cast("bigint")


def with_ink_code(labels: DataFrame) -> DataFrame:
    """``image_id, x, y, w, h, c`` with the packed colour, null on white pixels."""
    white = F.least(*P.px()) >= WHITE_MIN
    return labels.select("image_id", *(F.col(k).cast("bigint").alias(k) for k in ("x", "y", "w", "h")),
                         F.when(~white, colour_code(P.px())).alias("c"))


def binary_opening(
    coded: DataFrame, strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    """Pixels that survive opening their own colour's mask by the radius-2 diamond.

    A diamond splits into row stretches (5, 3 and 1 pixels wide), so erosion and dilation each
    take one pass along rows and one along columns. All four passes run inside a strip that
    carries four copied rows on each side. Outside the frame counts as background. For ``tasks``
    see ``with_halo``.
    """
    placed = with_halo(coded, OPENING_HALO, strip_pixels, tasks)
    row = Window.partitionBy("image_id", "strip", "y").orderBy("x")
    col = Window.partitionBy("image_id", "strip", "x").orderBy("y")

    def beside(name: str, k: int, w) -> tuple[Column, Column]:
        return F.lag(name, k).over(w), F.lead(name, k).over(w)

    def both_same(k: int, w) -> Column:
        before, after = beside("c", k, w)
        return F.coalesce((before == F.col("c")) & (after == F.col("c")), F.lit(False))

    stretched = placed.withColumn("s3", both_same(1, row)).withColumn(
        "s5", F.col("s3") & both_same(2, row))
    up3, down3 = beside("s3", 1, col)
    kept = (
        F.col("s5") & both_same(1, col) & both_same(2, col)
        & F.coalesce(up3 & down3, F.lit(False))
    )
    eroded = stretched.withColumn("e", F.when(kept, F.col("c"))).drop("s3", "s5")
    l1, r1 = beside("e", 1, row)
    l2, r2 = beside("e", 2, row)
    # An eroded pixel owns the five pixels around it, so at most one colour can be near.
    spread = eroded.withColumn("e3", F.coalesce("e", l1, r1)).withColumn(
        "e5", F.coalesce("e", l1, r1, l2, r2))
    u3, d3 = beside("e3", 1, col)
    u1, d1 = beside("e", 2, col)
    near = [F.coalesce(v == F.col("c"), F.lit(False)) for v in (F.col("e5"), u3, d3, u1, d1)]
    opened = near[0] | near[1] | near[2] | near[3] | near[4]
    return (
        spread.withColumn("opened", opened)
        .filter(F.col("own") & F.col("opened"))
        .select("image_id", "x", "y", "w", "h", "c")
    )


# --- connected components -----------------------------------------------------------------

RUN_SCHEMA = (
    "image_id bigint, strip bigint, own boolean, y bigint, x0 bigint, x1 bigint, "
    "w bigint, h bigint, c bigint, local bigint"
)


def _runs(mask: DataFrame, strip_pixels: int, tasks: int | None) -> DataFrame:
    """Runs per strip; each strip also holds a copy of the row above its first one."""
    placed = with_halo(mask, 1, strip_pixels, tasks)
    line = Window.partitionBy("image_id", "strip", "y").orderBy("x")
    starts = ~F.coalesce(
        (F.lag("x").over(line) == F.col("x") - 1) & (F.lag("c").over(line) == F.col("c")),
        F.lit(False),
    )
    above_or_own = F.col("own") | (
        strip_of(F.col("y"), F.col("w"), strip_pixels) < F.col("strip"))
    return (
        placed.filter(above_or_own & F.col("c").isNotNull())
        .withColumn("starts", starts)
        .withColumn("x0", F.max(F.when(F.col("starts"), F.col("x"))).over(line))
        .groupBy("image_id", "strip", "own", "y", "x0", "w", "h", "c")
        .agg(F.max("x").alias("x1"))
        .select("image_id", "strip", "own", "y", "x0", "x1", "w", "h", "c")
    )


def _touching(line: np.ndarray, below: np.ndarray, x0: np.ndarray, x1: np.ndarray):
    """Index pairs (run, run in the next line) that share a column."""
    width = int(x1.max()) + 2
    lo = np.searchsorted(line * width + x1, below * width + x0, "left")
    hi = np.searchsorted(line * width + x0, below * width + x1, "right")
    count = np.where(below >= 0, hi - lo, 0)
    upper = np.repeat(np.arange(len(line)), count)
    skipped = np.repeat(np.cumsum(count) - count, count)
    return upper, np.arange(len(upper)) - skipped + np.repeat(lo, count)


def _label_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """Component of each run of some whole strips, named by its first pixel's position."""
    image, strip, y, x0, x1, c, w = (
        runs[k].to_numpy() for k in ("image_id", "strip", "y", "x0", "x1", "c", "w"))
    n = len(runs)
    new_strip = np.r_[True, (image[1:] != image[:-1]) | (strip[1:] != strip[:-1])]
    new_line = new_strip | np.r_[True, y[1:] != y[:-1]]
    line = np.cumsum(new_line) - 1
    first = np.flatnonzero(new_line)
    follows = np.r_[(~new_strip[first][1:]) & (y[first][1:] == y[first][:-1] + 1), False]
    below = np.where(follows[line], line + 1, -1)
    a, b = _touching(line, below, x0, x1)
    same = c[a] == c[b]
    a, b = a[same], b[same]
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return runs.assign(local=y[label] * w[label] + x0[label])


def _merge_strips(labelled: DataFrame) -> DataFrame | None:
    """``image_id, strip, local, region`` for components that cross strips, None if none do.

    Works on the few components that touch a strip border: smallest-label propagation with
    pointer jumping, one checkpoint per round.
    """
    node = F.struct("local", "strip")
    upper = labelled.filter("own").select("image_id", "y", "x0", "c", node.alias("u"))
    lower = labelled.filter(~F.col("own")).select("image_id", "y", "x0", "c", node.alias("v"))
    links = checkpoint(upper.join(lower, ["image_id", "y", "x0", "c"])
                       .select("image_id", "u", "v").distinct())
    if links.isEmpty():
        return None
    both = links.unionByName(links.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
    state = checkpoint(both.select("image_id", "u").distinct().withColumn("l", F.col("u")))
    while True:
        near = (
            both.join(state.select("image_id", F.col("u").alias("v"), "l"), ["image_id", "v"])
            .groupBy("image_id", "u").agg(F.min("l").alias("m"))
        )
        hooked = state.join(near, ["image_id", "u"]).select(
            "image_id", "u", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        jump = hooked.select("image_id", F.col("u").alias("l"), F.col("l").alias("j"))
        moved = checkpoint(hooked.join(jump, ["image_id", "l"]).select(
            "image_id", "u", F.least("l", "j").alias("l"), "old"))
        state = moved.drop("old")
        if moved.filter(F.col("l") != F.col("old")).isEmpty():
            return state.select(
                "image_id", F.col("u.strip").alias("strip"), F.col("u.local").alias("local"),
                F.col("l.local").alias("region"))


def connected_components(
    mask: DataFrame, strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    """4-connected regions per colour as runs: ``image_id, c, region, strip, y, x0, x1, w, h``.

    ``region`` is the row-major position of the region's first pixel. ``mask`` has a colour
    code ``c`` per pixel; pixels that are absent or null belong to no region. For ``tasks`` see
    ``with_halo``.
    """
    labelled = checkpoint(whole_groups(
        _runs(mask, strip_pixels, tasks), ["image_id", "strip"], ["y", "x0"], _label_runs, RUN_SCHEMA, tasks))
    crossing = _merge_strips(labelled)
    own = labelled.filter("own")
    if crossing is None:
        named = own.withColumn("region", F.col("local"))
    else:
        named = own.join(crossing, ["image_id", "strip", "local"], "left").withColumn(
            "region", F.coalesce("region", "local"))
    return named.select("image_id", "c", "region", "strip", "y", "x0", "x1", "w", "h")


def region_pixels(regions: DataFrame) -> DataFrame:
    return regions.select("image_id", "c", "region", "strip", "y", "w", "h",
                          F.explode(F.sequence("x0", "x1")).alias("x"))


# --- region statistics and disks ----------------------------------------------------------


def _disk_area(cx: Column, cy: Column, r: Column, w: Column, h: Column) -> Column:
    """Frame pixels within ``r`` of the centre, counted row by row."""
    top = F.greatest(F.ceil(cy - r), F.lit(0).cast("bigint"))
    bottom = F.least(F.floor(cy + r), h - 1)

    def in_row(y: Column) -> Column:
        half = F.sqrt(F.greatest(r * r - (y - cy) * (y - cy), F.lit(0.0)))
        left = F.greatest(F.ceil(cx - half), F.lit(0).cast("bigint"))
        right = F.least(F.floor(cx + half), w - 1)
        return F.greatest(right - left + 1, F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(top, bottom), F.lit(0).cast("bigint"),
                       lambda acc, y: acc + in_row(y))


def _disk_row(cx: Column, r: Column, dy2: Column) -> tuple[Column, Column]:
    """First and last column within ``r`` of the centre in a row at squared distance ``dy2``, which
    is at most r^2. The root's rounding is mended by the test itself."""
    half = F.sqrt(F.greatest(r * r - dy2, F.lit(0.0)))

    def inside(x: Column) -> Column:
        return (x - cx) * (x - cx) + dy2 <= r * r

    def end(x: Column, out: int) -> Column:
        return F.when(inside(x + out), x + out).when(inside(x), x).otherwise(x - out)

    return end(F.ceil(cx - half), -1), end(F.floor(cx + half), 1)


def ring_stretch() -> Column:
    """Columns of a run that may lie in its region's ring: the run clipped against the circle inside
    the ring (edge included), so that nothing else is expanded."""
    inner = F.col("radius") * RING_FROM
    dy2 = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    i0, i1 = _disk_row(F.col("cx"), inner, dy2)
    crossed = dy2 < inner * inner
    x0, x1 = F.col("x0"), F.col("x1")
    none = F.array().cast("array<bigint>")

    def stretch(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(none)

    return F.when(crossed & (i0 < i1), F.concat(
        stretch(x0, F.least(x1, i0)), stretch(F.greatest(x0, i1), x1))).otherwise(stretch(x0, x1))


def region_stats(
    regions: DataFrame, *, min_area_frac: float = 0.06, max_aspect: float = 1.22,
    min_radius: float = 16, min_ring: int = 40, max_radius_cv: float = 0.09,
    min_disk_fill: float = 0.80,
) -> DataFrame:
    """Area, box, ring spread and disk fill per region, and the verdict ``is_disk``.

    Ring statistics need pixels, those of the ring only; they are computed where area, aspect and
    radius already allow a disk, and are null elsewhere.
    """
    bw, bh = F.col("bx1") - F.col("bx0") + 1, F.col("by1") - F.col("by0") + 1
    boxes = (
        regions.groupBy("image_id", "c", "region")
        .agg(
            F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
            F.min("x0").alias("bx0"), F.max("x1").alias("bx1"),
            F.min("y").alias("by0"), F.max("y").alias("by1"),
            F.min("strip").alias("_s0"), F.max("strip").alias("_s1"),
            F.max("w").alias("w"), F.max("h").alias("h"),
        )
        .withColumn("aspect", F.greatest(bw, bh) / F.greatest(F.lit(1), F.least(bw, bh)))
        .withColumn("radius", F.least(bw, bh) / F.lit(2.0) * F.lit(0.99))
        .withColumn("cx", (F.col("bx0") + F.col("bx1")) / F.lit(2.0))
        .withColumn("cy", (F.col("by0") + F.col("by1")) / F.lit(2.0))
        .withColumn("candidate", (F.col("area") >= F.col("w") * F.col("h") * min_area_frac)
                    & (F.col("aspect") <= max_aspect) & (F.col("radius") >= min_radius))
    )
    key = ["image_id", "c", "region"]
    centres = boxes.filter("candidate").select(
        *key, "cx", "cy", "radius", F.explode(F.sequence("_s0", "_s1")).alias("strip"))
    pixels = regions.join(centres, [*key, "strip"]).select(
        *key, "y", "cx", "cy", "radius", F.explode(ring_stretch()).alias("x"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rings = (
        pixels.withColumn("d", F.sqrt(dx * dx + dy * dy))
        .filter(F.col("d") >= F.col("radius") * RING_FROM)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("ring_px"),
             (F.stddev_pop("d") / (F.avg("d") + 1e-6)).alias("ring_cv"))
    )
    fill = F.when(F.col("candidate"), F.col("area") / F.nullif(_disk_area(
        F.col("cx"), F.col("cy"), F.col("radius"), F.col("w"), F.col("h")), F.lit(0)))
    verdict = (
        F.col("candidate") & (F.col("ring_px") >= min_ring)
        & (F.col("ring_cv") <= max_radius_cv) & (F.col("fill") >= min_disk_fill)
    )
    return (
        boxes.join(rings, key, "left")
        .withColumn("fill", fill)
        .withColumn("is_disk", F.coalesce(verdict, F.lit(False)))
        .drop("_s0", "_s1")
    )


def disk_bands(stats: DataFrame) -> DataFrame:
    """``image_id, y, bands``: for each row that a disk reaches, the disks' intervals there in the order
    in which they act: ``x0..x1`` is painted, ``u0..u1`` is cleared of the own colour. Rows that are
    cleared only have x0 > x1. An image has at most ``1 / min_area_frac`` disks."""
    reach = F.col("radius") * 1.05
    rows = stats.filter("is_disk").select(
        "image_id", "c", "region", "cx", "cy", "radius", reach.alias("reach"), F.explode(F.sequence(
            F.greatest(F.ceil(F.col("cy") - reach), F.lit(0).cast("bigint")),
            F.least(F.floor(F.col("cy") + reach), F.col("h") - 1))).alias("y"))
    dy2 = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    x0, x1 = _disk_row(F.col("cx"), F.col("radius"), dy2)
    u0, u1 = _disk_row(F.col("cx"), F.col("reach"), dy2)
    painted = dy2 <= F.col("radius") * F.col("radius")
    none = F.lit(None).cast("bigint")
    band = F.struct("c", "region", F.when(painted, x0).otherwise(none).alias("x0"),
                    F.when(painted, x1).otherwise(none).alias("x1"), u0.alias("u0"), u1.alias("u1"))
    return rows.filter(dy2 <= F.col("reach") * F.col("reach")).groupBy("image_id", "y").agg(
        F.array_sort(F.collect_list(band)).alias("bands"))


def label_runs(labels: DataFrame, extra: list[str], tasks: int | None = None) -> DataFrame:
    """Runs of a whole label raster: ``image_id, y, x0, x1, w, h, c`` and the columns ``extra``. ``tasks``
    names the number of tasks."""
    labels = labels.repartition(tasks, "image_id", "y") if tasks else labels
    line = Window.partitionBy("image_id", "y").orderBy("x")
    same = (F.lag("x").over(line) == F.col("x") - 1)
    for k in ("c", *extra):
        same = same & F.lag(k).over(line).eqNullSafe(F.col(k))
    coded = labels.select(
        "image_id", *(F.col(k).cast("bigint").alias(k) for k in ("x", "y", "w", "h")),
        colour_code(P.px()).alias("c"), *extra)
    return (
        coded.withColumn("_starts", ~F.coalesce(same, F.lit(False)))
        .withColumn("x0", F.max(F.when(F.col("_starts"), F.col("x"))).over(line))
        .groupBy("image_id", "y", "x0", "w", "h", "c", *extra).agg(F.max("x").alias("x1"))
    )


def snapped_runs(labels: DataFrame, stats: DataFrame, tasks: int | None = None) -> DataFrame:
    """Runs of the label raster with regions judged to be disks replaced by true disks.

    Disks act in order of colour, then of position: the region's own colour within 1.05 radii is
    cleared to white, the disk is painted, and what was white stays white. All three are
    differences of intervals: a run is cut where an interval of its row begins or ends, and every
    piece takes the colour that the last interval over it gives. Alpha (a column ``a``, if there is one) is
    that of the source.
    """
    extra = ["a"] if "a" in labels.columns else []
    runs = label_runs(labels, extra, tasks).join(disk_bands(stats), ["image_id", "y"], "left")
    white_code = F.lit(WHITE_CODE).cast("bigint")
    white = F.least(F.shiftright("c", 16), F.shiftright("c", 8).bitwiseAND(255),
                    F.col("c").bitwiseAND(255)) >= WHITE_MIN

    def colour(x: Column) -> Column:
        def act(now: Column, k: Column) -> Column:
            painted = F.coalesce((k["x0"] <= x) & (x <= k["x1"]), F.lit(False))
            cleared = (k["u0"] <= x) & (x <= k["u1"]) & (F.col("c") == k["c"])
            return F.when(painted & white, white_code).when(painted, k["c"]).when(
                cleared, white_code).otherwise(now)

        return F.aggregate("bands", F.col("c"), act)

    ends = F.flatten(F.transform("bands", lambda k: F.array(
        k["x0"], k["x1"] + 1, k["u0"], k["u1"] + 1)))
    cuts = F.array_sort(F.array_distinct(F.concat(
        F.array("x0"), F.filter(ends, lambda x: (x > F.col("x0")) & (x <= F.col("x1"))))))
    pieces = F.transform("cuts", lambda x, i: F.struct(
        x.alias("x0"), F.coalesce(F.get("cuts", i + 1) - 1, F.col("x1")).alias("x1"), colour(x).alias("c")))
    whole = F.array(F.struct("x0", "x1", "c"))
    return runs.withColumn("cuts", cuts).withColumn(
        "piece", F.explode(F.when(F.col("bands").isNull(), whole).otherwise(pieces))).select(
        "image_id", "y", "w", "h", *extra, "piece.x0", "piece.x1", "piece.c")


def snap_disks(labels: DataFrame, stats: DataFrame, tasks: int | None = None) -> DataFrame:
    """The label raster with disks snapped, pixel by pixel; see ``snapped_runs``."""
    extra = ["a"] if "a" in labels.columns else []
    pixels = snapped_runs(labels, stats, tasks).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return pixels.select(
        "image_id", "x", "y", "w", "h", F.shiftright("c", 16).alias("r"),
        F.shiftright("c", 8).bitwiseAND(255).alias("g"), F.col("c").bitwiseAND(255).alias("b"), *extra)
