"""Outline measures and simplification over vertex tables.

A vertex row is ``path_id, ring, seq, x, y`` with ``seq`` dense from 0. An outline may have any
number of vertices: rows are addressed by (ring, block of ``seq``), and what a ring's rows
need to know about their ring reaches them through a join on that pair.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.colour import let
from inkloom.functions.svg import svg_d_extract, svg_d_replace
from inkloom.operators.jumps import bends, kept_by_jumps
from inkloom.operators.short_paths import ARITY, SAMPLES, TOKEN, followed
from inkloom.plans.spread import checkpoint, int_div, join_large, number_rows, store, tasks_for, whole_groups

# Fixed values.
RDP_EPSILON = 1.25
COLLINEAR_COS = 0.998
ARC_MAX_REL_ERR = 0.08
ARC_MIN_POINTS = 8
CLOSE_TOLERANCE = 0.5
SAME_POINT = 1e-6

KEYS = ["path_id", "ring"]
BLOCK = 4096
CHUNK = 1024
TOKENS = 512
# Characters of a token at most, in a path that is followed whole.
TOKEN_CHARS = 8
SMALL_SEGMENT = 1 << 17


def _norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _block(seq: Column | str, size: int = BLOCK) -> Column:
    return int_div(F.col(seq) if isinstance(seq, str) else seq, size)


def attach_ring_facts(
    points: DataFrame, facts: DataFrame, first: Column | int = 0, last: Column | str = "n",
    on: list[str] | None = None,
) -> DataFrame:
    """Join per-ring ``facts`` to vertices by (ring, block); ``first``..``last`` bound ``seq``."""
    on = on or KEYS
    low = F.lit(first) if isinstance(first, int) else first
    high = F.col(last) if isinstance(last, str) else last
    spread = facts.withColumn("_blk", F.explode(F.sequence(_block(low), _block(high))))
    return join_large(points.withColumn("_blk", _block("seq")), spread, [*on, "_blk"]).drop("_blk")


def with_next(points: DataFrame) -> DataFrame:
    """Each vertex with its successor ``nx, ny``; the last vertex of a ring has none."""
    home = _block("seq")
    places = F.array_compact(F.array(
        home, F.when((F.col("seq") % BLOCK == 0) & (F.col("seq") > 0), home - 1)))
    order = Window.partitionBy(*KEYS, "_blk").orderBy("seq")
    return (
        points.withColumn("_home", home).withColumn("_blk", F.explode(places))
        .withColumn("nx", F.lead("x").over(order)).withColumn("ny", F.lead("y").over(order))
        .filter((F.col("_home") == F.col("_blk")) & F.col("nx").isNotNull())
        .drop("_home", "_blk")
    )


def _is_closed(first: Column, last: Column, tolerance: float) -> Column:
    return (F.abs(first["x"] - last["x"]) < tolerance) & (F.abs(first["y"] - last["y"]) < tolerance)


def ring_ends(points: DataFrame, tolerance: float = CLOSE_TOLERANCE) -> DataFrame:
    """Per ring: vertex count ``n``, first point ``p0`` and whether it is closed."""
    p = F.struct("x", "y")
    return points.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(p, "seq").alias("p0"),
        F.max_by(p, "seq").alias("_last"),
    ).withColumn("closed", _is_closed(F.col("p0"), F.col("_last"), tolerance)).drop("_last")


def ring_body(points: DataFrame) -> DataFrame:
    """Vertices without the repeated end of closed rings."""
    ends = ring_ends(points).select(*KEYS, "n", "closed")
    return attach_ring_facts(points, ends).filter(
        ~F.col("closed") | (F.col("seq") < F.col("n") - 1)).drop("n", "closed")


def ring_metrics(points: DataFrame) -> DataFrame:
    """Shoelace area, perimeter and circularity of each ring; the closing edge wraps around.

    One aggregation over consecutive pairs. The wrap needs only the first vertex and the last
    pair: in a closed ring the final pair, which leads to the repeated vertex, is exchanged for
    the edge back to the first one.
    """
    def cross(ax, ay, bx, by):
        return ax * by - bx * ay

    def length(ax, ay, bx, by):
        return _norm(bx - ax, by - ay)

    here = ("x", "y", "nx", "ny")
    pair = F.struct(*here)
    sums = with_next(points).groupBy(*KEYS).agg(
        F.sum(cross(*map(F.col, here))).alias("s"), F.sum(length(*map(F.col, here))).alias("p"),
        F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(pair, "seq").alias("z"),
        F.count(F.lit(1)).alias("pairs"),
    )
    z, a = F.col("z"), F.col("a")
    closed = _is_closed(a, F.struct(z["nx"].alias("x"), z["ny"].alias("y")), CLOSE_TOLERANCE)
    last = (z["x"], z["y"], z["nx"], z["ny"])
    back_closed = (z["x"], z["y"], a["x"], a["y"])
    back_open = (z["nx"], z["ny"], a["x"], a["y"])

    def total(name: str, f) -> Column:
        return F.when(closed, F.col(name) - f(*last) + f(*back_closed)).otherwise(
            F.col(name) + f(*back_open))

    return (
        sums.select(
            *KEYS, closed.alias("closed"),
            (F.col("pairs") + 1 - closed.cast("int")).alias("n_points"),
            (F.abs(total("s", cross)) / 2).alias("area"), total("p", length).alias("perimeter"),
        )
        .withColumn("circularity", F.lit(4.0) * F.pi() * F.col("area")
                    / F.nullif(F.col("perimeter") * F.col("perimeter"), F.lit(0.0)))
    )


def fit_circle(points: DataFrame) -> DataFrame:
    """Algebraic circle fit per ring: ``cx, cy, r``, only where the fit is accepted."""
    means = points.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.max("seq").alias("last"),
    ).filter(F.col("n") >= ARC_MIN_POINTS)
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    powers = {"uu": u * u, "vv": v * v, "uv": u * v, "uuu": u * u * u, "vvv": v * v * v,
              "uuv": u * u * v, "uvv": u * v * v}
    moments = attach_ring_facts(points, means, last="last").groupBy(
        *KEYS, "n", "mx", "my", "last").agg(*(F.sum(e).alias(k) for k, e in powers.items()))
    m = {k: F.col(k) for k in powers}
    det = 2 * (m["uu"] * m["vv"] - m["uv"] * m["uv"])
    du, dv = m["uuu"] + m["uvv"], m["vvv"] + m["uuv"]
    fits = (
        moments.withColumn("det", det).filter(F.abs("det") >= 1e-9)
        .withColumn("uc", (m["vv"] * du - m["uv"] * dv) / F.col("det"))
        .withColumn("vc", (m["uu"] * dv - m["uv"] * du) / F.col("det"))
        .select(
            *KEYS, "n", "last",
            (F.col("uc") + F.col("mx")).alias("cx"), (F.col("vc") + F.col("my")).alias("cy"),
            F.sqrt(F.col("uc") * F.col("uc") + F.col("vc") * F.col("vc")
                   + (m["uu"] + m["vv"]) / F.col("n")).alias("r"),
        )
        .filter((F.col("r") >= 2) & (F.col("r") <= 1e6))
    )
    error = F.avg(F.abs(_norm(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")))
    return (
        attach_ring_facts(points, fits, last="last")
        .groupBy(*KEYS, "cx", "cy", "r").agg(error.alias("err"))
        .filter(F.col("err") / F.col("r") <= ARC_MAX_REL_ERR)
        .drop("err")
    )


def circle_candidates(
    points: DataFrame, canvas_area: float | None = None, min_circularity: float = 0.88,
    min_area_frac: float = 0.04,
) -> DataFrame:
    """Large, nearly circular paths of one closed ring with at least 12 vertices, with their fit."""
    counts = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_vertices"))
    rings = counts.groupBy("path_id").agg(F.count(F.lit(1)).alias("rings"))
    round_ = (
        join_large(join_large(ring_metrics(points), counts, KEYS), rings, "path_id")
        .filter((F.col("rings") == 1) & F.col("closed") & (F.col("n_vertices") >= 12))
        .filter((F.col("perimeter") >= 1e-6) & (F.col("area") >= 1e-6))
        .filter(F.col("circularity") >= min_circularity)
    )
    if canvas_area:
        round_ = round_.filter(F.col("area") / canvas_area >= min_area_frac)
    return join_large(round_.select(*KEYS, "area", "circularity"), fit_circle(ring_body(points)), KEYS)


# --- simplification -----------------------------------------------------------------------


def _split_small(active: pd.DataFrame, epsilon: float) -> pd.DataFrame:
    """Kept vertices of whole segments: every round splits all open segments at once."""
    x, y, ax, ay, bx, by = (active[c].to_numpy(float) for c in ("x", "y", "ax", "ay", "bx", "by"))
    segment = np.r_[0, np.cumsum((active[[*KEYS, "s"]].to_numpy()[1:]
                                  != active[[*KEYS, "s"]].to_numpy()[:-1]).any(axis=1))]
    row, keep = np.arange(len(active)), np.zeros(len(active), bool)
    while len(row):
        dx, dy = bx - ax, by - ay
        span = np.sqrt(dx * dx + dy * dy)
        off = np.abs(dy * x[row] - dx * y[row] + bx * ay - by * ax) / np.where(span == 0, 1.0, span)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        which = np.cumsum(np.r_[True, segment[1:] != segment[:-1]]) - 1
        top = np.maximum.reduceat(off, first)
        at = np.flatnonzero(off == top[which])
        at = at[np.r_[True, which[at][1:] != which[at][:-1]]]
        keep[row[at[top > epsilon]]] = True
        m = at[which]
        here = np.arange(len(row))
        stay = (top[which] > epsilon) & (here != m)
        left = here < m
        ax, ay = np.where(left, ax, x[row[m]])[stay], np.where(left, ay, y[row[m]])[stay]
        bx, by = np.where(left, x[row[m]], bx)[stay], np.where(left, y[row[m]], by)[stay]
        segment, row = (2 * which + ~left)[stay], row[stay]
    return active.loc[keep, [*KEYS, "seq", "x", "y"]]


def _split_rounds(active: DataFrame, largest: int, epsilon: float) -> DataFrame:
    """Vertices kept by recursive farthest-point splitting of independent segments.

    ``active`` has one row per interior vertex with its open segment: start ``s``, end ``e``
    and their coordinates ``ax, ay, bx, by``. Segments longer than SMALL_SEGMENT are split by
    distributed rounds, all of them in the same round; the pieces that fit are finished
    where they are, many per batch. ``largest`` bounds the longest segment at the start.
    """
    columns = [*KEYS, "seq", "x", "y", "s", "e", "ax", "ay", "bx", "by"]
    active = active.select(*columns)
    fits = F.col("e") - F.col("s") <= SMALL_SEGMENT
    kept: list[DataFrame] = []
    small = [active if largest <= SMALL_SEGMENT else active.filter(fits)]
    active = active.filter(~fits)
    while largest > SMALL_SEGMENT:
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        span = _norm(dx, dy)
        off = F.abs(dy * F.col("x") - dx * F.col("y") + F.col("bx") * F.col("ay")
                    - F.col("by") * F.col("ax")) / F.when(span == 0, 1.0).otherwise(span)
        far = F.struct(off.alias("d"), (-F.col("seq")).alias("k"))
        splits = (
            active.groupBy(*KEYS, "s")
            .agg(F.max_by(F.struct("seq", "x", "y"), far).alias("m"), F.max(off).alias("d"),
                 F.max("e").alias("_e"))
            .filter(F.col("d") > epsilon)
            .select(*KEYS, "s", "m", "_e")
        )
        joined = attach_ring_facts(active, splits, F.col("s"), "_e", [*KEYS, "s"])
        m, seq = F.col("m"), F.col("seq")
        left = seq < m["seq"]
        state = checkpoint(joined.select(
            *KEYS, "seq", "x", "y", (seq == m["seq"]).alias("split"),
            F.when(left, F.col("s")).otherwise(m["seq"]).alias("s"),
            F.when(left, m["seq"]).otherwise(F.col("e")).alias("e"),
            *(F.when(left, F.col(f"a{c}")).otherwise(m[c]).alias(f"a{c}") for c in "xy"),
            *(F.when(left, m[c]).otherwise(F.col(f"b{c}")).alias(f"b{c}") for c in "xy"),
        ))
        kept.append(state.filter("split").select(*KEYS, "seq", "x", "y"))
        rest = state.filter(~F.col("split")).select(*columns)
        small.append(rest.filter(fits))
        active = rest.filter(~fits)
        if active.isEmpty():
            break
    pieces = small[0]
    for p in small[1:]:
        pieces = pieces.unionByName(p)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(
        *KEYS, "seq", "x", "y").schema)
    done = whole_groups(pieces, [*KEYS, "s"], ["seq"],
                        lambda pdf: _split_small(pdf, epsilon), schema)
    for k in kept:
        done = done.unionByName(k)
    return done


def _largest(facts: DataFrame, column: str) -> int:
    return facts.agg(F.max(column)).first()[0] or 0


def simplify_polyline(points: DataFrame, epsilon: float = RDP_EPSILON) -> DataFrame:
    """Farthest-point simplification of each ring between its first and last vertex."""
    p = F.struct("x", "y")
    ends = checkpoint(points.groupBy(*KEYS).agg(
        (F.count(F.lit(1)) - 1).alias("e"), F.min_by(p, "seq").alias("a"),
        F.max_by(p, "seq").alias("b")))
    placed = attach_ring_facts(points, ends, last="e")
    border = (F.col("seq") == 0) | (F.col("seq") == F.col("e"))
    inner = placed.filter(~border).select(
        *KEYS, "seq", "x", "y", F.lit(0).alias("s"), "e",
        F.col("a.x").alias("ax"), F.col("a.y").alias("ay"),
        F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    fixed = placed.filter(border).select(*KEYS, "seq", "x", "y")
    return fixed.unionByName(_split_rounds(inner, _largest(ends, "e"), epsilon))


def _renumber(points: DataFrame) -> DataFrame:
    """Dense ``seq`` after rows were dropped, keeping the order."""
    numbered = number_rows(points.withColumn("_blk", _block("seq")), KEYS, "_blk", ["seq"], "n")
    return numbered.select(*KEYS, F.col("i").alias("seq"), "x", "y", "n")


def _fold_chunk(own: Column, carry: Column, n: Column) -> Column:
    """Kept vertices of one chunk given the last kept vertex before it.

    ``own`` lists the chunk's vertices with their successors; the result also names the last
    kept vertex.
    """
    start = F.struct(carry.alias("at"), F.slice(F.array(carry), 1, 0).alias("kept"))

    def step(acc: Column, v: Column) -> Column:
        at = acc["at"]
        ux, uy = v["x"] - at["x"], v["y"] - at["y"]
        wx, wy = v["nx"] - v["x"], v["ny"] - v["y"]
        n1, n2 = _norm(ux, uy), _norm(wx, wy)
        bend = (n1 >= 1e-9) & (n2 >= 1e-9) & (
            (ux * wx + uy * wy) / F.nullif(n1 * n2, F.lit(0.0)) < COLLINEAR_COS)
        end = (v["seq"] == 0) | (v["seq"] == n - 1)
        here = F.struct(v["seq"].alias("seq"), v["x"].alias("x"), v["y"].alias("y"))
        return F.when(end | F.coalesce(bend, F.lit(False)), F.struct(
            here.alias("at"), F.concat(acc["kept"], F.array(here)).alias("kept"),
        )).otherwise(acc)

    return F.aggregate(own, start, step)


def collapse_collinear(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Drop vertices that continue the direction from the last kept vertex.

    Whether a vertex stays depends on the last one kept before it. Each chunk of a ring is first
    folded as if the vertex before the chunk had been kept, then once more from the last vertex that any
    earlier chunk kept, which also sees past chunks that keep nothing. Rings on which the chunks
    still disagree (long smooth arcs) are done by composing maps of chunks, see ``jumps``.
    """
    sized = points if "n" in points.columns else attach_ring_facts(
        points, points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")))
    seq = F.col("seq").cast("bigint")
    home = _block(seq, chunk)
    places = F.array_compact(F.array(
        home,
        F.when((seq % chunk == 0) & (seq > 0), home - 1),
        F.when((seq % chunk == chunk - 1) & (seq < F.col("n") - 1), home + 1),
    ))
    v = F.struct(seq.alias("seq"), F.col("x").cast("double").alias("x"),
                 F.col("y").cast("double").alias("y"))
    chunks = (
        sized.select(*KEYS, "n", v.alias("v"), F.explode(places).alias("blk"))
        .groupBy(*KEYS, "blk")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list("v")).alias("vs"))
    )
    low, high = F.col("blk") * chunk, (F.col("blk") + 1) * chunk
    linked = F.transform("vs", lambda e, i: e.withField("nx", F.get("vs", i + 1)["x"]).withField(
        "ny", F.get("vs", i + 1)["y"]))
    own = F.filter(linked, lambda e: (e["seq"] >= low) & (e["seq"] < high))
    state = chunks.select(*KEYS, "blk", "n", own.alias("own"),
                          F.get("vs", F.lit(0)).alias("carry"))
    state = checkpoint(state.withColumn("f", _fold_chunk(
        F.col("own"), F.col("carry"), F.col("n"))))
    earlier = Window.partitionBy(*KEYS).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)

    def with_true_carry(df: DataFrame) -> DataFrame:
        kept = F.col("f.kept")
        last = F.last(F.get(kept, F.size(kept) - 1), ignorenulls=True).over(earlier)
        differs = F.coalesce(last["seq"] != F.col("carry.seq"), F.lit(False))
        return df.withColumn("true", last).withColumn("wrong", differs)

    again = _fold_chunk(F.col("own"), F.col("true"), F.col("n"))
    state = checkpoint(with_true_carry(state).select(
        *KEYS, "blk", "n", "own", F.when(F.col("wrong"), F.col("true")).otherwise(F.col("carry"))
        .alias("carry"), F.when(F.col("wrong"), again).otherwise(F.col("f")).alias("f")))
    wrong = checkpoint(with_true_carry(state).filter("wrong").select(*KEYS).distinct())
    kept = join_large(state, wrong, KEYS, "left_anti").select(*KEYS, F.inline("f.kept"))
    if wrong.isEmpty():
        return kept
    rest = join_large(state, wrong, KEYS, "left_semi").select(*KEYS, "n", F.inline("own"))
    return kept.unionByName(kept_by_jumps(rest, COLLINEAR_COS))


def _straighten(frame: pd.DataFrame, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each vertex stays by the collinear rule, for whole rings that begin at the rows ``first``."""
    x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
    keep = np.zeros(len(frame), bool)
    keep[first] = keep[first + count - 1] = True
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    px, py = x[first], y[first]
    for k in range(1, int(count.max(initial=0)) - 1):
        m = int(np.searchsorted(-count, -(k + 1), side="left"))  # the rings that have a vertex behind this one
        at = first[:m] + k
        stays = bends(px[:m], py[:m], x[at], y[at], x[at + 1], y[at + 1], COLLINEAR_COS)
        keep[at[stays]] = True
        px[:m], py[:m] = np.where(stays, x[at], px[:m]), np.where(stays, y[at], py[:m])
    return keep


def _simplify_whole(frame: pd.DataFrame, epsilon: float, tolerance: float) -> pd.DataFrame:
    """``simplify_ring`` of whole rings, all rings of the frame side by side."""
    codes = frame[KEYS].to_numpy()
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
    n = np.diff(np.append(first, len(frame)))
    ring, seq = np.repeat(np.arange(len(first)), n), np.arange(len(frame)) - np.repeat(first, n)
    x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
    last = first + n - 1
    closed = (np.abs(x[first] - x[last]) < tolerance) & (np.abs(y[first] - y[last]) < tolerance) & (n >= 3)
    m = n - closed
    inside = seq < m[ring]
    dx, dy = x - x[first][ring], y - y[first][ring]
    d = np.where(inside & (seq > 0), dx * dx + dy * dy, -1.0)
    at = np.flatnonzero(d == np.maximum.reduceat(d, first)[ring])
    far = at[np.r_[True, ring[at][1:] != ring[at][:-1]]] - first
    tiny = m < 3
    left = seq < far[ring]
    fixed = inside & ((seq == 0) | (seq == far[ring]) | tiny[ring])
    inner = inside & ~fixed
    a, b = np.where(left, first[ring], (first + far)[ring])[inner], np.where(left, (first + far)[ring], first[ring])[inner]
    halves = frame[inner].assign(
        seq=seq[inner], s=np.where(left, 0, far[ring])[inner], ax=x[a], ay=y[a], bx=x[b], by=y[b])
    keep = fixed
    if len(halves):
        kept = _split_small(halves.set_index(np.flatnonzero(inner)), epsilon)
        keep[kept.index.to_numpy()] = True
    # The repeated end of a closed ring lies where its first vertex does.
    end = last[closed]
    keep[end] = True
    out = frame.assign(seq=seq, x=x, y=y)
    out.iloc[end, [out.columns.get_loc("x"), out.columns.get_loc("y")]] = np.stack([x, y], axis=1)[first[closed]]
    out, ring = out[keep].reset_index(drop=True), ring[keep]
    count = np.bincount(ring, minlength=len(first))
    first = np.cumsum(count) - count
    out["seq"] = np.arange(len(out)) - first[ring]
    return out[_straighten(out, first, count) | tiny[ring]][[*KEYS, "seq", "x", "y"]]


def simplify_ring(
    points: DataFrame, epsilon: float = RDP_EPSILON, tolerance: float = SAME_POINT
) -> DataFrame:
    """Simplify rings: split at the vertex farthest from the start, simplify both halves.

    The repeated end of a closed ring is put back afterwards; collinear vertices are dropped
    last. Open lines take the same split, their second half ending at the first vertex. Rings of up to a quarter
    of a block are dealt once and done whole, many at a time; longer ones, and those whose rows are
    not numbered from 0 or not finite, go by blocks.
    """
    kinds = dict(points.dtypes)
    if kinds["x"] != "double" or kinds["y"] != "double":
        return _simplify_by_blocks(points, epsilon, tolerance)
    n, seq = F.col("n"), F.col("seq").cast("double")
    fine = F.coalesce((F.abs("x") <= 1e100) & (F.abs("y") <= 1e100), F.lit(False))
    rings = points.groupBy(*KEYS).agg(
        F.count("seq").alias("n"), F.max("seq").alias("top"), F.sum(seq).alias("s"), F.sum(seq * seq).alias("ss"),
        F.min(fine).alias("fine"))
    whole = F.col("fine") & (n <= BLOCK // 4) & (F.col("top") == n - 1) & (F.col("s") == n * (n - 1) / 2) & (
        F.col("ss") == n * (n - 1) * (2 * n - 1) / 6)
    rings = store(rings.dropna(subset=KEYS).select(*KEYS, "n", F.coalesce(whole, F.lit(False)).alias("whole")))
    rows = rings.agg(F.sum("n")).first()[0] or 0
    rest = rings.filter("NOT whole").select(*KEYS)
    none = rest.isEmpty()
    cloudpickle.register_pickle_by_value(sys.modules[bends.__module__])
    small = points.dropna(subset=KEYS) if none else join_large(points.dropna(subset=KEYS), rest, KEYS, "left_anti")
    done = whole_groups(
        small.select(*KEYS, "seq", "x", "y"), KEYS, ["seq"], lambda frame: _simplify_whole(frame, epsilon, tolerance),
        ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", seq bigint, x double, y double",
        tasks_for(points.sparkSession, rows))
    return done if none else done.unionByName(
        _simplify_by_blocks(join_large(points, rest, KEYS, "left_semi"), epsilon, tolerance))


def _simplify_by_blocks(points: DataFrame, epsilon: float, tolerance: float) -> DataFrame:
    """``simplify_ring`` of rings of any length."""
    ends = checkpoint(ring_ends(points, tolerance).withColumn(
        "m", F.when(F.col("n") < 3, F.col("n")).otherwise(F.col("n") - F.col("closed").cast("int"))))
    placed = store(
        attach_ring_facts(points, ends).filter(F.col("seq") < F.col("m"))
        .select(*KEYS, F.col("seq").cast("bigint").alias("seq"), "x", "y", "n", "m", "closed", "p0"))
    tiny = F.col("m") < 3
    dx, dy = F.col("x") - F.col("p0.x"), F.col("y") - F.col("p0.y")
    far = (
        placed.filter(~tiny & (F.col("seq") > 0)).groupBy(*KEYS, "m").agg(F.max_by(
            F.struct("seq", "x", "y"),
            F.struct((dx * dx + dy * dy).alias("d"), (-F.col("seq")).alias("k"))).alias("far"))
    )
    halves = attach_ring_facts(placed.filter(~tiny).drop("m"), far, last="m")
    at, seq = F.col("far.seq"), F.col("seq")
    left = seq < at
    fixed = (seq == 0) | (seq == at)
    inner = halves.filter(~fixed).select(
        *KEYS, "seq", "x", "y",
        F.when(left, F.lit(0).cast("bigint")).otherwise(at).alias("s"),
        F.when(left, at).otherwise(F.col("m")).alias("e"),
        *(F.when(left, F.col(f"p0.{c}")).otherwise(F.col(f"far.{c}")).alias(f"a{c}") for c in "xy"),
        *(F.when(left, F.col(f"far.{c}")).otherwise(F.col(f"p0.{c}")).alias(f"b{c}") for c in "xy"),
    )
    kept = halves.filter(fixed).select(*KEYS, "seq", "x", "y").unionByName(
        _split_rounds(inner, _largest(ends, "m"), epsilon))
    again = placed.filter((seq == 0) & F.col("closed") & (F.col("n") >= 3)).select(
        *KEYS, F.col("m").alias("seq"), "x", "y", "m")
    merged = store(kept.unionByName(again.filter(~tiny).drop("m")))
    short = placed.filter(tiny).select(*KEYS, "seq", "x", "y").unionByName(
        again.filter(tiny).drop("m"))
    return collapse_collinear(_renumber(merged)).unionByName(
        short.withColumn("x", F.col("x").cast("double")).withColumn("y", F.col("y").cast("double")))


def _joined_blocks(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``line``: the texts ``t`` of a group in the order of ``seq``, and their number ``n_simple``.

    Texts are put together per block of rows and the blocks by their number, so until the last join
    a task holds blocks, however long a group is."""
    def joined(order: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(order, "t")))
        return F.array_join(F.transform(listed, lambda e: e["t"]), " ")

    blocks = parts.withColumn("_blk", _block("seq")).groupBy(*keys, "_blk").agg(
        F.count(F.lit(1)).alias("n"), joined("seq").alias("t"))
    return blocks.groupBy(*keys).agg(F.sum("n").alias("n_simple"), joined("_blk").alias("line"))


def _ring_texts(points: DataFrame, level: str) -> DataFrame:
    """``path_id, ring, t``: the path data of each simplified ring."""
    if level not in ("basic", "strict"):
        raise ValueError("level must be basic or strict")
    ends = ring_ends(points).filter(F.col("n") >= 2).select(*KEYS, "closed")
    simple = _renumber(store(simplify_ring(points, tolerance=CLOSE_TOLERANCE))).drop("n")
    step = F.format_string("%s %.2f %.2f", F.when(F.col("seq") == 0, "M").otherwise("L"), "x", "y")
    simple = store(simple) if level == "strict" else simple
    rings = join_large(_joined_blocks(simple.select(*KEYS, "seq", step.alias("t")), KEYS), ends, KEYS)
    poly = F.when(F.col("n_simple") < 2, "M 0 0 Z").otherwise(
        F.concat("line", F.when(F.col("closed"), " Z").otherwise("")))
    if level == "strict":
        body = attach_ring_facts(
            simple, rings.select(*KEYS, "closed", F.col("n_simple").alias("n")))
        body = body.filter((F.col("n") >= ARC_MIN_POINTS)
                           & ~(F.col("closed") & (F.col("seq") == F.col("n") - 1)))
        rings = join_large(rings, fit_circle(body.drop("closed", "n")), KEYS, "left")
        cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
        arcs = F.format_string(
            "M %.2f %.2f A %.2f %.2f 0 1 1 %.2f %.2f A %.2f %.2f 0 1 1 %.2f %.2f Z",
            cx + r, cy, r, r, cx - r, cy, r, r, cx + r, cy)
        poly = F.when(r.isNotNull(), arcs).otherwise(poly)
    return rings.select(*KEYS, poly.alias("t"))


def _joined_rings(texts: DataFrame, *key: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("ring", "t")))
    return texts.groupBy(*key).agg(
        F.array_join(F.transform(listed, lambda e: e["t"]), " ").alias("d"))


def normalize_paths(points: DataFrame, level: str = "basic") -> DataFrame:
    """Per path the rewritten path data ``d`` of its simplified rings, in ring order.

    ``basic`` writes polylines; ``strict`` writes two arcs for rings of at least eight
    simplified vertices that fit a circle. A ring's text is built from its own vertices.
    """
    return _joined_rings(_ring_texts(points, level), "path_id")


def normalize_documents(
    docs: DataFrame, level: str = "off", doc_id: str = "path_id", column: str = "svg"
) -> DataFrame:
    """SVG documents with all their path data rewritten, each in its place.

    ``level`` is ``basic`` or ``strict`` as in ``normalize_paths``; ``off``, and any other name, leaves the
    documents as they are. Path data without a ring of two vertices stays. All rings of a document are
    simplified side by side: they are rows of their own, keyed by path and ring.
    """
    if level not in ("basic", "strict"):
        return docs
    shift = 32
    rings = path_vertices(docs, doc_id, column).select(
        F.col(doc_id).alias("path_id"),
        F.shiftleft(F.col("path_no").cast("bigint"), shift).bitwiseOR(
            F.col("ring").cast("bigint")).alias("ring"),
        F.col("seq").cast("bigint").alias("seq"), "x", "y")
    paths = _joined_rings(
        _ring_texts(store(rings), level).withColumn("path_no", F.shiftright("ring", shift)),
        "path_id", "path_no")
    found = paths.groupBy(F.col("path_id").alias(doc_id)).agg(F.map_from_entries(
        F.collect_list(F.struct(F.col("path_no").cast("int"), "d"))).alias("_new"))
    return join_large(docs, found, doc_id, "left").withColumn(
        column, svg_d_replace(F.col(column), F.col("_new"))).select(docs.columns)


# --- path data to vertices ----------------------------------------------------------------

def _by_letter(letter: Column, values: dict, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(letter == k, v) if out is None else out.when(letter == k, v)
    return out.otherwise(default)


def _path_steps(paths: DataFrame, key: list[str]) -> DataFrame:
    """One row per drawing step with the token block ``blk`` in which it begins; ``bad`` is its place
    where it is malformed (a path ends before the first such place).

    Tokens are looked at in blocks; what a block needs from outside is the last command before it
    and the first token behind it, both from one row per block. A command is one number, its place
    and letter, so that aggregates over it need no sorting.
    """
    # Tokens are few bytes and much work: their tasks are not merged by size.
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_cmd = F.col("tok").rlike("^[A-Za-z]$")
    # Stored, as both sides of the join below read them and a text is costly to split.
    tokens = store(
        paths.select(*key, F.posexplode(F.regexp_extract_all(
            F.replace("d", F.lit(","), F.lit(" ")), F.lit(TOKEN), F.lit(1))).alias("pos", "tok"))
        .select(*key, _block("pos", TOKENS).alias("blk"), "pos", "tok", is_cmd.alias("is_cmd"))
    ).repartition(tasks, *key, "blk")
    place = F.col("pos").cast("bigint")
    command = F.when(F.col("is_cmd"), place * 128 + F.ascii("tok"))
    along = Window.partitionBy(*key).orderBy("blk")
    outside = tokens.groupBy(*key, "blk").agg(
        F.max(command).alias("last"), F.min(place * 2 + F.col("is_cmd").cast("int")).alias("first"),
    ).select(
        *key, "blk", (F.lead("first").over(along) % 2 == 1).alias("behind"),
        F.last("last", ignorenulls=True).over(
            along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = Window.partitionBy(*key, "blk").orderBy("pos")
    letter = F.lower("raw")
    arity = _by_letter(letter, ARITY, 1)
    k = F.col("pos") - F.col("cmd_pos") - 1
    bare = F.col("is_cmd") & (letter != "z") & F.col("next_cmd")
    wrong = (letter == "t") | bare | (~F.col("is_cmd") & (letter == "z"))
    steps = (
        join_large(tokens, outside, [*key, "blk"])
        .withColumn("cmd", F.coalesce(F.max(command).over(within), "before"))
        .withColumn("next_cmd", F.coalesce(F.lead("is_cmd").over(within), "behind", F.lit(True)))
        .withColumn("cmd_pos", F.coalesce(int_div(F.col("cmd"), 128), F.lit(-1)))
        .withColumn("raw", F.coalesce(F.chr(F.col("cmd") % 128), F.lit("M")))
        .withColumn("bad", F.when(wrong, F.col("pos")))
        .filter(~F.col("is_cmd") | (letter == "z") | F.col("bad").isNotNull())
        .withColumn("group", F.when(F.col("is_cmd"), -1).otherwise(int_div(k, arity)))
        .withColumn("arg", F.when(F.col("is_cmd"), 0).otherwise(k % arity))
        .withColumn("num", F.when(~F.col("is_cmd"), F.expr("try_cast(tok AS DOUBLE)")))
        # The block of a step's first token, which serves all that follows.
        .withColumn("blk", _block(F.when(F.col("is_cmd"), F.col("pos")).otherwise(
            F.col("cmd_pos") + 1 + F.col("group") * arity), TOKENS))
        .repartition(tasks, *key, "blk")
        .groupBy(*key, "blk", "cmd_pos", "group", "raw").agg(
            F.min("pos").alias("pos"), F.min("bad").alias("bad"), F.count("num").alias("cnt"),
            *(F.max(F.when(F.col("arg") == j, F.col("num"))).alias(f"a{j}") for j in range(7)))
        .withColumn("bad", F.when((F.col("group") >= 0) & (F.col("cnt") < arity), F.col("pos"))
                    .otherwise(F.col("bad")))
    )
    cmd = F.when((letter == "m") & (F.col("group") > 0), "l").otherwise(letter)
    return steps.select(
        *key, "blk", "pos", "bad", cmd.alias("cmd"),
        (F.col("raw") == F.lower("raw")).alias("rel"), *(f"a{j}" for j in range(7)))


#: What a moved point hangs on: nothing, the point at the block's entry, or the subpath's start there.
FIXED, POINT, START = 0, 1, 2


def _then(first: Column, second: Column) -> Column:
    """One axis of a map of (point, start), each ``base`` and ``shift``, after another."""
    def part(name: str) -> Column:
        s = second[name]
        of = F.when(s["base"] == POINT, first["point"]).when(s["base"] == START, first["start"]).otherwise(
            F.struct(F.lit(FIXED).alias("base"), F.lit(0.0).alias("shift")))
        return F.struct(of["base"].alias("base"), (of["shift"] + s["shift"]).alias("shift")).alias(name)

    return F.struct(part("point"), part("start"))


def _entries(blocks: DataFrame, key: list[str]) -> DataFrame:
    """State at the entry of each block: point, subpath start and ring number; and the path's first
    malformed place, ``stop``.

    ``blocks`` has one map per block (``mx``, ``my``, number of begun and closed ``rings``) and its first
    malformed place ``bad``. Maps compose,
    so those of all earlier blocks are joined by doubling, in the logarithm of the blocks' number.
    """
    along = Window.partitionBy(*key).orderBy("blk")
    blocks = store(
        blocks.withColumn("at", F.row_number().over(along))
        .withColumn("stop", F.min("bad").over(Window.partitionBy(*key))))
    most, reach = blocks.agg(F.max("at")).first()[0] or 0, 1
    upto = blocks.select(*key, "at", "mx", "my", "rings")
    while reach < most:
        before = upto.select(*key, (F.col("at") + reach).alias("at"),
                             *(F.col(c).alias(f"_{c}") for c in ("mx", "my", "rings")))
        upto = store(join_large(upto, before, [*key, "at"], "left").select(
            *key, "at",
            *(F.when(F.col("_rings").isNull(), F.col(m)).otherwise(_then(F.col(f"_{m}"), F.col(m))).alias(m)
              for m in ("mx", "my")),
            (F.col("rings") + F.coalesce("_rings", F.lit(0))).alias("rings")))
        reach *= 2
    # A path begins at (0, 0), so the shifts are the state itself.
    before = upto.select(
        *key, (F.col("at") + 1).alias("at"), F.col("rings").alias("ring0"),
        *(F.col(f"m{c}")[part]["shift"].alias(f"{part}_{c}") for c in "xy" for part in ("point", "start")))
    names = ["ring0", *(f"{part}_{c}" for c in "xy" for part in ("point", "start"))]
    return join_large(blocks.select(*key, "blk", "at", "stop"), before, [*key, "at"], "left").select(
        *key, "blk", "stop", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def _positions(steps: DataFrame, key: list[str]) -> DataFrame:
    """Start ``px, py`` and end ``x, y`` of each step before its path's first malformed place, and the
    ring it draws.

    A segmented prefix scan: within a block every step is a map of the point at the entry and of the
    subpath's start there (a constant, a shift, or back to the start); a fold composes them step by
    step. The entry states come from the blocks' own maps.
    """
    axis = {"x": ({"m": "a0", "l": "a0", "h": "a0", "c": "a4", "s": "a2", "q": "a2", "a": "a5"}),
            "y": ({"m": "a1", "l": "a1", "v": "a0", "c": "a5", "s": "a3", "q": "a3", "a": "a6"})}
    args = [f"a{j}" for j in range(7)]
    step = F.struct("pos", "cmd", "rel", *args, *(
        _by_letter(F.col("cmd"), {k: F.col(v) for k, v in axis[c].items()}, None).alias(f"e{c}")
        for c in "xy"))
    spot = "struct<base:int,shift:double>"
    placed = f"array<struct<px:{spot},py:{spot},x:{spot},y:{spot},ring:int>>"

    def at(base: Column, shift: Column) -> Column:
        return F.struct(base.cast("int").alias("base"), shift.alias("shift"))

    def state(x, y, sx, sy, ring, out) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), sx.alias("sx"), sy.alias("sy"),
                        ring.alias("ring"), out.alias("out"))

    def move(acc: Column, e: Column, c: str) -> Column:
        to = e[f"e{c}"]
        return F.when(e["cmd"] == "z", acc[f"s{c}"]).when(to.isNull(), acc[c]).when(
            e["rel"], at(acc[c]["base"], acc[c]["shift"] + to)).otherwise(at(F.lit(FIXED), to))

    def advance(acc: Column, e: Column) -> Column:
        start, close = e["cmd"] == "m", e["cmd"] == "z"
        x, y = move(acc, e, "x"), move(acc, e, "y")
        ring = acc["ring"] + start.cast("int")
        here = F.struct(acc["x"].alias("px"), acc["y"].alias("py"), x.alias("x"), y.alias("y"),
                        ring.alias("ring"))
        return state(x, y, F.when(start, x).otherwise(acc["sx"]),
                     F.when(start, y).otherwise(acc["sy"]), ring + close.cast("int"),
                     F.concat(acc["out"], F.array(here)))

    zero = F.lit(0.0)
    point, begin = at(F.lit(POINT), zero), at(F.lit(START), zero)
    entry = state(point, point, begin, begin, F.lit(0), F.array().cast(placed))
    folded = store(
        steps.groupBy(*key, "blk").agg(
            F.array_sort(F.collect_list(step)).alias("steps"), F.min("bad").alias("bad"))
        .withColumn("end", F.aggregate("steps", entry, advance)))
    end = F.col("end")
    entries = _entries(folded.select(
        *key, "blk", "bad", end["ring"].cast("bigint").alias("rings"),
        *(F.struct(end[c].alias("point"), end[f"s{c}"].alias("start")).alias(f"m{c}") for c in "xy")), key)

    def value(name: str, c: str) -> Column:
        v = F.col(f"z.at.{name}")
        base = F.when(v["base"] == POINT, F.col(f"point_{c}")).when(
            v["base"] == START, F.col(f"start_{c}")).otherwise(F.lit(0.0))
        return (base + v["shift"]).alias(name)

    return (
        join_large(folded.drop("bad"), entries, [*key, "blk"])
        .withColumn("z", F.explode(F.arrays_zip("steps", F.col("end.out").alias("at"))))
        .filter(F.col("stop").isNull() | (F.col("z.steps.pos") < F.col("stop")))
        .select(*key, "blk", *(F.col(f"z.steps.{c}").alias(c) for c in ("pos", "cmd", "rel", *args)),
                *(value(f"{p}{c}", c) for c in "xy" for p in ("p", "")),
                (F.col("ring0") + F.col("z.at.ring")).alias("ring"))
    )


def path_vertices(docs: DataFrame, doc_id: str = "path_id", column: str = "svg") -> DataFrame:
    """SVG documents to vertices: ``doc_id, path_no, ring, seq, x, y``.

    Curves are sampled (six points per cubic, five per quadratic), an arc is its end point. The text of a
    path is one cell, read by one task; documents without an id have no vertices. Texts of a block's length are
    followed whole, see ``short_paths``; the tokens, steps and vertices of longer ones, and of documents
    that share an id, are handled in blocks.
    """
    key = [doc_id, "path_no"]
    alone = F.count(F.lit(1)).over(Window.partitionBy(doc_id)) == 1
    short = F.col("_alone") & (F.length("d") <= TOKEN_CHARS * TOKENS)
    paths = store(
        docs.dropna(subset=[doc_id]).select(doc_id, F.col(column).alias("_text"), alone.alias("_alone"))
        .select(doc_id, "_alone", F.posexplode(svg_d_extract(F.col("_text"))).alias("path_no", "d"))
        .select(*key, "d", short.alias("short")))
    cloudpickle.register_pickle_by_value(sys.modules[followed.__module__])
    kinds = dict(docs.dtypes)
    vertices = paths.filter("short").select(*key, "d").mapInArrow(
        lambda batches: followed(batches, doc_id),
        f"`{doc_id}` {kinds[doc_id]}, path_no int, ring int, seq int, x double, y double")
    rest = paths.filter("NOT short").select(*key, "d")
    return vertices if rest.isEmpty() else vertices.unionByName(_vertices_by_blocks(rest, key))


def _vertices_by_blocks(paths: DataFrame, key: list[str]) -> DataFrame:
    """Vertices of path data ``d`` of any length."""
    steps = _positions(_path_steps(paths, key), key)
    cmd = F.col("cmd")

    def control(j: int, axis: str) -> Column:
        return F.col(f"a{j}") + F.when(F.col("rel"), F.col(f"p{axis}")).otherwise(0.0)

    def toward(p: Column, q: Column) -> Column:
        return p + F.lit(2.0) / F.lit(3.0) * (q - p)

    sampled = steps.withColumn("n", _by_letter(cmd, SAMPLES, 1)).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("k") / F.col("n")
    u = F.lit(1.0) - t
    points = {}
    for i, axis in enumerate("xy"):
        p0, p3 = F.col(f"p{axis}"), F.col(axis)
        c1 = F.when(cmd == "c", control(i, axis)).when(cmd == "s", p0).otherwise(
            toward(p0, control(i, axis)))
        c2 = F.when(cmd == "c", control(2 + i, axis)).when(cmd == "s", control(i, axis)).otherwise(
            toward(p3, control(i, axis)))
        curve = u * u * u * p0 + 3 * u * u * t * c1 + 3 * u * t * t * c2 + t * t * t * p3
        points[axis] = F.when(cmd == "z", None).when(F.col("n") == 1, p3).otherwise(curve)
    drawn = store(sampled.select(
        *key, "ring", "blk", "pos", "k", "cmd", points["x"].alias("x"), points["y"].alias("y")))
    p = F.when(cmd != "z", F.struct("x", "y"))
    order = F.struct("pos", "k")
    # A ring's closing command is its last step: it leads back unless the ring ends where it began.
    rings = drawn.groupBy(*key, "ring").agg(
        F.min_by(p, F.when(cmd != "z", order)).alias("a"), F.max_by(p, F.when(cmd != "z", order)).alias("b"),
        F.count(p).alias("n"), F.max(F.when(cmd == "z", F.struct("pos", "k", "blk"))).alias("z"),
        F.min("blk").alias("b0"), F.max("blk").alias("b1"))
    back = F.coalesce(F.col("z").isNotNull() & (
        (F.col("a.x") != F.col("b.x")) | (F.col("a.y") != F.col("b.y"))), F.lit(False))
    rings = rings.withColumn("back", back).filter(F.col("n") + F.col("back").cast("int") >= 2)
    rings = number_rows(rings.withColumn("_blk", _block("ring")), key, "_blk", ["ring"]).drop("_blk")
    facts = rings.withColumn("blk", F.explode(F.sequence("b0", "b1"))).select(
        *key, "ring", "blk", F.col("i").alias("no"))
    rows = join_large(drawn.filter(cmd != "z"), facts, [*key, "ring", "blk"]).select(
        *key, F.col("no").alias("ring"), "blk", "pos", "k", "x", "y")
    closing = rings.filter("back").select(
        *key, F.col("i").alias("ring"), "z.blk", "z.pos", "z.k", F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    return (
        number_rows(rows.unionByName(closing), [*key, "ring"], "blk", ["pos", "k"])
        .select(*key, F.col("ring").cast("int"), F.col("i").cast("int").alias("seq"), "x", "y")
    )
