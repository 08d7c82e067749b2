"""The collinear rule on rings of any length, by jumps instead of a walk.

Which vertex is kept next depends only on the last kept one, so every vertex has one *jump*: the next
vertex that is kept if this one is. The kept vertices are those that the jumps reach from the first.
Rings are cut into chunks; inside a chunk jumps are composed to a map "entry vertex -> last kept
vertex", the maps of successive chunks are composed by doubling, and the entries that the first
vertex reaches are marked in logarithmically many rounds. No ring is ever one task's.

A jump may lead over many chunks (smooth arcs, straight runs). Chunks that a vertex certainly passes
are skipped by their boxes: along the chunk's main direction the sideways extent, seen from the vertex, and
the spread of its edges' directions bound every angle in it. Boxes of ``FAN`` chunks skip at once, and a
vertex crosses ``SEGMENT`` chunks in a round. Where the box leaves it open, the chunk's vertices are
tested one by one with the rule itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.plans.spread import int_div, join_large, store, whole_groups

KEYS = ["path_id", "ring"]
CHUNK = 1024
SUB = 32
FAN = 32
SEGMENT = 4096
#: Chunks of waiting vertices that meet a chunk in one task.
TOGETHER = 64
BOX = ["phi", "spread", "a0", "a1", "b0", "b1"]


def bends(px, py, x, y, nx, ny, cos: float) -> np.ndarray:
    """Whether the vertices x, y stay if px, py is the last kept one."""
    ux, uy, wx, wy = x - px, y - py, nx - x, ny - y
    n1, n2 = np.sqrt(ux * ux + uy * uy), np.sqrt(wx * wx + wy * wy)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (n1 >= 1e-9) & (n2 >= 1e-9) & ((ux * wx + uy * wy) / (n1 * n2) < cos)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs((a - b + np.pi) % (2 * np.pi) - np.pi)


def boxes(x, y, nx, ny, size: int) -> np.ndarray:
    """Boxes (rows of BOX) of successive groups of ``size`` vertices. A group with the last vertex of
    a ring, which has no successor, can never be passed."""
    starts = np.arange(0, len(x), size)
    group = np.arange(len(x)) // size
    last = np.isnan(nx)
    wx, wy = np.where(last, 0.0, nx - x), np.where(last, 0.0, ny - y)
    phi = np.arctan2(np.add.reduceat(wy, starts), np.add.reduceat(wx, starts))
    off = np.where(np.hypot(wx, wy) < 1e-9, 0.0, _apart(np.arctan2(wy, wx), phi[group]))
    off[last] = np.inf
    c, s = np.cos(phi)[group], np.sin(phi)[group]
    along, side = x * c + y * s, y * c - x * s
    return np.stack([phi, np.maximum.reduceat(off, starts), np.minimum.reduceat(along, starts),
                     np.maximum.reduceat(along, starts), np.minimum.reduceat(side, starts),
                     np.maximum.reduceat(side, starts)], axis=1)


def merged(box: np.ndarray, size: int) -> np.ndarray:
    """Boxes around ``size`` successive boxes each."""
    starts = np.arange(0, len(box), size)
    group = np.arange(len(box)) // size
    phi, spread, a0, a1, b0, b1 = box.T
    c, s, reach = np.cos(phi), np.sin(phi), a1 - a0 + 1e-12
    whole = np.arctan2(np.add.reduceat(s * reach, starts), np.add.reduceat(c * reach, starts))
    c2, s2 = np.cos(whole)[group], np.sin(whole)[group]
    corners = [(a * c - b * s, a * s + b * c) for a in (a0, a1) for b in (b0, b1)]
    along = np.stack([x * c2 + y * s2 for x, y in corners])
    side = np.stack([y * c2 - x * s2 for x, y in corners])
    return np.stack([
        whole, np.maximum.reduceat(spread + _apart(phi, whole[group]), starts),
        np.minimum.reduceat(along.min(axis=0), starts), np.maximum.reduceat(along.max(axis=0), starts),
        np.minimum.reduceat(side.min(axis=0), starts), np.maximum.reduceat(side.max(axis=0), starts)], axis=1)


def passes(px, py, box: np.ndarray, cos: float) -> np.ndarray:
    """Whether no vertex in the boxes (one for each point) certainly stays; false if unsure."""
    phi, spread, a0, a1, b0, b1 = box.T
    c, s = np.cos(phi), np.sin(phi)
    # Far beyond the rounding errors of the products.
    slack = 1e-11 * (np.abs(px) + np.abs(py) + np.abs(a0) + np.abs(a1) + np.abs(b0) + np.abs(b1))
    ahead = a0 - (px * c + py * s) - slack
    at = py * c - px * s
    beside = np.maximum(np.abs(b0 - at), np.abs(b1 - at)) + slack
    return (ahead > 0) & (np.arctan2(beside, np.maximum(ahead, 1e-300)) + spread < np.arccos(cos) - 1e-7)


def first_open(px, py, at: np.ndarray, box: np.ndarray, cos: float, fan: int = FAN) -> np.ndarray:
    """For each point the first of the successive boxes from ``at`` on that it may not pass, or their number."""
    at, coarse = at.copy(), merged(box, fan)
    live = np.flatnonzero(at < len(box))
    while len(live):
        here = at[live]
        jump = here % fan == 0
        jump[jump] = passes(px[live[jump]], py[live[jump]], coarse[here[jump] // fan], cos)
        step = passes(px[live], py[live], box[here], cos)
        at[live] = np.minimum(here + np.where(jump, fan, step), len(box))
        live = live[(jump | step) & (at[live] < len(box))]
    return at


def first_bend(px, py, begin: np.ndarray, x, y, nx, ny, cos: float, sub: int = SUB) -> np.ndarray:
    """For each point the first of the vertices from ``begin`` on that stays, or their number."""
    box, at, n = boxes(x, y, nx, ny, sub), begin.copy(), len(x)
    last = np.isnan(nx)
    tested = np.zeros(len(at), bool)  # the box of the current group did not settle it
    live = np.flatnonzero(at < n)
    while len(live):
        here = at[live]
        fresh = (here % sub == 0) & ~tested[live]
        over = np.zeros(len(live), bool)
        over[fresh] = passes(px[live[fresh]], py[live[fresh]], box[here[fresh] // sub], cos)
        stays = ~over & (last[here] | bends(px[live], py[live], x[here], y[here], nx[here], ny[here], cos))
        at[live] = np.where(stays, here, np.minimum(here + np.where(over, sub, 1), n))
        tested[live] = ~over & ((here + 1) % sub != 0)
        live = live[~stays & (at[live] < n)]
    return at


def _groups(frame: pd.DataFrame, keys: list[str]):
    codes = frame[keys].to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
        yield frame.iloc[a:b]


def _meet(members: DataFrame, waiting: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(members, waiting)`` for each place (ring, ``cell``) and its waiting vertices, of which a
    task holds those of ``TOGETHER`` chunks. Members come in the order of ``seq``."""
    waiting = waiting.withColumn("salt", int_div(F.col("seq"), CHUNK * TOGETHER))
    keys = [*KEYS, "cell", "salt"]
    dealt = join_large(members, waiting.select(*keys).distinct(), [*KEYS, "cell"]).withColumn("waits", F.lit(False))
    rows = dealt.unionByName(waiting.withColumn("waits", F.lit(True)), allowMissingColumns=True)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = [work(g[~g["waits"]], g[g["waits"]]) for g in _groups(frame, keys)]
        return pd.concat(out) if out else frame.iloc[:0]

    return whole_groups(rows.select(*keys, "waits", "seq", *columns), keys, ["waits", "seq"], run, schema)


def _find_jumps(points: DataFrame, cos: float, chunk: int, segment: int) -> DataFrame:
    """``path_id, ring, seq, jump`` of every vertex but the last of its ring."""
    kinds = dict(points.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in KEYS)
    spot = f"{keys}, seq bigint, x double, y double"

    def look(own: pd.DataFrame, waiting: pd.DataFrame) -> pd.DataFrame:
        x, y, nx, ny = (own[c].to_numpy(float) for c in ("x", "y", "nx", "ny"))
        first = own["seq"].iloc[0]
        begin = np.maximum(waiting["seq"].to_numpy() + 1 - first, 0)
        at = first_bend(waiting["x"].to_numpy(), waiting["y"].to_numpy(), begin, x, y, nx, ny, cos)
        found = at < len(x)
        return waiting.assign(
            jump=pd.Series(at + first, index=waiting.index, dtype="Int64").where(found),
            at=waiting["cell"] + 1)[[*KEYS, "seq", "x", "y", "jump", "at"]]

    def skip(own: pd.DataFrame, waiting: pd.DataFrame) -> pd.DataFrame:
        first = own["seq"].iloc[0]
        at = first_open(waiting["x"].to_numpy(), waiting["y"].to_numpy(), waiting["at"].to_numpy(np.int64) - first,
                        own[BOX].to_numpy(float), cos)
        return waiting.assign(at=at + first)[[*KEYS, "seq", "x", "y", "at"]]

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in _groups(frame, [*KEYS, "cell"]):
            box = boxes(*(g[c].to_numpy(float) for c in ("x", "y", "nx", "ny")), len(g))
            out.append(g.iloc[:1][[*KEYS, "cell"]].assign(**dict(zip(BOX, box.T, strict=True))))
        return pd.concat(out)

    members = points.withColumn("cell", int_div(F.col("seq"), chunk))
    measured = ", ".join(f"{b} double" for b in BOX)
    chunks = store(
        whole_groups(members, [*KEYS, "cell"], ["seq"], measure, f"{keys}, cell bigint, {measured}")
        .withColumnRenamed("cell", "seq").withColumn("cell", int_div(F.col("seq"), segment)))
    corner = ["x", "y", "nx", "ny"]
    looked = f"{spot}, jump bigint, at bigint"
    found = store(_meet(members, members.filter("nx IS NOT NULL").drop("nx", "ny"), corner, look, looked))
    jumps = found.filter("jump IS NOT NULL")
    while not (waiting := found.filter("jump IS NULL").drop("jump")).isEmpty():
        ahead = store(_meet(
            chunks, waiting.withColumn("cell", int_div(F.col("at"), segment)), ["x", "y", "at", *BOX], skip,
            f"{spot}, at bigint"))
        found = store(_meet(members, ahead.withColumn("cell", F.col("at")).drop("at"), corner, look, looked))
        jumps = jumps.unionByName(found.filter("jump IS NOT NULL"))
    return jumps.select(*KEYS, "seq", "x", "y", "jump")


def kept_by_jumps(points: DataFrame, cos: float, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """``path_id, ring, seq, x, y`` of the vertices that the collinear rule keeps. ``points`` has each
    vertex of its rings, ``seq`` dense from 0, with its successor ``nx, ny`` (null for the last)."""
    points = store(points.select(*KEYS, "seq", "x", "y", "nx", "ny"))
    last = points.filter("nx IS NULL").select(*KEYS, "seq", "x", "y", F.lit(None).cast("bigint").alias("jump"))
    jumps = store(
        _find_jumps(points, cos, chunk, segment).unionByName(last).withColumn("cell", int_div(F.col("seq"), chunk)))
    kinds = dict(jumps.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in KEYS)

    def inside(g: pd.DataFrame) -> np.ndarray:
        """Row numbers of the jumps that stay in the chunk, the own row for the others."""
        own = np.arange(len(g))
        to = g["jump"].to_numpy(float) - float(g["seq"].iloc[0])
        return np.where(to < len(g), np.nan_to_num(to), own).astype(np.int64)

    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in _groups(frame, [*KEYS, "cell"]):
            end = inside(g)
            while (end[end] != end).any():
                end = end[end]
            out.append(g.assign(jump=g["jump"].array[end])[[*KEYS, "seq", "jump"]])
        return pd.concat(out)

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in _groups(frame, [*KEYS, "cell"]):
            to, keep = inside(g).tolist(), np.zeros(len(g), bool)
            for at in np.flatnonzero(g["entered"].to_numpy(bool)).tolist():  # one, or none
                while not keep[at]:
                    keep[at] = True
                    at = to[at]
            out.append(g.loc[keep, [*KEYS, "seq", "x", "y"]])
        return pd.concat(out)

    place = [*KEYS, "cell"]
    leaps = store(whole_groups(
        jumps.select(*place, "seq", F.col("jump").cast("double")), place, ["seq"], leave,
        f"{keys}, seq bigint, jump double").select(*KEYS, "seq", F.col("jump").cast("bigint")).filter("jump IS NOT NULL"))
    reached = points.filter("seq = 0").select(*KEYS, "seq")
    while not leaps.isEmpty():
        # Twice as many chunks at each step: those reached so far, and one leap beyond each of them.
        reached = store(reached.unionByName(
            join_large(reached, leaps, [*KEYS, "seq"]).select(*KEYS, F.col("jump").alias("seq"))))
        then = leaps.select(*KEYS, F.col("seq").alias("jump"), F.col("jump").alias("_to"))
        leaps = store(join_large(leaps, then, [*KEYS, "jump"]).select(*KEYS, "seq", F.col("_to").alias("jump")))
    entered = reached.distinct().withColumn("entered", F.lit(True))
    rows = join_large(jumps, entered, [*KEYS, "seq"], "left").select(
        *place, "seq", "x", "y", F.col("jump").cast("double"), F.coalesce("entered", F.lit(False)).alias("entered"))
    return whole_groups(rows, place, ["seq"], follow, f"{keys}, seq bigint, x double, y double")
