"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into segments of a few bits and becomes the vector of their bit counts. Flipping a
bit moves one count by one, so the Manhattan distance of two vectors is at most the number of
differing bits. The counts form blocks; each block is a grid range join: a fingerprint is a member
of its own cell and, for ``reach`` 1, asks the cells one step up along each axis (steps down are asked from
the other side). What meets in a cell is compared bit by bit, exactly.

``Grid`` says how. With more than ``distance / (reach + 1)`` blocks no link can be missed, for among so
many blocks there is one in which a pair within ``distance`` bits is at most ``reach`` apart: that
holds for ``EXACT`` (64 bits, 4 may differ, 32 two-bit segments in 3 blocks). ``WIDE`` serves
similarity: its grid only proposes pairs (of 384 bits 88 may differ, and one of 36 blocks of single bits is
equal; 0.9987 of simulated pairs at similarity 0.8 exactly are proposed, more above it), and a
link is what has Jaccard similarity 0.8 of the shingle sets, counted exactly.

Scale: equal fingerprints are grouped first, so copies are one row. A cell never becomes pairs of
rows: its fingerprints are compared inside a task, and only a spanning forest of the
links leaves it. A cell of more than ``CELL_ROWS`` rows is dealt into blocks of that size, and one unit of
work is a pair of blocks, so a task's memory is bounded and a crowded cell spreads over many
tasks; nothing is capped. Components come from ``graph.components``. For ``WIDE`` a first pass over
the units finds the fingerprints with a proposed pair (a pair counts in the first block that both
share), a second gets their shingle sets by a keyed join and verifies pairs before it
reduces a unit to a forest. Cells are dealt by their shingles too, ``CELL_SHINGLES`` to a block. Cells
have a fixed width, so the pairs compared in them grow with the square of the table.

Words are runs of anything but space and \\t \\n \\v \\f \\r, A-Z in lower case. A text with fewer
words than a shingle is one shingle; a text without words (null, empty, blank) has fingerprint
zero and links like any other. Repeated rows get equal results. Null doc_ids have a fingerprint
and link texts, but never name a component (a component of nulls alone has a null name).
Very long texts are hashed in slices of ``HASHES`` shingles. ``EXACT`` counts a repeated shingle as
often as it stands, ``WIDE`` once, for similarity is that of shingle sets. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import id_or_least, map_rows, slices, text_hash
from inkloom.llm.graph import components
from inkloom.plans.spread import store

SEED = 42
HASHES = 1 << 15
SLICE = 4 << 20
CELL_ROWS = 4096
CELL_SHINGLES = 1 << 22
PAIRS = 1 << 20
SLAB = 64
MARKS = 1 << 23
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD = 0x5555555555555555


@dataclass(frozen=True)
class Grid:
    """Shingle length, 64-bit words of a fingerprint, differing bits that still link, bits of a
    segment (1 or 2), blocks per word, steps between cells that meet (0 or 1), whether a
    shingle counts once however often a text repeats it, and the Jaccard similarity in percent
    that the shingle sets of a link must have (0: the bits decide)."""

    shingle: int
    words: int
    distance: int
    segment: int
    blocks: int
    reach: int
    distinct: bool = False
    percent: int = 0

    @property
    def codes(self) -> list[str]:
        return [f"c{i}" for i in range(self.words)]

    @property
    def columns(self) -> list[str]:
        """What is known of a fingerprint: the codes, and if sets decide, the number of shingles and
        a 64-bit name of the set."""
        return [*self.codes, *(["size", "set_hash"] if self.percent else [])]

    @property
    def node(self) -> Column:
        """A 64-bit name: the fingerprint itself, the hash of a longer one, or the shingle set's."""
        if self.percent:
            return F.col("set_hash")
        return F.col("c0") if self.words == 1 else F.xxhash64(*self.codes)

    @property
    def cuts(self) -> list[int]:
        """Borders of a word's blocks, in segments."""
        return [64 // self.segment * i // self.blocks for i in range(self.blocks + 1)]

    @property
    def masks(self) -> list[np.uint64]:
        """The bits of a word's blocks."""
        return [np.uint64((1 << self.segment * b) - (1 << self.segment * a))
                for a, b in zip(self.cuts, self.cuts[1:], strict=False)]


EXACT = Grid(shingle=4, words=1, distance=4, segment=2, blocks=3, reach=1)
WIDE = Grid(shingle=5, words=6, distance=88, segment=1, blocks=6, reach=0, distinct=True, percent=80)


def shingles(text: bytes, length: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text in their order, in slices of ``HASHES``."""
    import xxhash

    words = _WORD.findall(text.lower())  # bytes.lower() changes A-Z only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(length, len(words))
    first, last = begins[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    for at in range(0, len(first), HASHES):
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(
            first[at:at + HASHES], last[at:at + HASHES], strict=True)], np.uint64)


def shingle_set(text: bytes, length: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; none of a text without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, length)]))


def simhash(slices_: Iterable[np.ndarray], words: int) -> np.ndarray:
    """The 64-bit words of a SimHash of shingle hashes. The first comes from the hashes, further
    ones from mixing them anew."""
    count, n = np.zeros((words, 64), np.int64), 0
    for h in slices_:
        n += len(h)
        for w in range(words):
            if w:
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            bits = np.unpackbits(
                h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count[w] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: bytes, grid: Grid = EXACT) -> np.ndarray:
    """The 64-bit words of a text's SimHash."""
    if grid.distinct:
        return set_fingerprint(shingle_set(text, grid.shingle), grid)
    return simhash(shingles(text, grid.shingle), grid.words)


def set_fingerprint(own: np.ndarray, grid: Grid) -> np.ndarray:
    return simhash((own[a:a + HASHES] for a in range(0, len(own), HASHES)), grid.words)


def _described(text: bytes, grid: Grid) -> np.ndarray:
    """``grid.columns`` of a text."""
    if not grid.percent:
        return fingerprint(text, grid)
    import xxhash

    own = shingle_set(text, grid.shingle)
    name = xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED)
    return np.append(set_fingerprint(own, grid), np.array([len(own), name], np.uint64))


def fingerprints(docs: DataFrame, grid: Grid = EXACT, *keep: str) -> DataFrame:
    """``c0``, ``c1``, ..: the fingerprint of every row as signed bigints (``grid.columns``),
    after the columns ``keep``."""
    def start():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                fps = np.stack([_described((t or "").encode(), grid)
                                for t in part.column("text").to_pylist()]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep),
                     *(pa.array(np.ascontiguousarray(fps[:, i]))
                       for i in range(len(grid.columns)))],
                    names=[*keep, *grid.columns])

        return work

    rows = docs.select(*keep, "text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return map_rows(rows, ", ".join([*kept, *(f"{c} bigint" for c in grid.columns)]), start)


def embed(code: np.ndarray, segment: int) -> np.ndarray:
    """Bit counts of the segments, packed in as many bits each."""
    odd = np.uint64(_ODD)
    return code if segment == 1 else (code & odd) + ((code >> np.uint64(1)) & odd)


def cells(fps: DataFrame, grid: Grid = EXACT) -> DataFrame:
    """block, cell, asks (false for members) and the fingerprint: its grid entries."""
    cuts, masks = grid.cuts, grid.masks
    bits, most = grid.segment, grid.segment  # a count takes as many bits; it is at most this

    def start():
        def work(batch: pa.RecordBatch):
            block, cell, asks, of = [], [], [], []

            def add(b, value, ask, rows):
                block.append(np.full(len(rows), b, np.int32))
                cell.append(value.view(np.int64))
                asks.append(np.full(len(rows), ask))
                of.append(rows)

            for w, name in enumerate(grid.codes):
                vector = embed(batch.column(name).to_numpy().view(np.uint64), bits)
                every = np.arange(len(vector))
                for i, (first, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = vector & masks[i]
                    b = w * grid.blocks + i
                    add(b, own, False, every)
                    for s in range(first, stop) if grid.reach else ():
                        field = (own >> np.uint64(bits * s)) & np.uint64((1 << bits) - 1)
                        up = np.flatnonzero(field < most)
                        add(b, own[up] + np.uint64(1 << bits * s), True, up)
            rows = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate(x)) for x in (block, cell, asks)),
                 *(batch.column(c).take(rows) for c in grid.columns)],
                names=["block", "cell", "asks", *grid.columns])

        return work

    schema = ["block int", "cell bigint", "asks boolean", *(f"{c} bigint" for c in grid.columns)]
    return map_rows(fps.select(*grid.columns), ", ".join(schema), start)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of those given) that connect the same nodes without a circle."""
    if not len(a):
        return a, b
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    label, kept = np.arange(len(names)), []
    at = np.arange(len(a))
    while True:
        lx, ly = label[x[at]], label[y[at]]
        open_ = lx != ly
        at, lx, ly = at[open_], lx[open_], ly[open_]
        if not len(at):
            break
        high, pick = np.unique(np.maximum(lx, ly), return_index=True)
        kept.append(at[pick])
        parent = np.arange(len(names))
        parent[high] = np.minimum(lx, ly)[pick]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        label = parent[label]
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a[kept], b[kept]


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _unit_links(codes, node, asks, side, begin, count, distance):
    """Forest edges of many units: unit g is rows begin[g] .. begin[g] + count[g], members first.
    ``side`` is 0 or 1 in a unit of two blocks, else -1; pairs are member-member or member-asking, and of
    different sides in a unit of two."""
    u, w = np.zeros(0, node.dtype), np.zeros(0, node.dtype)
    members = np.add.reduceat(~asks, begin).astype(np.int64)
    left = np.repeat(begin, members) + _ranks(members)
    todo = np.repeat(begin + count, members) - left - 1  # every later row of the unit
    upto = np.cumsum(todo)
    at = 0
    while at < len(left):
        done = upto[at - 1] if at else 0
        n = max(1, int(np.searchsorted(upto, done + PAIRS, side="right")) - at)
        i = np.repeat(left[at:at + n], todo[at:at + n])
        j = i + 1 + _ranks(todo[at:at + n])
        fit = (side[i] != side[j]) | (side[i] < 0)
        i, j = i[fit], j[fit]
        differ = np.zeros(len(i), np.int64)
        for k, code in enumerate(codes):
            differ += np.bitwise_count(code[i] ^ code[j])
            near = differ <= distance
            # Most pairs are far apart after a word or two.
            if k + 1 < len(codes):
                i, j, differ = i[near], j[near], differ[near]
        u, w = np.concatenate((u, node[i[near]])), np.concatenate((w, node[j[near]]))
        if len(u) > PAIRS:
            u, w = forest(u, w)
        at += n
    return forest(u, w)


UNIT = ["block", "cell", "i", "j"]


def _units(fps: DataFrame, grid: Grid, cell_rows: int) -> DataFrame:
    """The grid entries dealt into units: UNIT, asks, side, node and ``grid.columns``."""
    entries = cells(fps, grid)
    parts = F.ceil(F.count(F.lit(1)) / cell_rows)
    if grid.percent:
        parts = F.least(F.count(F.lit(1)), F.greatest(parts, F.ceil(F.sum("size") / CELL_SHINGLES)))
    crowded = (
        entries.groupBy("block", "cell").agg(parts.cast("int").alias("parts"))
        .filter(F.col("parts") > 1))
    return (
        entries.join(crowded, ["block", "cell"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("node", grid.node)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("i") == F.col("j"), -1)
                    .when(F.col("own") == F.col("i"), 0).otherwise(1))
        .select(*UNIT, "asks", "side", "node", *grid.columns))


def _per_unit(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(table, begin, count)`` of tables that hold whole units, members before those that ask; it
    returns batches of ``schema``."""
    def run(batches):
        waiting = None

        def out(t: pa.Table):
            keys = [t.column(c).to_numpy() for c in UNIT]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            begin = np.flatnonzero(new)
            return work(t, begin, np.diff(np.append(begin, t.num_rows)))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([waiting, t]).combine_chunks() if waiting is not None else t
            if not t.num_rows:
                continue
            # The last unit may go on in the next batch.
            tail = np.ones(t.num_rows, bool)
            for c in UNIT:
                k = t.column(c).to_numpy()
                tail &= k == k[-1]
            cut = t.num_rows - int(tail.sum())
            waiting = t.slice(cut).combine_chunks()
            if cut:
                yield from out(t.slice(0, cut))
        if waiting is not None:
            yield from out(waiting)

    return rows.repartition(*UNIT).sortWithinPartitions(
        *UNIT, *(["asks"] if "asks" in rows.columns else [])).mapInArrow(run, schema)


def links(fps: DataFrame, grid: Grid = EXACT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``u, v``: links between distinct fingerprints (by their node names) that keep all
    connected ones connected."""
    def edges(t: pa.Table, begin: np.ndarray, count: np.ndarray):
        u, w = _unit_links(
            [t.column(c).to_numpy().view(np.uint64) for c in grid.codes],
            t.column("node").to_numpy(), t.column("asks").to_numpy(),
            t.column("side").to_numpy(), begin, count, grid.distance)
        return [pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], names=["u", "v"])]

    return _per_unit(_units(fps, grid, cell_rows), "u bigint, v bigint", edges)


class _Proposals:
    """The pairs of rows that units of a table propose: few bits differ and the numbers of
    shingles allow ``percent``."""

    def __init__(self, t: pa.Table, grid: Grid):
        self.grid = grid
        self.codes = [t.column(c).to_numpy().view(np.uint64) for c in grid.codes]
        self.size, self.side = t.column("size").to_numpy(), t.column("side").to_numpy()
        self.block = t.column("block").to_numpy()

    def pairs(self, begin: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of a unit, a slab of rows against all later ones at a time."""
        stop, size, side = begin + count, self.size, self.side
        for a in range(begin, stop - 1, SLAB):
            b = min(a + SLAB, stop - 1)
            differ = np.zeros((b - a, stop - a - 1), np.uint16)
            for c in self.codes:
                differ += np.bitwise_count(c[a:b, None] ^ c[None, a + 1:stop])
            i, j = np.nonzero(differ <= self.grid.distance)
            i, j = i + a, j + a + 1
            fit = (j > i) & ((side[i] != side[j]) | (side[i] < 0))
            fit &= np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * self.grid.percent
            yield i[fit], j[fit]

    def here(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of one unit those that share no earlier block."""
        if not len(i):
            return i, j
        word, last = divmod(int(self.block[i[0]]), self.grid.blocks)
        for w in range(word + 1):
            code = self.codes[w]
            x, new = code[i] ^ code[j], np.ones(len(i), bool)
            for m in self.grid.masks[: last if w == word else None]:
                new &= (x & m) != 0
            i, j = i[new], j[new]
        return i, j


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (of distinct numbers) have this Jaccard similarity; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= (len(a) + len(b) - both) * percent


def _marks(hashes: DataFrame) -> np.ndarray:
    """``MARKS`` bits, those set that the column ``h`` falls on; the driver holds them, a MB."""
    at = F.pmod("h", F.lit(MARKS))
    words = hashes.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {MARKS}) & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(MARKS // 64, np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out


def _sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, grid: Grid) -> DataFrame:
    """node and ``shingles`` (its set, 8 bytes each) for the ``nodes``, from one text of each."""
    one = store(
        rows.join(nodes.distinct(), "node", "left_semi").groupBy("node")
        .agg(F.min(F.struct(id_or_least().alias("_d"), F.col("th").alias("_th"))).alias("k"))
        .select("node", "k._d", "k._th"))
    # Most texts have no proposed pair; they are left out before the shuffle.
    sent = docs.sparkSession.sparkContext.broadcast(_marks(one.select(F.col("_th").alias("h"))))

    def start():
        marks = sent.value

        def work(batch: pa.RecordBatch):
            h = batch.column("_th").to_numpy() % MARKS
            batch = batch.take(pa.array(np.flatnonzero((marks[h >> 6] >> (h & 63)) & 1)))
            if not batch.num_rows:
                return
            for part in slices(batch, "text", SLICE):
                sets = [shingle_set((t or "").encode(), grid.shingle).astype("<u8").tobytes()
                        for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_d"), part.column("_th"), pa.array(sets, pa.binary())],
                    names=["_d", "_th", "shingles"])

        return work

    texts = docs.select(id_or_least().alias("_d"), text_hash().alias("_th"), "text")
    return (
        map_rows(texts, "_d bigint, _th bigint, shingles binary", start)
        .join(one, ["_d", "_th"]).groupBy("node").agg(F.first("shingles").alias("shingles")))


def verified_links(
    docs: DataFrame, rows: DataFrame, fps: DataFrame, grid: Grid = WIDE, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``u, v`` like ``links``, of proposed pairs whose shingle sets have the similarity. ``rows`` are
    the fingerprints of ``docs`` with doc_id, th and node."""
    names = [*UNIT, "side", "node", *grid.columns]
    units = _units(fps, grid, cell_rows).select(names)

    def propose(t: pa.Table, begin: np.ndarray, count: np.ndarray):
        found, some = _Proposals(t, grid), np.zeros(t.num_rows, bool)
        for at, n in zip(begin[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            for i, j in found.pairs(at, n):
                new = ~(some[i] & some[j])
                i, j = found.here(i[new], j[new])
                some[i] = some[j] = True
        return t.filter(pa.array(some)).combine_chunks().to_batches()

    def verify(t: pa.Table, begin: np.ndarray, count: np.ndarray):
        t = t.combine_chunks()
        found, sets = _Proposals(t, grid), t.column("shingles").chunk(0) if t.num_rows else []
        label, u, w = np.arange(t.num_rows), [], []
        for at, n in zip(begin[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            own, known = label[at:at + n], {}

            def of(x, known=known):
                if x not in known:
                    known[x] = np.frombuffer(sets[x].as_buffer(), "<u8")
                return known[x]

            for i, j in found.pairs(at, n):
                apart = label[i] != label[j]
                i, j = found.here(i[apart], j[apart])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if label[x] != label[y] and alike(of(x), of(y), grid.percent):
                        u.append(x)
                        w.append(y)
                        own[own == label[y]] = label[x]
        node = t.column("node").to_numpy()
        return [pa.RecordBatch.from_arrays(
            [pa.array(node[np.array(x, np.int64)]) for x in (u, w)], names=["u", "v"])]

    kinds = {f.name: f.dataType.simpleString() for f in units.schema}
    some = store(_per_unit(units, ", ".join(f"{c} {kinds[c]}" for c in names), propose))
    sets = _sets(docs, rows, some.select("node"), grid)
    return _per_unit(some.join(sets, "node"), "u bigint, v bigint", verify)


def _grouped(
    docs: DataFrame, grid: Grid, cell_rows: int = CELL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, fingerprint, node), and node, root, component_id of each node."""
    ids = docs.select(
        F.col("doc_id").cast("bigint"), text_hash().alias("th"), "text")
    rows = store(fingerprints(ids, grid, "doc_id", "th").withColumn("node", grid.node))
    fps = store(rows.groupBy("node", *grid.columns).agg(F.min("doc_id").alias("least")))
    edges = verified_links(docs, rows, fps, grid, cell_rows) if grid.percent else \
        links(fps, grid, cell_rows)
    roots = store(components(edges)).withColumnRenamed("node", "_node")
    of = fps.join(roots, F.col("node") == F.col("_node"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, of.join(names, "root").select("node", "root", "component_id")


def near_duplicates(
    docs: DataFrame, grid: Grid = EXACT, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """doc_id, c0 .., component_id of every row of ``docs``."""
    rows, groups = _grouped(docs, grid, cell_rows)
    return rows.join(groups.drop("root"), "node").select(
        "doc_id", *grid.codes, "component_id")


def one_per_group(docs: DataFrame, grid: Grid = WIDE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The row of ``docs`` with the smallest (doc_id, text hash) of every group of near copies;
    null doc_ids come first, one of equal rows stays."""
    rows, groups = _grouped(docs, grid, cell_rows)
    kept = rows.join(groups, "node").groupBy("root").agg(
        F.min(F.struct(id_or_least().alias("_d"), F.col("th").alias("_th"))).alias("k")
    ).select("k._d", "k._th")
    keyed = docs.withColumn("_d", id_or_least()).withColumn("_th", text_hash())
    equal = Window.partitionBy("_d", "_th").orderBy("_d")
    return (
        keyed.join(kept, ["_d", "_th"])
        .withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") == 1)
        .select(docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("c0"), 16, "0")).alias("fingerprint"), "component_id")
