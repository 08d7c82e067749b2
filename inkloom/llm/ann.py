"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Fitting looks at a bounded sample (``SAMPLE`` vectors with the smallest hash of their id): their
neighbour graph is cut into equal partitions, and a small classifier (one hidden layer) learns which
partitions hold a vector's neighbours. Every vector of the table is then filed under its most
probable partition, and a query is routed to its ``probes`` most probable ones; ``probes`` is the
least number that reaches ``target`` recall on the sample. What is found there is ranked by the
exact inner product in double precision, summed in the order of the components, so equal
vectors tie exactly and ties go to the smaller id.

Scale: the model is sample-sized, whatever the table. A partition, even one that holds a third of
all vectors, is dealt into slices of ``BLOCK`` rows, into ``SLICES`` longer ones beyond that, and the queries
that ask it into groups of ``QUERY_BYTES``. A unit of work is a group and a slice: the group's queries
are held with their best ``k`` so far while the slice's vectors stream past, so memory is bounded. A query
yields ``k`` candidates per slice, at most ``k * SLICES`` per partition however large the table; a window
merges them. For a given query set vectors are moved once. No slice is skipped.

Vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components take no part, neither do rows with a null vec_id. Of rows that share a
vec_id the smallest vector counts. A query that meets fewer than ``k`` others in its partitions is sent to
all the other partitions too, so it gets ``k``, or all there are. A table of fewer than four sampled vectors a
partition is one partition. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import map_rows
from inkloom.plans.spread import store

K = 20
SAMPLE = 8192
PARTITIONS = 32
BLOCK = 8192
SLICES = 64
QUERY_BYTES = 64 << 20
TARGET = 0.95
GRAPH_NEAR = 16
HIDDEN = 128
SEED = 5


@dataclass
class Router:
    """The classifier: scores of the partitions for vectors (rows)."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row."""
    k = min(k, score.shape[1])
    return np.argpartition(-score, k - 1, axis=1)[:, :k]


def _near(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` others of largest inner product, in slices of rows."""
    out = []
    for a in range(0, len(x), 256):
        s = x[a:a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out.append(_top(s, k))
    return np.concatenate(out)


def _halves(x: np.ndarray, rows: np.ndarray, parts: int, label: np.ndarray, first: int) -> None:
    """Equal parts by cutting at the median of the main direction, again and again."""
    if parts == 1:
        label[rows] = first
        return
    y = x[rows] - x[rows].mean(axis=0)
    d = np.random.default_rng(SEED).normal(size=x.shape[1])
    for _ in range(8):
        d = y.T @ (y @ d)
        d /= np.linalg.norm(d) or 1.0
    order = np.argsort(y @ d, kind="stable")
    cut = len(rows) * (parts // 2) // parts
    _halves(x, rows[order[:cut]], parts // 2, label, first)
    _halves(x, rows[order[cut:]], parts - parts // 2, label, first + parts // 2)


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int, passes: int = 8) -> np.ndarray:
    """Balanced partitions of a neighbour graph: nodes move to the part that holds most of their
    neighbours, the largest gains first, while no part exceeds its share by 5 %."""
    n = len(x)
    label = np.zeros(n, np.int64)
    _halves(x, np.arange(n), parts, label, 0)
    most = int(np.ceil(1.05 * n / parts))
    both = [np.concatenate((np.repeat(np.arange(n), near.shape[1]), near.ravel())),
            np.concatenate((near.ravel(), np.repeat(np.arange(n), near.shape[1])))]
    for _ in range(passes):
        count = np.bincount(both[0] * parts + label[both[1]], minlength=n * parts).reshape(n, parts)
        best = count.argmax(axis=1)
        gain = count[np.arange(n), best] - count[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def _learn(x: np.ndarray, target: np.ndarray, epochs: int = 30, batch: int = 256) -> Router:
    """Softmax classifier with one hidden layer, by Adam."""
    rng = np.random.default_rng(SEED)
    dim, parts = x.shape[1], target.shape[1]
    p = [rng.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim) * np.sqrt(dim) / 4, np.zeros(HIDDEN),
         rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a:a + batch]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            e = np.exp(s - s.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for i, d in enumerate((x[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p, probes=parts)


def fit(x: np.ndarray, parts: int = PARTITIONS, k: int = K, target: float = TARGET) -> Router:
    """Router from a sample of vectors (rows)."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = _near(unit, min(GRAPH_NEAR, len(x) - 1))
    label = partition_graph(unit, graph, parts)
    near = _near(x, min(k, len(x) - 1))
    share = np.zeros((len(x), parts))
    np.add.at(share, (np.arange(len(x))[:, None], label[near]), 0.5 / near.shape[1])
    share[np.arange(len(x)), label] += 0.5
    router = _learn(x, share)
    filed = router.scores(x)
    home = filed.argmax(axis=1)
    ranked = np.argsort(-filed, axis=1)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(place, home[near], axis=1)  # probes that reach each neighbour, less 1
    reached = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    router.probes = int(np.searchsorted(reached, target)) + 1
    return router


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v`` (array of double) of the rows that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists(v, lambda c: c != 0)
    return (
        vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & fine & some)
        .groupBy(F.col("vec_id").cast("bigint").alias("vec_id"))
        .agg(F.min(v).cast("array<double>").alias("v"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, every one summed in the order of the components."""
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out += np.multiply.outer(q[:, d], x[:, d])
    return out


class Best:
    """The ``k`` best of what has passed by, for each of the queries ``q`` (with ids ``own``). Ids
    ascend, so of equal scores the earlier stays."""

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int):
        self.own, self.q, self.k = own, q, k
        self.score = np.full((len(q), k), -np.inf)
        self.near = np.zeros((len(q), k), np.int64)

    def take(self, ids: np.ndarray, x: np.ndarray, chunk: int = 64) -> None:
        for a in range(0, len(self.q), chunk):
            s = dot(self.q[a:a + chunk], x)
            own = self.own[a:a + chunk]
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            s[np.flatnonzero(ids[at] == own), at[ids[at] == own]] = -np.inf
            better = s > self.score[a:a + chunk, -1:]
            for i in np.flatnonzero(better.any(axis=1)):
                new = np.flatnonzero(better[i])
                if len(new) > self.k:
                    least = np.partition(s[i, new], len(new) - self.k)[len(new) - self.k]
                    new = new[s[i, new] >= least]
                score = np.concatenate((self.score[a + i], s[i, new]))
                order = np.argsort(-score, kind="stable")[:self.k]
                self.near[a + i] = np.concatenate((self.near[a + i], ids[new]))[order]
                self.score[a + i] = score[order]

    def batches(self, rows: int = 1 << 14):
        for a in range(0, len(self.q), rows):
            i, j = np.nonzero(self.score[a:a + rows] > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (self.own[a + i], self.near[a + i, j], self.score[a + i, j])],
                names=["query_id", "vec_id", "score"])


def search(
    vectors: DataFrame, every: int, k: int = K, sample: int = SAMPLE, parts: int = PARTITIONS,
    block: int = BLOCK, target: float = TARGET, slices: int = SLICES, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: neighbours of the vectors whose id ``every`` divides."""
    rows = store(valid(vectors))
    spark = rows.sparkSession
    chosen = rows.select("vec_id").orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(sample)
    some = rows.join(F.broadcast(chosen), "vec_id", "left_semi").select("vec_id", "v").toArrow()
    some = some.sort_by("vec_id")["v"].combine_chunks()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not len(some):
        return empty
    sizes = some.value_lengths()
    dim = pa.compute.mode(sizes)[0]["mode"].as_py()
    x = _matrix(some.filter(pa.compute.equal(sizes, dim)))
    # Too few vectors to learn from are one partition.
    router = None if len(x) < 4 * parts else fit(x, parts, k, target)
    # Plain arrays: executors need not have this package installed.
    sent = spark.sparkContext.broadcast(router and (router.w1, router.b1, router.w2, router.b2, router.probes))
    rows = rows.filter(F.size("v") == dim)

    def start():
        r = sent.value and Router(*sent.value)

        def work(batch: pa.RecordBatch):
            n = batch.num_rows
            s = r.scores(_matrix(batch.column("v"))) if r else np.zeros((n, 1))
            to = np.argsort(-s, axis=1, kind="stable")[:, : r.probes if r else 1]
            ends = np.arange(n + 1, dtype=np.int32) * to.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(to[:, 0].astype(np.int32)),
                 pa.ListArray.from_arrays(ends, pa.array(to.ravel().astype(np.int32)))],
                names=["vec_id", "v", "part", "probes"])

        return work

    filed = store(map_rows(
        rows, "vec_id bigint, v array<double>, part int, probes array<int>", start))
    # At most ``parts`` rows.
    held = {p: n for p, n in filed.groupBy("part").count().collect()}
    cuts = {p: min(-(-n // block), slices) for p, n in held.items()}
    group = max(1, query_bytes // (8 * dim + 16 * k))
    asked = filed.filter(F.col("vec_id") % every == 0)

    def by_part(numbers: dict[int, int]) -> Column:
        return F.coalesce(*[F.when(F.col("part") == p, n) for p, n in numbers.items()], F.lit(0))

    def each(n: Column) -> Column:
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))

    def dealt(n: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.greatest(n, F.lit(1))).cast("int")

    def run(batches):
        unit, queries, members, n = None, [], [], 0

        def passed():
            t = pa.Table.from_batches(members).combine_chunks()
            state.take(t.column("vec_id").to_numpy(), _matrix(t.column("v").chunk(0)))

        state = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "slice", "group")])
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0) |
                                 (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (key := tuple(keys[:, a])) != unit:
                    if members:
                        passed()
                    if state:
                        yield from state.batches()
                    unit, queries, members, n, state = key, [], [], 0, None
                if asks[a]:
                    queries.append(part)
                    continue
                if state is None:
                    if not queries:
                        continue
                    t = pa.Table.from_batches(queries).combine_chunks()
                    state = Best(t.column("vec_id").to_numpy(), _matrix(t.column("v").chunk(0)), k)
                    queries = []
                members.append(part)
                n += b - a
                if n >= block:
                    passed()
                    members, n = [], 0
        if members:
            passed()
        if state:
            yield from state.batches()

    def meet(queries: DataFrame, to: Column) -> DataFrame:
        asking = queries.select("vec_id", "v", F.explode(to).alias("part"))
        # At most ``parts`` rows.
        groups = by_part({p: -(-c // group) for p, c in asking.groupBy("part").count().collect()})
        asking = asking.withColumn("slice", each(by_part(cuts))).withColumn("group", dealt(groups, 1))
        base = (
            filed.select("vec_id", "v", "part", dealt(by_part(cuts), 0).alias("slice"))
            .withColumn("group", each(groups)))
        return (
            asking.withColumn("asks", F.lit(True)).unionByName(base.withColumn("asks", F.lit(False)))
            .repartition("part", "slice", "group")
            .sortWithinPartitions("part", "slice", "group", F.desc("asks"), "vec_id")
            .mapInArrow(run, "query_id bigint, vec_id bigint, score double"))

    found = meet(asked, F.col("probes"))
    if router and router.probes < parts:
        # Probed partitions may hold too few: those queries go to all the others as well.
        found = store(found)
        need = min(k, sum(held.values()) - 1)
        full = found.groupBy("query_id").count().filter(F.col("count") >= need)
        short = store(asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"))
        if short.limit(1).count():
            rest = F.array_except(F.lit(list(held)), F.col("probes"))
            found = found.unionByName(meet(short, rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors, every=20)
