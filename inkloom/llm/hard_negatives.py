"""Hard negatives by a vertical scan of bounded partial scores.

For each anchor the columns (dimensions) of a block of vectors are read in the order of the
anchor's descending magnitudes. What the unread columns can still add lies between the sums of their least and
largest contributions, known from each column's minimum and maximum in the block. After every
few columns these bounds strike rows from the anchor's candidate bitmap: rows below the k-th best lower
bound when positives are sought, and rows that can fall in no window, or only behind ``k`` surer ones, when
negatives are sought. What is left at the end has its exact integer score.

Rows are numbered by (label, hash) and dealt into *spans* of rows; anchors form *groups* by the same
numbers. A group meets a span as one unit: anchors first, then the span's rows block by block, with the best
found so far as a further bound. A unit is bounded whatever the table holds, and a label that a third of
all rows carry is many spans. Positives are sought in the spans that hold the anchor's label only. What a
unit returns per anchor is at most ``k`` rows for each of its windows.

A vector takes part if its label and id are not null and its components are neither null nor
non-finite; a length other than the most frequent one (the larger of two) keeps a vector out, an
empty vector too. Of rows that share a vec_id the least (label, vector) counts. Components are whole numbers
``floor(scale * x)``, cut at +-2^24 so that sums fit in a long. Ties go to the smaller vec_id.
An anchor without another row of its label has no rows, nor has a positive with a negative score. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.sharding import number_rows
from inkloom.plans.spread import int_div, store

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SPAN = 4096
GROUP_ROWS = 1 << 18
STEP = 16
LIMIT = 1 << 24


class Block:
    """Columns of some vectors, and the range of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(rows.T.astype(np.int64))
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(
        self, q: np.ndarray, rows: np.ndarray,
        possible: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = STEP,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``possible(lower, upper)`` bounds never struck out, with their exact scores."""
        order = np.argsort(-np.abs(q), kind="stable")
        q = q[order]
        ends = np.stack([q * self.least[order], q * self.most[order]])
        # What the columns from each place on can still add.
        low, high = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0)))
        score = np.zeros(len(rows), np.int64)
        for a in range(0, len(q), step):
            some = self.columns[order[a:a + step]]
            score += q[a:a + step] @ (some if len(rows) == some.shape[1] else some[:, rows])
            rest = min(a + step, len(q))
            keep = possible(score + low[rest], score + high[rest])
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score


def _kth(values: np.ndarray, k: int, least: int) -> int:
    """The k-th largest of the values, ``least`` if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else least


_NEVER = -(1 << 62)


def _better(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def nearest(block: Block, q: np.ndarray, own: int, label: int, found: tuple, k: int) -> tuple:
    """``found`` (ids, scores), the best k of the anchor's label so far, after this block."""
    rows = np.flatnonzero((block.labels == label) & (block.ids != own))
    if not len(rows):
        return found
    so_far = _kth(found[1], k, _NEVER)

    def possible(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= max(so_far, _kth(lower, k, _NEVER))

    rows, score = block.scan(q, rows, possible)
    ids, score = np.append(found[0], block.ids[rows]), np.append(found[1], score)
    best = _better(ids, score, k)
    return ids[best], score[best]


def in_windows(
    block: Block, q: np.ndarray, label: int, windows: np.ndarray, found: tuple, k: int
) -> tuple:
    """``found`` (ids, scores), every window's best k of other labels so far, after this block.
    ``windows`` holds the least and largest score of each."""
    rows = np.flatnonzero(block.labels != label)
    if not len(rows):
        return found
    so_far = [_kth(found[1][(found[1] >= lo) & (found[1] <= hi)], k, lo) for lo, hi in windows]

    def possible(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for (lo, hi), least in zip(windows, so_far, strict=True):
            sure = lower[(lower >= lo) & (upper <= hi)]
            keep |= (upper >= max(least, _kth(sure, k, lo))) & (lower <= hi)
        return keep

    rows, score = block.scan(q, rows, possible)
    ids, score = np.append(found[0], block.ids[rows]), np.append(found[1], score)
    keep = np.zeros(len(ids), bool)
    for lo, hi in windows:
        inside = np.flatnonzero((score >= lo) & (score <= hi))
        keep[inside[_better(ids[inside], score[inside], k)]] = True
    return ids[keep], score[keep]


def whole_vectors(vectors: DataFrame, scale: int = 256, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part; where ``every`` divides the id,
    the label is moved on by one of ``labels``."""
    v = F.col("embedding")
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    label = F.col("label").cast("bigint")
    whole = F.transform(v, lambda c: F.least(F.greatest(
        F.floor(c.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return (
        vectors.filter(fine).select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label).alias("label"),
            whole.alias("v"))
        .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s"))
        .select("vec_id", "s.label", "s.v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _meet(members: DataFrame, asks: DataFrame, work: Callable, found: str) -> DataFrame:
    """Anchors of a group (``asks``: g, span, vec_id, label, v, windows) with the rows of each span
    that they ask for, as ``anchor_id, <found>, score``.

    ``work(block, anchor, found)`` takes an anchor's (vector, id, label, windows)."""
    pairs = asks.select("g", "span").distinct()
    rows = members.join(pairs.hint("merge"), "span").select(
        "g", "span", F.lit(True).alias("member"), "row", "vec_id", "label", "v",
        F.lit(None).cast("array<array<bigint>>").alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, anchors, best = None, [], []

        def results() -> Iterator[pa.RecordBatch]:
            sizes = [len(b[0]) for b in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([a[1] for a in anchors], sizes)),
                     pa.array(np.concatenate([b[0] for b in best])),
                     pa.array(np.concatenate([b[1] for b in best]))],
                    names=["anchor_id", found, "score"])

        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "span", "member")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), (keys[0][a], keys[1][a])
                if key != unit:
                    yield from results()
                    unit, anchors, best = key, [], []
                x = _matrix(part.column("v"))
                ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
                if not keys[2][a]:
                    anchors += zip(x.astype(np.int64), ids, labels, [
                        None if w is None else np.array(w, np.int64)
                        for w in part.column("windows").to_pylist()], strict=True)
                    best += [nothing] * len(ids)
                    continue
                block = Block(ids, labels, x)
                best = [work(block, *z) for z in zip(anchors, best, strict=True)]
        yield from results()

    return (
        asks.select("g", "span", F.lit(False).alias("member"), "row", "vec_id", "label", "v", "windows")
        .unionByName(rows).repartition("g", "span").sortWithinPartitions("g", "span", "member", "row")
        .mapInArrow(run, f"anchor_id bigint, {found} bigint, score bigint"))


def mine(
    rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, span: int = SPAN, group: int = GROUP_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors
    (ids that ``every`` divides) among ``rows`` (vec_id, label, v)."""
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("v") == (size["d"] if size else 0))
    numbered, n = number_rows(
        rows.withColumn("_h", F.xxhash64("vec_id")), ["label", "_h", "vec_id"])
    members = numbered.withColumn("span", int_div(F.col("row"), span)).drop("_h")
    anchors = members.filter(F.col("vec_id") % every == 0).withColumn(
        "g", int_div(F.col("row"), group)).drop("span")
    held = members.groupBy("label").agg(F.min("span").alias("s0"), F.max("span").alias("s1"))
    asks = (
        anchors.join(held.hint("merge"), "label")
        .withColumn("span", F.explode(F.sequence("s0", "s1")))
        .withColumn("windows", F.lit(None).cast("array<array<bigint>>")))
    near = _meet(members, asks, lambda block, a, f: nearest(block, a[0], a[1], a[2], f, positives),
                 "positive_id")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = store(
        near.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= positives)
        .filter("score >= 0").select("anchor_id", "positive_id", F.col("score").alias("positive_score"))
        # Whole scores s with low * p <= 100 * s <= high * p.
        .withColumn("_lo", -F.floor(-F.col("positive_score") * low / F.lit(100).cast("decimal(20,0)")))
        .withColumn("_hi", F.floor(F.col("positive_score") * high / F.lit(100).cast("decimal(20,0)")))
        .withColumn("_lo", F.col("_lo").cast("bigint")).withColumn("_hi", F.col("_hi").cast("bigint")))
    # At most ``positives`` windows an anchor.
    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_distinct(F.collect_list(F.array("_lo", "_hi"))).alias("windows"))
    asks = anchors.join(windows.hint("merge"), "vec_id").withColumn(
        "span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, (n - 1) // span)).cast("bigint"))))
    others = _meet(members, asks, lambda block, a, f: in_windows(block, a[0], a[2], a[3], f, negatives),
                   "negative_id").withColumnRenamed("score", "negative_score")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        others.join(chosen.hint("merge"), "anchor_id")
        .filter(F.col("negative_score").between(F.col("_lo"), F.col("_hi")))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def query(vectors: DataFrame) -> DataFrame:
    return mine(store(whole_vectors(vectors)))


SQL = """
WITH r AS MATERIALIZED (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
