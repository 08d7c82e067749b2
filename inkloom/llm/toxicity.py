"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of words cut to four letters (which cover inflected forms), of word pairs, and
of pairs that skip one word, hashed to 2^20 coordinates. Per-coordinate learning rates and an L1 term leave few weights; they alone are sent to all tasks, at most 2^20 whatever the corpus.

The model is learned from a bounded sample (``per_class`` labelled rows of each class, those with
the smallest hash of their id; 6,000 by default): features are made where the rows lie, one
task makes the passes of the online learner, and only weights reach the driver. The sample's classes may be
of unequal size, so the intercept is fitted apart: every row is scored by a model of the other folds, and the cut goes
where the share of toxic rows above it, less ``ALARM_COST`` times the share of clean ones, is largest. Scoring
reads every whole text once, without a shuffle.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Labels of one doc_id are merged (toxic if
any says so), and of rows that share a doc_id the least text is learned. Null labels are ignored; without any labelled
toxic row all scores are 0. Null and empty texts score as texts without words; scores are never
null. Rows are scored one by one, so repeated rows repeat their score; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import map_rows, slices

BITS = 20
PER_CLASS = 6_000
EPOCHS = 5
FOLDS, ALARM_COST = 3, 20
ALPHA, BETA, L1, L2 = 0.2, 1.0, 6.0, 1.0
STEM = 4
SEED = 17
BIAS = 1 << BITS
WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 300_000
SLICE = 4 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


class _Words(dict):
    """64-bit hashes of words cut to ``letters``; forgets them all when there are too many."""

    def __init__(self, letters: int | None = None):
        self.letters = letters

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        part = word[:self.letters].encode()
        h = self[word] = xxhash.xxh64_intdigest(part, SEED + bool(self.letters))
        return h


def features(text: str, known: tuple[_Words, _Words]) -> np.ndarray:
    """Distinct coordinates of a text, ascending."""
    words = WORD.findall(text.lower())
    h, stem = (np.fromiter(map(k.__getitem__, words), np.uint64, len(words)) for k in known)
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams = [h, stem, (h[:-1] * p + h[1:]) * q, (h[:-2] * q + h[2:]) * p ^ q]
    mixed = np.concatenate(grams)
    mixed ^= mixed >> np.uint64(29)
    mixed *= q
    return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32))


class Ftrl:
    """FTRL-proximal with 0/1 features; the bias is the last coordinate and has no L1 term."""

    def __init__(self):
        self.z = np.zeros(BIAS + 1)
        self.n = np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == BIAS, 0.0, L1)
        w = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, found: np.ndarray, label: int) -> None:
        at = np.append(found, BIAS)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _learned(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    model = Ftrl()
    order = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    return model.weights(np.arange(BIAS + 1))


def _cut(rows: list[tuple[np.ndarray, int]]) -> float:
    """Where to cut the sums of a model, by those of rows that it did not see."""
    label, sums = np.array([y for _, y in rows]), np.zeros(len(rows))
    fold = np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        w = _learned([r for r, f in zip(rows, fold, strict=True) if f != k])
        sums[fold == k] = [w[BIAS] + w[rows[i][0]].sum() for i in np.flatnonzero(fold == k)]
    if label.all() or not label.any():
        return 0.0
    clean, toxic = np.sort(sums[label == 0]), np.sort(sums[label == 1])
    caught = 1 - np.arange(len(toxic)) / len(toxic)
    alarms = 1 - np.searchsorted(clean, toxic, "left") / len(clean)
    gain = caught - ALARM_COST * alarms
    if gain.max() <= 0:  # nothing learned that tells them apart: the model's own cut
        return 0.0
    lowest = toxic[np.argmax(gain)]
    return float((lowest + max(sums[sums < lowest], default=lowest)) / 2)


def _train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero."""
    w = _learned(rows)
    w[BIAS] -= _cut(rows)
    kept = np.flatnonzero(w)
    return kept, w[kept]


Weights = tuple[np.ndarray, np.ndarray]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Weights | None:
    """Coordinates with a weight (``BIAS`` is the bias) and the weights, or None without a labelled
    toxic row."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_y"))
        .withColumn("_o", F.xxhash64("doc_id", F.lit(SEED)))
    )
    sample = None
    for y in (0, 1):
        some = known.filter(F.col("_y") == y).orderBy("_o", "doc_id").limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "_y", "_o").agg(F.min("text").alias("text"))
    )

    def featurize():
        words = _Words(), _Words(STEM)

        def work(batch: pa.RecordBatch):
            found = [features(t or "", words) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_o"), batch.column("_y"), lists], names=["_o", "_y", "found"])

        return work

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(f.values.to_numpy(), y) for b in batches for f, y in zip(
            b.column("found"), b.column("_y").to_pylist(), strict=True)]
        if any(y for _, y in rows):
            at, w = _train(rows)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    found = map_rows(texts, "_o bigint, _y int, found array<int>", featurize)
    ordered = found.repartition(1).sortWithinPartitions("_o", "_y")
    kept = ordered.mapInArrow(train, "at bigint, w double").toArrow()  # at most 2^20 + 1 rows
    if not kept.num_rows:
        return None
    return kept["at"].to_numpy(), kept["w"].to_numpy()


def score(docs: DataFrame, weights: Weights | None, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` and ``predicted``."""
    if weights is None:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    text = "text" if "text" in keep else "_text"

    def start():
        words, (at, some) = (_Words(), _Words(STEM)), sent.value
        w = np.zeros(BIAS + 1, np.float32)
        w[at] = some
        bias = float(w[BIAS])

        def one(text: str | None) -> float:
            s = bias + float(w[features(text or "", words)].sum(dtype=np.float64))
            return 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))

        def work(batch: pa.RecordBatch):
            for part in slices(batch, text, SLICE):
                s = np.array([one(t) for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(s),
                     pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

        return work

    rows = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias(text))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
    return map_rows(rows, ", ".join([*kept, "score double", "predicted int"]), start)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
