"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two primes near 2^31, the sums of (code point + 1) * base^position
up to every place. Two array entries give the hash of any span, brought to a common power, so any two
spans are compared in constant time, and the longest common extension of two places follows
by binary search (``PrefixHashes``).

The fingerprint keeps what such comparisons need of a whole text: its length, its hash, and the
hashes of its first and of its last g code points for the lengths g of one fixed ladder (``RUNGS``
a doubling), 24 bits each, so its size grows with the logarithm of the text. The likeness of two fingerprints is
(common start + common end) / longer length, where both common parts are found by binary search
on the ladders: 1 for equal texts only, a lower bound of the share that one run of edits left alone, and
within a rung's ratio of it.

``edited`` chains the documents in descending doc_id: each one's last third is replaced by the
beginning of the next one's text. The order is numbered on rows of id and text hash alone; every so-manieth row
of it starts a bucket, and the texts are shuffled once, to the bucket of their place. The first
row of a bucket is sent to the bucket before as well, so that every row meets its successor in
its own task.

Null texts are empty. Null ids come last; of equal ids the smaller text hash comes first. Rows equal
in id and text are merged before the shuffle and come out as often as they went in (each but the last
is its own successor). A single document follows itself. An empty table gives no rows; other columns
are ignored. A text is held whole in one task, at about 60 bytes a code point.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import map_rows, slices
from inkloom.llm.sharding import number_rows

RUNGS = 4
SLICE = 1 << 20
BUCKET_BYTES = 256 << 20
PRIMES = (2147483647, 2147483629)
BASES = (1000000007, 998244353)
_GRID = np.unique(np.floor(2.0 ** (np.arange(0, 62 * RUNGS) / RUNGS)).astype(np.int64))


class _Powers:
    """base^i and base^-i modulo a prime, extended by doubling when asked for."""

    def __init__(self, prime: int, base: int):
        self.prime, self.tables = np.uint64(prime), [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.bases = base, pow(base, -1, prime)

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            self.tables = [
                np.concatenate([t, t * np.uint64(pow(b, m, int(self.prime))) % self.prime])
                for t, b in zip(self.tables, self.bases, strict=True)]
        return self.tables


_POWERS = [_Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True)]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


class PrefixHashes:
    """Prefix arrays of many texts, side by side."""

    def __init__(self, texts: list[str]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = _codes(texts).astype(np.uint64) + np.uint64(1)
        at = np.arange(len(codes)) - np.repeat(self.starts, self.sizes)
        longest = int(self.sizes.max(initial=0)) + 1
        self.sums, self.powers = [], []
        for p in _POWERS:
            powers = p.upto(longest)
            sums = np.zeros(len(codes) + 1, np.uint64)
            # Below 2^31 each, so 2^33 of them fit.
            np.cumsum(codes * powers[0][at] % p.prime, out=sums[1:])
            self.sums.append(sums)
            self.powers.append(powers)

    def span(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """62-bit hashes of the code points begin .. begin + size of the given texts."""
        a = self.starts[text] + begin
        parts = [
            (s[a + size] - s[a]) % p.prime * w[1][begin] % p.prime
            for s, w, p in zip(self.sums, self.powers, _POWERS, strict=True)]
        return (parts[0] << np.uint64(31)) | parts[1]

    def equal(self, a: tuple, b: tuple, size: np.ndarray) -> np.ndarray:
        """Whether spans of ``size`` at the places a and b (text numbers, begins) are equal."""
        return self.span(*a, size) == self.span(*b, size)

    def extension(self, a: tuple, b: tuple) -> np.ndarray:
        """Lengths of the longest common extensions of the places a and b."""
        most = np.minimum(self.sizes[a[0]] - a[1], self.sizes[b[0]] - b[1])
        return _search(most, lambda size: self.equal(a, b, size))


def _search(most: np.ndarray, equal) -> np.ndarray:
    """The largest n <= ``most`` for which ``equal(n)`` holds; it holds up to there and not beyond."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = equal(middle)
        low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
    return low


class Ladders:
    """Fingerprints as numbers: sizes, whole hashes, and 24-bit hashes of starts and ends."""

    def __init__(self, sizes: np.ndarray, whole: np.ndarray, heads: np.ndarray, tails: np.ndarray):
        self.sizes, self.whole, self.heads, self.tails = sizes, whole, heads, tails
        self.counts = np.searchsorted(_GRID, sizes, "right")
        self.starts = np.cumsum(self.counts) - self.counts

    @classmethod
    def of(cls, texts: list[str]) -> Ladders:
        h = PrefixHashes(texts)
        counts = np.searchsorted(_GRID, h.sizes, "right")
        text = np.repeat(np.arange(len(texts)), counts)
        size = _GRID[np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)]
        every, zero = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return cls(h.sizes, h.span(every, zero, h.sizes), _short(h.span(text, zero[text], size)),
                   _short(h.span(text, h.sizes[text] - size, size)))

    @classmethod
    def read(cls, texts: list[str]) -> Ladders:
        parts = [t.split(".") for t in texts]

        def rungs(i: int) -> np.ndarray:
            raw = np.frombuffer(base64.b64decode("".join(p[i] for p in parts)), np.uint8).reshape(-1, 3)
            return np.pad(raw, ((0, 0), (0, 1))).view("<u4").ravel()

        return cls(np.array([int(p[0], 16) for p in parts], np.int64),
                   np.array([int(p[1], 16) for p in parts], np.uint64), rungs(2), rungs(3))

    def written(self) -> list[str]:
        def text(rungs: np.ndarray) -> str:
            return base64.b64encode(
                np.ascontiguousarray(rungs.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])).decode()

        heads, tails = text(self.heads), text(self.tails)
        ends = (4 * (self.starts + self.counts)).tolist()
        return [f"{n:x}.{w:015x}.{heads[a:b]}.{tails[a:b]}" for n, w, a, b in zip(
            self.sizes.tolist(), self.whole.tolist(), (4 * self.starts).tolist(), ends, strict=True)]

    def likeness(self, a: np.ndarray, other: Ladders, b: np.ndarray) -> np.ndarray:
        """Likeness of the own fingerprints ``a`` to those of ``other`` numbered ``b``, pair by pair."""
        n, m = self.sizes[a], other.sizes[b]
        rungs = np.minimum(self.counts[a], other.counts[b])
        common = np.zeros(len(a), np.int64)
        for mine, theirs in ((self.heads, other.heads), (self.tails, other.tails)):
            mine, theirs = np.append(mine, 0), np.append(theirs, 0)
            found = _search(rungs, lambda k: (k == 0) | (
                mine[self.starts[a] + k - 1] == theirs[other.starts[b] + k - 1]))
            common += np.where(found > 0, _GRID[found - 1], 0)
        share = np.minimum(common, np.minimum(n, m)) / np.maximum(np.maximum(n, m), 1)
        same = (n == m) & (self.whole[a] == other.whole[b])
        # Below 1 unless they are equal, even if a rung collides.
        return np.where(same, 1.0, np.minimum(share, np.nextafter(1.0, 0.0)))


def _short(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint32)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    one = np.zeros(1, np.int64)
    return float(Ladders.read([a]).likeness(one, Ladders.read([b]), one)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint per document."""

    def start():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                found = Ladders.of([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found.sizes), pa.array(found.written(), pa.string())],
                    names=["doc_id", "n_chars", "fingerprint"])

        return work

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"),
                    "doc_id bigint, n_chars bigint, fingerprint string", start)


ORDER = ["z", "o", "h"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the columns that put them in descending doc_id, nulls last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.col("doc_id").cast("bigint")
    return docs.select(
        doc.alias("doc_id"), text.alias("text"), doc.isNull().alias("z"),
        F.coalesce(F.bitwise_not(doc), F.lit(0).cast("bigint")).alias("o"), F.xxhash64(text).alias("h"))


def _bucketed(docs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Documents with their bucket and number of copies. The first row of a bucket also goes, marked
    ``tail``, to the bucket before (the first of all to the last)."""
    first = {key: i for i, key in enumerate(cuts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True))
            copies = [1] * len(keys)
            if len(set(keys)) < len(keys):  # merge equal rows
                texts, seen = batch.column("text").to_pylist(), {}
                for i, key in enumerate(keys):
                    j = seen.setdefault((key, texts[i]), i)
                    if j != i:
                        copies[j] += 1
                        copies[i] = 0
            rows, buckets, tail, counts = [], [], [], []
            for i, key in enumerate(keys):
                if copies[i]:
                    at = first.get(key)
                    rows.append(i)
                    buckets.append(bisect_left(cuts, key) - 1 if at is None else at)
                    tail.append(False)
                    counts.append(copies[i])
                    if at is not None:
                        rows.append(i)
                        buckets.append((at - 1) % len(cuts))
                        tail.append(True)
                        counts.append(1)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array(tail), pa.array(counts, pa.int64()),
                 *(batch.column(c).take(taken) for c in ("doc_id", "text", *ORDER))],
                names=["bucket", "tail", "copies", "doc_id", "text", *ORDER])

    return _keyed(docs).mapInArrow(
        run, "bucket int, tail boolean, copies bigint, doc_id bigint, text string, z boolean, o bigint, h bigint")


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _compared(rows: list[tuple[int | None, str, int]]) -> pa.RecordBatch:
    """Result rows of (doc_id, text, copies) but for the last one, which only follows."""
    texts = [t for _, t, _ in rows]
    made = Ladders.of(texts)
    # A row's copies but one are followed by the same text.
    pairs = [(i, j) for i, (_, _, n) in enumerate(rows[:-1]) for j in ([i] * (n > 1) + [i + 1])]
    times = np.array([rows[i][2] - 1 if i == j else 1 for i, j in pairs], np.int64)
    own, after = np.array(pairs, np.int64).reshape(-1, 2).T
    changed = [edit(texts[i], texts[j]) for i, j in pairs]
    made_of = Ladders.of(changed)
    written, written_of = made.written(), made_of.written()
    columns = [
        pa.array([rows[i][0] for i in own], pa.int64()), pa.array(made.sizes[own]),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([written[i] for i in own], pa.string()), pa.array(written_of, pa.string()),
        pa.array(made.likeness(own, made_of, np.arange(len(own)))), pa.array(made.likeness(own, made, after)),
    ]
    times = pa.array(np.repeat(np.arange(len(own)), times))
    return pa.RecordBatch.from_arrays([c.take(times) for c in columns], names=[
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    light = _keyed(docs).select(*ORDER, F.octet_length("text").alias("b"))
    numbered, n = number_rows(light, ORDER)
    if not n:
        return spark.createDataFrame([], schema)
    size = numbered.agg(F.sum(F.col("b").cast("bigint"))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes)
    # One key a bucket.
    cuts = sorted({tuple(r) for r in numbered.filter(F.col("row") % -(-n // buckets) == 0).select(*ORDER).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, closed, held, chars = None, False, [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "tail", "doc_id", "copies", "text")]
            for i in range(batch.num_rows):
                b, tail, doc, copies, text = (c[i].as_py() for c in columns)
                if b != bucket:
                    bucket, closed, held, chars = b, False, [], 0
                elif closed:  # further copies of the following bucket's first row
                    continue
                if held and not tail and held[-1][:2] == (doc, text):
                    held[-1] = (doc, text, held[-1][2] + copies)
                    continue
                held.append((doc, text, copies))
                chars += len(text)
                if tail or chars > SLICE and len(held) > 1:
                    yield _compared(held)
                    held, chars, closed = held[-1:], len(text), tail

    return (
        _bucketed(docs, cuts).repartition("bucket")
        .sortWithinPartitions("bucket", "tail", *ORDER).mapInArrow(run, schema))


def query(docs: DataFrame) -> DataFrame:
    return edited(docs)
