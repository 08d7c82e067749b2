"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Two words that differ by one inserted, deleted or replaced
letter have reduced words that are equal or differ by one edit as well. So the full one-edit
neighbourhood of every reduced word is generated and joined with the reduced vocabulary, and what
meets is verified on the words themselves. Neighbourhoods are sums of a 64-bit polynomial hash, so a
word of any length costs a number of keys proportional to its length; a colliding hash only
proposes a pair that the verification refuses. Of each pair of reduced words one side alone is sent.

Reduced words that many words share would multiply. Where two classes propose more than
``PAIRS`` pairs, their words are *crowded*: two crowded words meet by the words that remain when
one of their letters is left out, and the number of words that share such a remainder is bounded by the
alphabet and the length, not by the data. Every near pair is found by exactly one of the two ways.

Counting runs over whole texts with one dictionary per task, which is emptied when it is full, so a
frequent word is a few rows per task. A word's form is its most frequent near word, if it is at least
twice as frequent; forms therefore lead upwards and their roots follow by pointer doubling in
few rounds, each written to the shared folder.

Null and empty texts hold no words, a null doc_id is written as nothing in the hash of its runs.
Repeated rows count each. Ties of forms go to the word that is first in code-point order. An empty
table gives no rows; other columns are ignored. Words of any length are handled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import slices
from inkloom.plans.spread import store

SYMBOLS = 8
PAIRS = 10_000
LEAST_CHARS, LEAST_COUNT = 5, 3
# Every core of an executor has a worker with a dictionary, a slice and an array of keys of its own.
HELD_WORDS = 100_000
SLICE = 1 << 20
LONG = 1 << 17
KEYS = 1 << 19
_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lower(text: str) -> str:
    """Lower case of A-Z alone."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def _hits(words: set[str], prefix: int, every: int) -> list[tuple[str, int]]:
    hashes = map(zlib.crc32, map(str.encode, words), repeat(prefix))
    return [(w, h) for w, h in zip(words, hashes, strict=True) if not h % every]


def _counted(batches: Iterator[pa.RecordBatch], noise: int | None) -> Iterator[pa.RecordBatch]:
    """``word, n`` of one task's texts; a word comes again whenever the dictionary was full."""

    def emit(held: Counter) -> pa.RecordBatch:
        kept = [w for w, n in held.items() if n and len(w) >= LEAST_CHARS]
        return pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.string()), pa.array([held[w] for w in kept], pa.int64())],
            names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for doc, text in zip(part.column("doc_id").to_pylist(),
                                 part.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                low = lower(text)
                # No list of all runs of a very long text, and no search in a long list.
                runs = _RUN.findall(low) if len(low) <= LONG else Counter(
                    m[0] for m in _RUN.finditer(low))
                held.update(runs)
                if noise is not None:
                    prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for w, h in _hits(set(runs), prefix, noise):
                        n = runs.count(w) if isinstance(runs, list) else runs[w]
                        i = h % len(w)
                        held[w] -= n
                        held[w[:i] + w[i + 1:]] += n
                if len(held) >= HELD_WORDS:
                    yield emit(held)
                    held = Counter()
    if held:
        yield emit(held)


def count_words(docs: DataFrame, noise: int | None = 97) -> DataFrame:
    """``word, n`` over all documents, words of at least ``LEAST_CHARS`` code points and
    ``LEAST_COUNT`` occurrences. Where ``noise`` divides the crc32 of ``<doc_id>:<run>``, the run loses
    the code point at that hash modulo its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, noise)

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_symbol(code: int, symbols: int = SYMBOLS) -> int:
    return (code * 2654435761 % 4294967296 >> 16) % symbols


def _values(symbols: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, symbols, np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _BASE
    return np.cumprod(out, dtype=np.uint64)


def word_keys(reduced: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Hashes of reduced words of one length (rows of symbols)."""
    return (_values(symbols)[reduced] * _powers(reduced.shape[1])).sum(axis=1, dtype=np.uint64)


def neighbourhood(reduced: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Hashes of everything one edit away from each row, itself included, repeats too."""
    n, length = reduced.shape
    v, p = _values(symbols), _powers(length + 1)
    terms = v[reduced] * p[:length]
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, axis=1, dtype=np.uint64, out=before[:, 1:])
    total = before[:, -1:]
    deleted = before[:, :-1] + (total - before[:, 1:]) * _INVERSE
    replaced = (total - terms)[:, :, None] + v * p[:length, None]
    inserted = (before + (total - before) * _BASE)[:, :, None] + v * p[:, None]
    return np.concatenate(
        [deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)], axis=1)


def remainders(codes: np.ndarray) -> np.ndarray:
    """Hashes of each row of code points and of what remains when one of them is left out."""
    n, length = codes.shape
    # An odd multiplier and a shift spread the code points over 64 bits.
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    terms = (x ^ (x >> np.uint64(32))) * _powers(length)
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, axis=1, dtype=np.uint64, out=before[:, 1:])
    total = before[:, -1:]
    return np.concatenate([total, before[:, :-1] + (total - before[:, 1:]) * _INVERSE], axis=1)


def _by_length(words: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points of words of equal length, at most ``KEYS / width`` code points
    at once (one word at least)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, KEYS // (width * max(1, length)))
        for a in range(0, len(rows), step):
            some = rows[a:a + step]
            text = "".join([words[i] for i in some.tolist()])
            yield some, np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(some), length)


def _unique_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the distinct entries of each row."""
    keys = np.sort(keys, axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


def _vocabulary(words: DataFrame, symbols: int) -> DataFrame:
    """``word, n`` with the hash ``key`` of the reduced word and the reduced word itself."""
    table = np.array([letter_symbol(c, symbols) for c in range(256)])
    names = {c: chr(97 + int(s)) for c, s in enumerate(table)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_ = batch.column("word").to_pylist()
            keys = np.zeros(len(words_), np.uint64)
            for rows, codes in _by_length(words_, 1):
                keys[rows] = word_keys(table[codes], symbols)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(keys.view(np.int64)),
                 pa.array([w.translate(names) for w in words_], pa.string())],
                names=["word", "n", "key", "reduced"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint, reduced string")


def _near_classes(classes: DataFrame, symbols: int) -> DataFrame:
    """``a, ca, b``: for each class its key, size, and the keys of its neighbourhood above its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reduced = batch.column("reduced").to_pylist()
            key, size = batch.column("key").to_numpy(), batch.column("c").to_numpy()
            for rows, codes in _by_length(reduced, 2 * symbols + 1):
                of, near = _unique_rows(neighbourhood(codes - np.uint32(97), symbols).view(np.int64))
                of = rows[of]
                up = near > key[of]
                of, near = of[up], near[up]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[of]), pa.array(size[of]), pa.array(near)], names=["a", "ca", "b"])

    return classes.select("key", "reduced", "c").mapInArrow(run, "a bigint, ca bigint, b bigint")


def _remainder_rows(words: DataFrame) -> DataFrame:
    """``d, word, n`` for every remainder of a word, and the word itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_ = batch.column("word").to_pylist()
            for rows, codes in _by_length(words_, 2):
                of, keys = _unique_rows(remainders(codes).view(np.int64))
                at = pa.array(rows[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column("word").take(at), batch.column("n").take(at)],
                    names=["d", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "d bigint, word string, n bigint")


def near_words(words: DataFrame, symbols: int = SYMBOLS, pairs: int = PAIRS) -> DataFrame:
    """``u, n_u, v, n_v`` once for every two words of the table (``word, n``, distinct) that are
    exactly one edit apart."""
    vocabulary = store(_vocabulary(words, symbols))
    classes = store(vocabulary.groupBy("key", "reduced").agg(F.count(F.lit(1)).alias("c")))
    sizes = classes.select(F.col("key").alias("b"), F.col("c").alias("cb"))
    met = store(
        _near_classes(classes, symbols).join(sizes.hint("merge"), "b")
        .unionByName(classes.filter("c > 1").select(
            F.col("key").alias("b"), F.col("key").alias("a"), F.col("c").alias("ca"),
            F.col("c").alias("cb"))))
    many = met.filter(F.col("ca") * F.col("cb") > pairs)
    crowd = many.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("crowd", F.lit(True))
    side = store(
        vocabulary.drop("reduced").join(crowd.hint("merge"), "key", "left")
        .withColumn("crowd", F.coalesce("crowd", F.lit(False))))
    one = F.levenshtein("u", "v", 1) == 1
    left = side.select(F.col("key").alias("a"), F.col("word").alias("u"), F.col("n").alias("n_u"),
                       F.col("crowd").alias("_u"))
    right = side.select(F.col("key").alias("b"), F.col("word").alias("v"), F.col("n").alias("n_v"),
                        F.col("crowd").alias("_v"))
    spread = (
        met.filter(F.col("ca") * F.col("cb") <= pairs).select("a", "b")
        .join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        .filter(((F.col("a") < F.col("b")) | (F.col("u") < F.col("v"))) & ~(F.col("_u") & F.col("_v")) & one))
    rest = _remainder_rows(side.filter("crowd"))
    close = (
        rest.select("d", F.col("word").alias("u"), F.col("n").alias("n_u"))
        .join(rest.select("d", F.col("word").alias("v"), F.col("n").alias("n_v")).hint("merge"), "d")
        .filter((F.col("u") < F.col("v")) & one))
    columns = ["u", "n_u", "v", "n_v"]
    found = spread.select(columns).unionByName(close.select(columns))
    # The order within a pair is fixed, so the two ways and colliding hashes give one row.
    swap = F.col("u") > F.col("v")
    return found.select(
        F.least("u", "v").alias("u"), F.when(swap, F.col("n_v")).otherwise(F.col("n_u")).alias("n_u"),
        F.greatest("u", "v").alias("v"), F.when(swap, F.col("n_u")).otherwise(F.col("n_v")).alias("n_v"),
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the rows ``word, form`` of a table without cycles."""
    at = store(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = store(
            at.join(step.hint("merge"), F.col("root") == F.col("_w"), "left")
            .select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")))
        at = moved.select("word", "root")
        if not moved.filter("_moved").limit(1).count():
            return at


def variants(docs: DataFrame, noise: int | None = 97, symbols: int = SYMBOLS,
             pairs: int = PAIRS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the documents."""
    words = store(count_words(docs, noise))
    near = store(near_words(words, symbols, pairs))
    both = near.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("n_v").alias("m")).unionByName(
        near.select(F.col("v").alias("word"), F.col("u").alias("near"), F.col("n_u").alias("m")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    chosen = -F.col("best.m") >= 2 * F.col("n")
    formed = store(
        words.join(best.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")))
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: crc32 byte by byte with its table computed from the polynomial; near words by remainders.
SQL = """
WITH RECURSIVE bits AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[a-zÀ-ÿ]+')) AS w FROM documents),
counted AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY doc_id, w),
digits AS (SELECT doc_id, w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM counted),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda i: CAST(instr('0123456789ABCDEF', x[2 * i + 1]) * 16
    + instr('0123456789ABCDEF', x[2 * i + 2]) - 17 AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM digits, tab),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word,
  n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM words, unnest(range(length(word))) u(i)),
one AS (SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.d = b.word),
ranked AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near,
  row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k FROM one),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 2 * w.n THEN r.near END AS form,
  CASE WHEN r.m >= 2 * w.n THEN r.m END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1),
up AS (SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON up.at = f.word WHERE f.form IS NOT NULL),
top AS (SELECT up.word, up.at AS root FROM up JOIN formed f ON up.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(t.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f LEFT JOIN top t ON f.word = t.word
"""
