"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. The ledger keeps one bit per failed rule and the measurements, and
a policy is a bit mask of the rules that it enforces: applying another policy version, or asking
what the corpus would be without one rule, is bit arithmetic on the stored ledger.

All of it is SQL expressions on the row of the document: no Python, no shuffle. Repeated
three-word windows are found by sorting 64-bit numbers, which hold 44 bits of the window's hash
above 20 bits of its place. Neighbours in that order are compared by their words; should two
different windows ever share the 44 bits, or a text have more than 2^20 words, the row falls back
to sorting (words, place), so counts are exact.

Null and empty texts have no words: they fail ``few_words``. Texts of any length are read whole.
Rows are independent, so repeated rows repeat their result; columns of the input that the ledger
does not name are kept, and those that it names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import let

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PLACE_BITS = 20
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements; ``bit`` never changes once it is published."""

    bit: int
    name: str
    failed: str


RULES = [
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "short_words", "10 * word_chars < 20 * n_words"),
    Rule(5, "long_words", "10 * word_chars > 200 * n_words"),
]
BASE = ["few_words", "repeated_words"]
POLICIES = {1: BASE, 2: [*BASE, "symbols", "duplicate_lines", "short_words", "long_words"]}
CURRENT = 2


def mask(names: list[str], rules: list[Rule] | None = None) -> int:
    return sum(1 << r.bit for r in rules or RULES if r.name in names)


def words_of(text: Column) -> Column:
    blank = F.translate(text, SPACE[1:], " " * (len(SPACE) - 1))
    return F.array_remove(F.split(blank, " "), "")


def _places(n: Column) -> Column:
    """0 .. n - 3, the starts of the three-word windows."""
    return F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))


def _covered(starts: Column) -> Column:
    """Words under windows of three that start at the sorted ``starts``."""
    steps = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda a, p: F.struct(
            p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
    )
    return steps["sum"]


def _neighbours(keys: Column, equal) -> Column:
    """Elements of sorted ``keys`` that equal the one before or after them."""
    return F.filter(keys, lambda k, i: F.coalesce(
        equal(F.get(keys, i - 1), k) | equal(F.get(keys, i + 1), k),
        equal(F.get(keys, i - 1), k), equal(F.get(keys, i + 1), k), F.lit(False)))


def _repeats_by_words(w: Column) -> Column:
    rows = F.sort_array(F.transform(_places(F.size(w)), lambda i: F.struct(
        F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"),
        i.alias("at"))))

    def equal(x, y):
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    return let(rows, lambda s: _covered(
        F.sort_array(F.transform(_neighbours(s, equal), lambda r: r["at"]))))


def repeat_words(words: Column, place_bits: int = PLACE_BITS) -> Column:
    """Number of words in three-word windows that occur twice or more."""
    size = 1 << place_bits

    def place(k):
        return k.bitwiseAND(F.lit(size - 1)).cast("int")

    def packed(w):
        def key(i):
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return h.bitwiseAND(F.lit(-size)).bitwiseOR(i.cast("bigint"))

        return F.sort_array(F.transform(_places(F.size(w)), key))

    def same_hash(x, y):
        return F.shiftright(x, place_bits) == F.shiftright(y, place_bits)

    def clash(w, s):
        """Neighbours of one hash whose words differ."""
        def differs(k, i):
            p, q = place(k), place(F.get(s, i - 1))
            other = F.lit(False)
            for d in range(3):
                other = other | (F.get(w, p + d) != F.get(w, q + d))
            return same_hash(F.get(s, i - 1), k) & other

        return F.exists(F.filter(s, differs), lambda _: F.lit(True))

    def counted(w):
        fast = let(packed(w), lambda s: let(
            _neighbours(s, same_hash),
            lambda d: F.when(F.size(d) == 0, F.lit(0).cast("bigint")).when(
                clash(w, d), _repeats_by_words(w)
            ).otherwise(_covered(F.sort_array(F.transform(d, place))))))
        return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).when(
            F.size(w) > size, _repeats_by_words(w)).otherwise(fast)

    return let(words, counted)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of ``MEASURES`` (all bigint)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    both = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words")))
    each = let(lines, lambda x: F.struct(
        F.size(x).cast("bigint").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    found = docs.select(
        *[c for c in docs.columns if c not in MEASURES and c not in ("_w", "_l")],
        both.alias("_w"), each.alias("_l"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"))
    parts = {"n_words": "_w", "word_chars": "_w", "n_repeat_words": "_w", "n_lines": "_l",
             "n_dup_lines": "_l"}
    return found.select(
        *[c for c in found.columns if c not in ("_w", "_l", "n_symbols")],
        *[F.col(f"{parts[m]}.{m}").alias(m) if m in parts else F.col(m) for m in MEASURES])


def ledger(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the measurements and ``failed_bits``, one bit for each failed rule."""
    bits = F.lit(0).cast("bigint")
    for r in rules or RULES:
        bits = bits.bitwiseOR(
            F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, text).withColumn("failed_bits", bits)


def passes(version: int = CURRENT, bits: str = "failed_bits") -> Column:
    """Whether policy ``version`` keeps the row of a ledger."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[version])).cast("bigint")) == 0


def ablations(led: DataFrame, rules: list[Rule] | None = None, version: int = CURRENT) -> DataFrame:
    """What each rule does in a policy: documents that fail it, documents that fail nothing
    else, and documents kept without it. One row per rule of the policy, one combinable
    aggregation over the distinct bit patterns; an empty ledger gives zero counts."""
    policy = mask(POLICIES[version], rules)
    kept = [r for r in rules or RULES if (policy >> r.bit) & 1]
    b = F.col("failed_bits").bitwiseAND(F.lit(policy).cast("bigint"))
    patterns = led.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def docs_where(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    sums = patterns.agg(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"),
            docs_where(F.col("b").bitwiseAND(F.lit(1 << r.bit)) != 0).alias("n_failed"),
            docs_where(F.col("b") == (1 << r.bit)).alias("n_only"),
            docs_where(F.col("b").bitwiseAND(F.lit(policy & ~(1 << r.bit))) == 0).alias("n_kept"),
        ).alias(r.name) for r in kept])
    return sums.select(F.inline(F.array(*[F.col(r.name) for r in kept])))


def query(docs: DataFrame) -> DataFrame:
    led = ledger(docs.select("doc_id", "text"))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE)).cast("bigint")) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes().alias("kept"), "failed_bits")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (
  SELECT id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t
  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)),
twice AS (SELECT id, p FROM (SELECT id, p, count(*) OVER (PARTITION BY id, t) AS c FROM tri)
          WHERE c > 1),
rep AS (SELECT id, count(DISTINCT p + k) AS n
        FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY id),
lines AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (id) LEFT JOIN lines USING (id)),
b AS (
  SELECT *, CAST(
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * word_chars < 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * word_chars > 200 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""
