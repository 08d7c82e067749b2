import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkloom.llm import spelling


def counted(rows, noise):
    found = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if noise and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def distance_one(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def expected(rows, noise=97):
    words = counted(rows, noise)
    near, order = defaultdict(list), sorted(words)
    for i, u in enumerate(order):
        for v in order[i + 1:]:
            if distance_one(u, v):
                near[u].append(v)
                near[v].append(u)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def result(docs, **options):
    rows = spelling.variants(docs, **options).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r[0] for r in rows})
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def word_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÿßÀ") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = []
    for w in base:
        words += [w] * rng.randint(3, 40)
        for _ in range(3):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1:], w.upper()])
            words += [v] * rng.randint(1, 9)
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 30:i * 30 + 30])) for i in range(len(words) // 30 + 1)]
    long = "q" * 3000
    return rows + [(None, None), (None, "Nulls nulls NULLS nulla"), (7, ""), (8, "tie-tie  ,;"), rows[0],
                   rows[0], (9, f"{long} {long} {long} {long[:-1]} {long[:-1]}z {long[:-1]} {long[:-1]}"),
                   (10, "éclair Éclair ÉCLAIR éclair éclair eclair eclair eclair ab×cd ab×cd ab÷cd ab×cd")]


@pytest.mark.parametrize("options", [{}, {"noise": 5}, {"noise": None, "pairs": 0}, {"symbols": 2, "pairs": 4}])
def test_equals_brute_force(spark, word_rows, options):
    docs = spark.createDataFrame(word_rows, "doc_id bigint, text string").selectExpr(
        "*", "'x' AS word", "1 AS n", "2 AS key", "3 AS d", "4 AS reduced", "5 AS root").repartition(3)
    assert result(docs, **options) == expected(word_rows, options.get("noise", 97))


def test_edge_rows_and_none(spark, edge_docs, edge_rows, no_docs):
    assert result(edge_docs) == expected(edge_rows)
    assert result(no_docs) == set()


def test_chain_of_forms(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(i, " ".join([w] * 3 * 2**i)) for i, w in enumerate(words)]
    got = {r[0]: r[1:3] for r in result(spark.createDataFrame(rows, "doc_id bigint, text string"), noise=None)}
    assert got == {w: (words[min(i + 1, 5)] if i < 5 else None, "bbbbb") for i, w in enumerate(words)}


def test_very_long_text_counts_alike(spark, monkeypatch, word_rows):
    docs = spark.createDataFrame(word_rows, "doc_id bigint, text string").coalesce(1)
    whole = {tuple(r) for r in spelling.count_words(docs).collect()}
    monkeypatch.setattr(spelling, "LONG", 20)
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    monkeypatch.setattr(spelling, "SLICE", 100)
    assert {tuple(r) for r in spelling.count_words(docs).collect()} == whole == set(counted(word_rows, 97).items())


def test_neighbourhood_is_full():
    rng = random.Random(2)
    for _ in range(20):
        r = [rng.randrange(3) for _ in range(rng.randint(1, 6))]
        edits = {tuple(r)} | {tuple(r[:i] + r[i + 1:]) for i in range(len(r))}
        edits |= {(*r[:i], x, *r[i + 1:]) for i in range(len(r)) for x in range(3)}
        edits |= {(*r[:i], x, *r[i:]) for i in range(len(r) + 1) for x in range(3)}
        keys = {int(spelling.word_keys(np.array([e], np.int64), 3)[0]) if e else 0 for e in edits}
        assert set(spelling.neighbourhood(np.array([r], np.int64), 3)[0].tolist()) == keys


def test_crowded_words_meet_once(spark):
    """All words of one reduced class: the bounded way finds the same pairs."""
    same = [c for c in range(97, 123) if spelling.letter_symbol(c) == spelling.letter_symbol(97)]
    rng = random.Random(4)
    words = sorted({"".join(chr(rng.choice(same)) for _ in range(5)) for _ in range(150)})
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    want = {(u, v) for i, u in enumerate(words) for v in words[i + 1:] if distance_one(u, v)}
    for pairs in (10, 100_000):
        assert {(r.u, r.v) for r in spelling.near_words(frame, pairs=pairs).collect()} == want


def test_counting_holds_little():
    """A task's dictionary is emptied early and its slices are small: its peak is a fraction of its input."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(500)) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    try:
        seen = sum(out.num_rows for out in spelling._counted(iter([batch]), None))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen >= 299_000
    assert peak < 18 << 20
