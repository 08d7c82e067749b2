import hashlib
import random

import numpy as np
import pytest

from inkloom.llm import fingerprints as fp


def expected(rows):
    import xxhash

    def signed(t):
        h = xxhash.xxh64(t.encode(), seed=42).intdigest()
        return h - (1 << 64) if h >> 63 else h

    rows = sorted(((d is None, 0 if d is None else ~d, signed(t or ""), d, t or "") for d, t in rows), key=lambda r: r[:3])
    out = []
    for i, (*_, d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][4]
        k = len(text) // 3
        changed = text[:len(text) - k] + after[:k]
        prints = [fp.Ladders.of([t]).written()[0] for t in (text, changed, after)]
        out.append((d, len(text), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1],
                    fp.likeness(prints[0], prints[1]), fp.likeness(prints[0], prints[2])))
    return out


def key(row):
    return tuple((x is None, x or 0) if i == 0 else x for i, x in enumerate(row))


def result(docs, **options):
    return sorted((tuple(r) for r in fp.edited(docs, **options).collect()), key=key)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 60}])
def test_edited_chain(spark, edge_docs, edge_rows, no_docs, options, monkeypatch):
    want = sorted(expected(edge_rows), key=key)
    assert result(edge_docs, **options) == want
    monkeypatch.setattr(fp, "SLICE", 300)
    assert result(edge_docs, **options) == want
    assert result(no_docs, **options) == []


@pytest.mark.parametrize("rows", [[(1, "one text alone")], [(1, "same")] * 7, [(None, None)] * 3 + [(2, "x y z")] * 50])
def test_few_and_repeated(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(docs) == sorted(expected(rows), key=key)


def test_plain_fingerprints(spark, edge_docs, edge_rows):
    got = sorted((tuple(r) for r in fp.fingerprints(edge_docs).collect()), key=key)
    want = sorted(((d, len(t or ""), fp.Ladders.of([t or ""]).written()[0]) for d, t in edge_rows), key=key)
    assert got == want


def test_spans_and_extensions():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\U0001f600é") for _ in range(n)) for n in (0, 1, 40, 90)] + ["ab" * 60, "a" * 50]
    h = fp.PrefixHashes(texts)
    places = [(t, i) for t, x in enumerate(texts) for i in range(len(x) + 1)]
    pairs = [(rng.choice(places), rng.choice(places)) for _ in range(4000)]
    a, b = (tuple(np.array(c) for c in zip(*side, strict=True)) for side in zip(*pairs, strict=True))
    want = []
    for (t, i), (u, j) in pairs:
        n = 0
        while i + n < len(texts[t]) and j + n < len(texts[u]) and texts[t][i + n] == texts[u][j + n]:
            n += 1
        want.append(n)
    assert h.extension(a, b).tolist() == want
    assert h.equal(a, b, np.array(want)).all()


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return max([g for g in fp._GRID[:90].tolist() if g <= n], default=0)


def test_likeness_of_single_edits():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 400)))
        i, j = sorted(rng.choices(range(len(text) + 1), k=2))
        other = text[:i] + "XY" * rng.randint(0, 30) + text[j:]
        a, b = fp.Ladders.of([text, other]).written()
        got = fp.likeness(a, b)
        assert got == fp.likeness(b, a) and (got == 1) == (text == other) == (a == b)
        if text != other:
            both = common(text, other) + common(text[::-1], other[::-1])
            assert got == min(both, len(text), len(other)) / max(len(text), len(other))
            left_alone = i + len(text) - j
            assert both >= 2 ** (-1 / fp.RUNGS) * left_alone - 2
    assert fp.likeness(*fp.Ladders.of(["", "abc"]).written()) == 0
