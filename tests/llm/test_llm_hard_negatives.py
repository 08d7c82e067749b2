import math
import random

import numpy as np
import pytest

from inkloom.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, every=100):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        w = [max(-hn.LIMIT, min(hn.LIMIT, math.floor(256 * float(np.float32(c))))) for c in v]
        row = ((label + 1) % 10 if i % 7 == 0 else label, w)
        kept[i] = min(kept.get(i, row), row)
    sizes = [len(w) for _, w in kept.values()]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    kept = {i: r for i, r in kept.items() if len(r[1]) == d}
    out = set()
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, w, strict=True)), i, other == label)
                         for i, (other, w) in kept.items() if i != a))
        for p, i, _ in [s for s in scored if s[2]][:5]:
            fits = [(-s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p]
            out |= {(a, i, k, j, -p, s) for k, (s, j) in enumerate(fits[:10], 1)}
    return out


def result(frame, **options):
    rows = hn.mine(hn.whole_vectors(frame), **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def vector_rows():
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(12)], 1 if rng.random() < 0.4 else rng.randrange(10))
            for i in range(420)]
    same = [0.125] * 12
    rows += [(1000 + i, same, i % 3) for i in range(60)]  # ties
    rows += [rows[100], rows[5], (5, [9.0] * 12, 9), (None, same, 1), (2000, None, 1), (2100, [], 1), (2200, same, None),
             (2300, [None, *same[1:]], 1), (2400, [math.nan, *same[1:]], 1), (2500, [math.inf, *same[1:]], 1),
             (2600, same[1:], 1), (2700, [0.0] * 12, 1), (-100, same, 4), (3000, [3e38, *same[1:]], 1),
             (3100, [-0.5] * 12, 77)]
    return rows


@pytest.mark.parametrize("options", [{}, {"span": 32, "group": 64}, {"every": 10, "span": 50}])
def test_equals_brute_force(spark, vector_rows, options):
    frame = spark.createDataFrame(vector_rows, SCHEMA).selectExpr(
        "*", "1 AS row", "2 AS g", "3 AS span", "4 AS v", "5 AS score", "6 AS windows", "7 AS _h").repartition(3)
    assert result(frame, **options) == expected(vector_rows, options.get("every", 100))


def test_none_and_single(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == set()
    assert result(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == set()


def test_bounds_strike_rows_out():
    """The scan reads fewer columns than all for most rows, and loses none."""
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, (2000, 32))
    x[:, 5] *= 40
    q = rng.integers(-20, 20, 32)
    q[5] = 900
    block = hn.Block(np.arange(2000), np.zeros(2000, np.int64), x)
    seen = []
    rows, score = block.scan(q, np.arange(2000), lambda lo, hi: (
        seen.append(len(lo)), hi >= np.partition(lo, -3)[-3])[1], step=4)
    assert set(np.argsort(-(x @ q), kind="stable")[:3]) <= set(rows)
    assert (score == (x @ q)[rows]).all() and seen[1] < 1000
