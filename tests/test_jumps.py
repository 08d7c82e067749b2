"""The collinear rule by jumps against the plain walk."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from inkloom.operators import geometry as G
from inkloom.operators import jumps as J
from tests_shared import straighten_at


def vertices(spark, rings):
    rows = []
    for (p, r), pts in rings.items():
        for i, (x, y) in enumerate(pts):
            nx, ny = pts[i + 1] if i + 1 < len(pts) else (None, None)
            rows.append((p, r, i, float(x), float(y), nx, ny))
    frame = pd.DataFrame(rows, columns=["path_id", "ring", "seq", "x", "y", "nx", "ny"])
    return spark.createDataFrame(frame).selectExpr(
        "path_id", "ring", "seq", "x", "y", "nullif(nx, double('NaN')) AS nx", "nullif(ny, double('NaN')) AS ny")


def arc(n, radius, step=1.0):
    return [(radius * math.cos(step * k / radius), radius * math.sin(step * k / radius)) for k in range(n)]


def shapes():
    rng = random.Random(5)
    wander, a, x, y = [], 0.0, 0.0, 0.0
    for _ in range(400):
        wander.append((x, y))
        a += rng.uniform(-0.05, 0.05)
        x, y = x + math.cos(a), y + math.sin(a)
    noise = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(150)]
    still = [(1.0, 1.0)] * 60 + arc(200, 500) + [(7.0, 7.0)] * 40
    line = [(0.3 * k, 0.1 * k) for k in range(300)] + [(90.0, 30.0 + k) for k in range(100)]
    back = [(float(k), 0.0) for k in range(100)] + [(float(100 - k), 0.0) for k in range(100)]
    far = [(1e6 + px, -1e6 + py) for px, py in arc(300, 3000)]
    return {(1, 0): arc(700, 2000), (1, 1): wander, (2, 0): noise, (3, 0): still, (4, 0): line, (5, 0): back,
            (6, 0): far, (7, 0): [(0.0, 0.0), (1.0, 1.0)], (8, 0): arc(9, 3)}


@pytest.mark.parametrize("chunk, segment", [(16, 4), (64, 64), (1024, 4096)])
def test_jumps_equal_the_walk(spark, chunk, segment, monkeypatch):
    monkeypatch.setattr(J, "SUB", 4)
    monkeypatch.setattr(J, "TOGETHER", 1)
    rings = shapes()
    got = {}
    for r in J.kept_by_jumps(vertices(spark, rings), 0.998, chunk, segment).orderBy(
            "path_id", "ring", "seq").collect():
        got.setdefault((r.path_id, r.ring), []).append(r.seq)
    assert got == {key: straighten_at(pts) for key, pts in rings.items()}


def test_boxes_never_pass_a_bend():
    """Single boxes and merged ones say "passes" only where the plain rule keeps nothing."""
    rng = np.random.default_rng(7)
    passed = 0
    for _ in range(300):
        n = int(rng.integers(8, 60))
        a = np.cumsum(rng.normal(0, rng.choice([0.0, 0.001, 0.01, 0.1]), n)) + rng.uniform(0, 6.3)
        x, y = np.cumsum(np.cos(a)) + rng.uniform(-50, 50), np.cumsum(np.sin(a))
        nx, ny = x + np.cos(a), y + np.sin(a)
        back = rng.uniform(0, 3 * n, 20)
        px = x[0] - back * np.cos(a[0]) + rng.normal(0, 0.3, 20)
        py = y[0] - back * np.sin(a[0]) + rng.normal(0, 0.3, 20)
        fine = J.boxes(x, y, nx, ny, 4)
        for box in (fine, J.merged(fine, 3), J.boxes(x, y, nx, ny, n)):
            size = -(-n // len(box))
            size = {len(fine): 4, 1: n}.get(len(box), 12)
            for b in range(len(box)):
                ok = J.passes(px, py, np.repeat(box[b:b + 1], 20, axis=0), 0.998)
                for k in np.flatnonzero(ok):
                    part = slice(b * size, (b + 1) * size)
                    assert not J.bends(px[k], py[k], x[part], y[part], nx[part], ny[part], 0.998).any()
                    passed += 1
    assert passed > 5000


def test_rounds_on_a_smooth_arc(spark, monkeypatch):
    """An arc whose kept vertices lie several chunks apart takes rounds by the logarithm of its chunks."""
    rounds = []
    plain = J.store
    monkeypatch.setattr(J, "store", lambda df: rounds.append(1) or plain(df))
    pts = arc(60_000, 60_000)
    frame = vertices(spark, {(1, 0): pts})
    got = [r.seq for r in J.kept_by_jumps(frame, 0.998, 256).orderBy("seq").collect()]
    assert got == straighten_at(pts)
    assert len(rounds) <= 8 + 4 * math.ceil(math.log2(60_000 / 256))


def test_long_rings_go_by_jumps(spark):
    pts = arc(5000, 20_000)
    frame = vertices(spark, {(1, 0): pts}).drop("nx", "ny")
    got = [r.seq for r in G.collapse_collinear(frame, chunk=64).orderBy("seq").collect()]
    assert got == straighten_at(pts)
