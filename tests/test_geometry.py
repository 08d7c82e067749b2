"""Outline operators against plain Python, with small blocks so that borders are crossed."""

import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkloom.functions import svg as S
from inkloom.operators import geometry as G
from inkloom.plans.spread import number_rows, scratch, store


def vertex_df(spark, rings):
    rows = [(p, 0, i, float(x), float(y)) for p, pts in rings.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "path_id long, ring long, seq long, x double, y double")


def by_path(df):
    out = {}
    for r in df.orderBy("path_id", "ring", "seq").collect():
        out.setdefault(r.path_id, []).append((r.x, r.y))
    return out


def circle(n, r=40.0, cx=100.0, cy=100.0, close=True):
    pts = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return pts + [pts[0]] if close else pts


def split(points, eps):
    """Recursive farthest-point simplification, first maximum wins."""
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    dx, dy = bx - ax, by - ay
    span = math.sqrt(dx * dx + dy * dy) or 1.0
    d = [abs(dy * x - dx * y + bx * ay - by * ax) / span for x, y in points[1:-1]]
    if max(d) <= eps:
        return [points[0], points[-1]]
    m = d.index(max(d)) + 1
    return split(points[:m + 1], eps)[:-1] + split(points[m:], eps)


def straighten(points):
    if len(points) < 3:
        return points
    out = [points[0]]
    for p, q in zip(points[1:-1], points[2:]):
        u, v = (p[0] - out[-1][0], p[1] - out[-1][1]), (q[0] - p[0], q[1] - p[1])
        n1, n2 = math.sqrt(u[0] ** 2 + u[1] ** 2), math.sqrt(v[0] ** 2 + v[1] ** 2)
        if n1 >= 1e-9 and n2 >= 1e-9 and (u[0] * v[0] + u[1] * v[1]) / (n1 * n2) < 0.998:
            out.append(p)
    return out + [points[-1]]


def walk(seed, n, step=1.0):
    rnd = random.Random(seed)
    x = y = a = 0.0
    pts = []
    for _ in range(n):
        pts.append((round(x, 3), round(y, 3)))
        a += rnd.uniform(-0.3, 0.3) if rnd.random() < 0.4 else 0.0
        x, y = x + step * math.cos(a), y + step * math.sin(a)
    return pts


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 8)
    monkeypatch.setattr(G._block, "__defaults__", (8,))


def test_collapse_chunks_agree_with_one_pass(spark, small_blocks):
    rings = {1: walk(1, 100), 2: [(k, 0) for k in range(40)], 3: walk(3, 7), 4: [(0, 0), (1, 1)],
             5: [(0, 0)] * 5 + [(k, 0.02 * k * k) for k in range(60)]}
    df = vertex_df(spark, rings)
    got = by_path(G.collapse_collinear(df, chunk=8))
    assert got == {p: straighten([(float(x), float(y)) for x, y in pts]) for p, pts in rings.items()}


def test_collapse_needs_few_rounds_at_any_length(spark, monkeypatch):
    """A straight line and a smooth arc of 100,000 vertices, against one pass."""
    n, radius = 100_000, 400.0
    line = [(float(k), 0.0) for k in range(n)]
    arc = [(radius * math.cos(k / radius), radius * math.sin(k / radius)) for k in range(n)]
    rounds = []
    plain = G.checkpoint
    monkeypatch.setattr(G, "checkpoint", lambda df: rounds.append(1) or plain(df))
    frame = pd.DataFrame({
        "path_id": np.repeat([1, 2], n), "ring": 0, "seq": np.tile(np.arange(n), 2),
        "x": [p[0] for p in line + arc], "y": [p[1] for p in line + arc]})
    got = by_path(G.collapse_collinear(spark.createDataFrame(frame)))
    assert got == {1: straighten(line), 2: straighten(arc)}
    assert len(rounds) <= 4


def test_simplify_rounds_and_batches_agree(spark, small_blocks, monkeypatch):
    rings = {1: walk(1, 120), 2: walk(2, 64), 3: [(0, 0), (5, 9), (10, 0)], 4: [(0, 0), (1, 1)], 5: [(3, 3)]}
    df = vertex_df(spark, rings)
    want = {p: split([(float(x), float(y)) for x, y in pts], 1.25) for p, pts in rings.items()}
    assert by_path(G.simplify_polyline(df)) == want
    monkeypatch.setattr(G, "SMALL_SEGMENT", 10)
    assert by_path(G.simplify_polyline(df)) == want


def test_simplify_ring_cases(spark):
    square = [(0, 0), (5, 0), (10, 0), (10, 5), (10, 10), (5, 10), (0, 10), (0, 5), (0, 0)]
    rings = {1: square, 2: [(0, 0), (5, 0.1), (10, 0)], 3: [(0, 0), (4, 0), (0, 0)], 4: [(1, 1), (2, 2)]}
    got = by_path(G.simplify_ring(vertex_df(spark, rings)))
    assert got[1] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert got[2] == [(0, 0), (10, 0)]
    assert got[3] == [(0, 0), (4, 0), (0, 0)]
    assert got[4] == [(1, 1), (2, 2)]


def test_ring_measures(spark, small_blocks):
    rings = {1: circle(64), 2: [(0, 0), (10, 0), (10, 10), (0, 10)], 3: circle(20)}
    got = {r.path_id: r for r in G.ring_metrics(vertex_df(spark, rings)).collect()}
    assert got[2].area == 100 and got[2].perimeter == 40 and not got[2].closed
    assert got[1].area == pytest.approx(64 / 2 * 1600 * math.sin(2 * math.pi / 64))
    assert got[1].n_points == 64 and got[1].circularity > 0.99


def test_circle_fit(spark, small_blocks):
    rings = {1: circle(30, close=False), 2: [(k, 2 * k) for k in range(12)], 3: circle(7, close=False),
             4: circle(12, r=1.0, close=False), 5: [(x * 1.0, y * 0.3) for x, y in circle(40, close=False)]}
    got = {r.path_id: (r.cx, r.cy, r.r) for r in G.fit_circle(vertex_df(spark, rings)).collect()}
    assert set(got) == {1}
    assert got[1] == pytest.approx((100, 100, 40))
    found = G.circle_candidates(vertex_df(spark, {1: circle(30), 2: circle(10), 3: circle(30, r=10)}), 200 * 200)
    assert [r.path_id for r in found.collect()] == [1]


def docs(spark, *paths):
    return spark.createDataFrame(
        [(i, f'<svg><path d="{d}"/></svg>') for i, d in enumerate(paths)], "path_id long, svg string")


def rings_of(df):
    out = {}
    for r in df.orderBy("path_id", "path_no", "ring", "seq").collect():
        out.setdefault(r.path_id, {}).setdefault(r.ring, []).append((round(r.x, 6), round(r.y, 6)))
    return {k: list(v.values()) for k, v in out.items()}


def bezier(p0, p1, p2, p3, n=6):
    pts = []
    for k in range(1, n + 1):
        t, u = k / n, 1 - k / n
        pts.append(tuple(round(u**3 * a + 3 * u * u * t * b + 3 * u * t * t * c + t**3 * d, 6)
                         for a, b, c, d in zip(p0, p1, p2, p3)))
    return pts


@pytest.mark.parametrize("tokens", [512, 3])
def test_path_commands(spark, monkeypatch, tokens):
    monkeypatch.setattr(G, "TOKENS", tokens)
    got = rings_of(G.path_vertices(docs(
        spark,
        "M 0 0 10,0 l 0 5 H 2 v -1 h -1 V 0 Z m 3 3 l 1 1 z",         # lines, restart after close
        "m1 1c1 0 2 1 3 3s2 2 4 4q1 1 2 0",                             # curves, relative
        "M0 0A5 5 0 0 1 10 0L3 3",                                      # arc: its end point
        "M 0 0 L 1 1 T 5 5 L 9 9",                                      # T stops the path
        "M 0 0 L 4 4 L 5",                                              # malformed tail
        "M 0 0 L 1 1 Z 7 7 L 8 8",                                      # number after close
        "M 1 1 M 2 2 L 3 3 L Z L 9 9",                                  # single point, bare L
        "5 5 6 6 7 7",                                                  # numbers first
        "M 0 0 L 2 0 L 2 2 Z L 5 5 L 6 6",                              # drawing on after close
        "M 4 4 m 1 1 l 1 0",                                            # relative start
    )))
    assert got[0] == [[(0, 0), (10, 0), (10, 5), (2, 5), (2, 4), (1, 4), (1, 0), (0, 0)],
                      [(3, 3), (4, 4), (3, 3)]]
    c = bezier((1, 1), (2, 1), (3, 2), (4, 4))
    s = bezier((4, 4), (4, 4), (6, 6), (8, 8))
    p0, q, p3 = (8, 8), (9, 9), (10, 8)
    mix = [tuple(a + 2 / 3 * (b - a) for a, b in zip(p, q)) for p in (p0, p3)]
    assert got[1] == [[(1, 1), *c, *s, *bezier(p0, mix[0], mix[1], p3, 5)]]
    assert got[2] == [[(0, 0), (10, 0), (3, 3)]]
    assert got[3] == [[(0, 0), (1, 1)]]
    assert got[4] == [[(0, 0), (4, 4)]]
    assert got[5] == [[(0, 0), (1, 1), (0, 0)]]
    assert got[6] == [[(2, 2), (3, 3)]]
    assert got[7] == [[(5, 5), (6, 6), (7, 7)]]
    assert got[8] == [[(0, 0), (2, 0), (2, 2), (0, 0)], [(5, 5), (6, 6)]]
    assert got[9] == [[(5, 5), (6, 5)]]


def walked(rng, n):
    """A random path's text with the rings that it draws."""
    text, rings, ring, x, y, sx, sy = [], [], [], 0.0, 0.0, 0.0, 0.0
    for i in range(n):
        c = "M" if i == 0 else rng.choice("MmLlHhVvZzCcQqSsAa" + "Ll" * 12)
        rel, low = c.islower(), c.lower()
        if low == "z":
            text.append(c)
            if ring and ring[0] != ring[-1]:
                ring.append(ring[0])
            rings.append(ring)
            ring, x, y = [], sx, sy
            continue
        count = {"m": 1, "c": 3, "s": 2, "q": 2, "a": 1}.get(low, 1)
        v = [(rng.randint(-40, 40) / 4, rng.randint(-40, 40) / 4) for _ in range(count)]
        off = (x, y) if rel else (0.0, 0.0)
        to = [(a + off[0], b + off[1]) for a, b in v]
        if low == "h":
            text.append(f"{c}{v[0][0]}")
            end = to[0][0], y
        elif low == "v":
            text.append(f"{c} {v[0][1]}")
            end = x, to[0][1]
        else:
            text.append(c + ("3 3 0 0 1 " if low == "a" else "") + " ".join(f"{a},{b}" for a, b in v))
            end = to[-1]
        if low == "m":
            rings.append(ring)
            ring, (sx, sy) = [], end
        here = x, y
        if low in "csq":
            if low == "q":
                mid = [tuple(p + 2 / 3 * (q - p) for p, q in zip(e, to[0])) for e in (here, end)]
            else:
                mid = to[:2] if low == "c" else [here, to[0]]
            ring += bezier(here, mid[0], mid[1], end, 5 if low == "q" else 6)
        else:
            ring.append(end)
        x, y = end
    return " ".join(text), [r for r in [*rings, ring] if len(r) >= 2]


@pytest.mark.parametrize("tokens", [512, 8, 1])
def test_random_paths_in_blocks(spark, monkeypatch, tokens):
    monkeypatch.setattr(G, "TOKENS", tokens)
    rng = random.Random(12)
    made = [walked(rng, n) for n in (1, 2, 5, 40, 90, 150)]
    got = rings_of(G.path_vertices(docs(spark, *(t for t, _ in made))))
    for i, (_, rings) in enumerate(made):
        assert [[(round(x, 4), round(y, 4)) for x, y in r] for r in got.get(i, [])] == [
            [(round(x, 4), round(y, 4)) for x, y in r] for r in rings]


def test_long_path_spans_blocks(spark):
    n = 9 * G.TOKENS + 5
    got = rings_of(G.path_vertices(docs(spark, "m 0 0" + " l 1 2" * n)))
    assert got[0] == [[(k, 2 * k) for k in range(n + 1)]]


def test_ring_text_is_joined_from_blocks(spark, small_blocks):
    rings = {1: circle(50, r=90), 2: [(k * 3.0, (k % 2) * 9.0) for k in range(70)], 3: [(0, 0), (1, 1)]}
    got = {r.path_id: r.d for r in G.normalize_paths(vertex_df(spark, rings), "basic").collect()}
    kept = by_path(G.simplify_ring(vertex_df(spark, rings), tolerance=G.CLOSE_TOLERANCE))
    for p, points in kept.items():
        line = " ".join(f"{'L' if i else 'M'} {x:.2f} {y:.2f}" for i, (x, y) in enumerate(points))
        assert got[p] == line + (" Z" if p == 1 else "")
    assert len(kept[2]) == 70


def test_wavy_path_becomes_lines(spark):
    d = "M 0 0 " + " ".join(
        f"C {i + 1} {0.2 if i % 2 else -0.2} {i + 2} {0.2 if i % 2 else -0.2} {i + 3} 0" for i in range(0, 30, 3))
    points = G.path_vertices(docs(spark, d)).drop("path_no")
    out = G.normalize_paths(points, "basic").first().d
    assert "L " in out and "C" not in out and out.startswith("M 0.00 0.00")


def test_strict_level_writes_arcs(spark):
    df = vertex_df(spark, {1: circle(60, r=80), 2: [(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)]})
    got = {r.path_id: r.d for r in G.normalize_paths(df, "strict").collect()}
    assert " A " in got[1] and got[1].endswith("Z")
    assert got[2] == "M 0.00 0.00 L 40.00 0.00 L 40.00 40.00 L 0.00 40.00 L 0.00 0.00 Z"


@pytest.mark.parametrize("svg,nodes", [
    ('<svg><path d="M 0 0 L 10 10 C 15 15 20 20 25 25 Z"/></svg>', 4),
    ('<svg><path d="M 0 0 L 1 1"/><path d="M 2 2 C 3 3 4 4 5 5 Q 6 6 7 7 Z"/></svg>', 6),
    ('<svg><path d=""/></svg>', 0),
])
def test_node_counts(spark, svg, nodes):
    df = spark.createDataFrame([(svg,)], "svg string")
    assert df.select(S.svg_node_count(F.col("svg"))).first()[0] == nodes


def test_svg_rescale_and_fills(spark):
    svg = '<?xml?><svg width="200" height="100.5"><rect width="7" fill="#F0F0F0"/><g fill="#102030"/></svg>'
    df = spark.createDataFrame([(svg,)], "svg string")
    out = df.select(S.svg_rescale(F.col("svg"), F.lit(2.0), F.lit(50), F.lit(25)).alias("s"),
                    S.svg_rescale(F.col("svg"), F.lit(1.0), F.lit(50), F.lit(25)).alias("same"),
                    S.svg_fill_colors(F.col("svg")).alias("f")).first()
    assert out.same == svg and out.f == ["#102030"]
    assert out.s == ('<?xml?><svg width="50" height="25">\n<g transform="scale(0.500000, 0.500000)">'
                     '<rect width="50" fill="#F0F0F0"/><g fill="#102030"/></g>\n</svg>')


def test_number_rows_by_bucket(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"),
                                  F.floor(F.col("id") / 70).alias("bucket"))
    got = number_rows(df, ["k"], "bucket", ["v"], "n").collect()
    assert all(r.i == r.v // 3 and r.n == (334 if r.k == 0 else 333) for r in got)


def test_ring_facts_are_never_broadcast(spark, tmp_path):
    """Facts grow with the rings, and a few bytes of Parquet may hold many."""
    vertex_df(spark, {k: circle(20) for k in range(9)}).write.parquet(str(tmp_path / "v"))
    points = spark.read.parquet(str(tmp_path / "v"))
    docs = points.groupBy("path_id").agg(F.first(F.lit('<svg><path d="M 0 0 L 9 0 L 9 9 Z"/></svg>')).alias("svg"))
    plans = [G.fit_circle(G.ring_body(points)), G.circle_candidates(points), G.simplify_polyline(points),
             G.collapse_collinear(points), G.simplify_ring(points), G.normalize_paths(points, "strict"),
             G.path_vertices(docs), G.normalize_documents(docs, "basic")]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_path_texts_are_split_once(spark):
    """Both sides of the tokens' join read a stored table; splitting a text twice is the dearest step twice."""
    paths = spark.createDataFrame([(1, 0, "M 0 0 L 4 0 L 4 4 Z")], "path_id long, path_no int, d string")
    steps = G._path_steps(paths, ["path_id", "path_no"])
    assert "regexp_extract_all" not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count() == 4


def test_short_paths_follow_the_rules_of_blocks(spark, monkeypatch):
    """Whole paths give each vertex of the blocks, to the last bit; malformed, repeated and null ones too."""
    rng = random.Random(4)
    noise = ["M", "m", "L", "z", "Z", "T", "h", "C", " 1", " -2.5", " .5", " 3.", ",-0", " 1e2", " 1e400"]
    texts = [walked(rng, rng.randint(1, 40))[0] for _ in range(60)] + [
        "".join(rng.choice(noise) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    made = [(i, f'<svg><path d="{t}"/><path d="{texts[i - 1]}"/></svg>') for i, t in enumerate(texts)]
    rows = spark.createDataFrame([*made, made[3], (None, made[4][1]), (7, None), (500, "<svg/>")], "path_id long, svg string")

    def found() -> list:
        return sorted((r.path_id, *(v if isinstance(v, int) else v.hex() for v in r[1:]))
                      for r in G.path_vertices(rows).collect())

    whole = found()
    monkeypatch.setattr(G, "TOKEN_CHARS", 0)
    assert whole == found() and len(whole) > 1000


def test_whole_rings_follow_the_rules_of_blocks(spark):
    rng = random.Random(6)
    rings = {k: [(rng.randint(-4, 4) * 1.0, rng.randint(-4, 4) * 1.0) for _ in range(k % 40 + 1)] for k in range(80)}
    rings |= {100 + k: circle(k + 3, r=30.0) for k in range(30)} | {200: [(0.0, 0.0), (9.0, 0.0), (0.2, 0.0)]}
    rings |= {300: [(k * 1.0, rng.random() * 9) for k in range(G.BLOCK // 4 + 1)]}  # goes by blocks
    df = vertex_df(spark, rings)
    df = df.unionByName(df.filter("path_id = 30")).unionByName(df.filter("path_id = 31").selectExpr(
        "CAST(NULL AS BIGINT) AS path_id", "ring", "seq", "x", "y"))
    for tolerance in (G.SAME_POINT, G.CLOSE_TOLERANCE):
        want = G._simplify_by_blocks(df, G.RDP_EPSILON, tolerance)
        got = G.simplify_ring(df, tolerance=tolerance)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ordinary_documents_take_little_disk(spark, monkeypatch):
    """Tokens, steps and states of short paths are never stored: what is, takes twice the texts (11 times before)."""
    rng = random.Random(8)
    made = ["M " + " L ".join(f"{rng.random() * 90:.2f} {rng.random() * 90:.2f}" for _ in range(40)) + " Z" for _ in range(400)]
    rows = docs(spark, *made)
    with scratch(spark) as folder:
        monkeypatch.setattr(G, "checkpoint", store)
        out = G.normalize_documents(rows, "basic").collect()
        taken = sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    assert len(out) == 400 and taken < 4 * sum(map(len, made))
