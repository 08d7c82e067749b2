"""Mask comparison, edges, distances and regions, also across strip borders."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkloom.operators import labels as L
from inkloom.operators import quality as Q
from inkloom.operators import regions as R
from inkloom.plans import spread


def cells(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def palette_df(spark, ids, colours):
    return spark.createDataFrame(
        [(i, 1, 1, [(k, *c) for k, c in enumerate(colours)]) for i in ids],
        "image_id long, w long, h long, palette array<struct<slot:long,r:long,g:long,b:long>>")


@pytest.mark.parametrize("ref,out,want", [
    ([0, 1, 2], [0, 1, 2], {(0, 0), (1, 1), (2, 2)}),
    ([0, 1], [0], {(0, 0)}),
    ([0, 1], [0, 2], {(0, 0), (1, 2)}),
])
def test_greedy_pairing(spark, ref, out, want):
    rows = [(1, r, o, 1) for r in ref for o in out]
    table = spark.createDataFrame(rows, "image_id long, ref_slot long, out_slot long, n long")
    pal = palette_df(spark, [1], [(255, 0, 0), (0, 255, 0), (0, 0, 255)])
    assert cells(Q.pair_palettes(table, pal), "ref_slot", "out_slot") == want


def test_pairing_is_greedy_in_reference_order(spark):
    # Slot 0 is absent in the output, so it takes slot 1 although slot 1 matches it exactly.
    table = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 1, 5)],
                                  "image_id long, ref_slot long, out_slot long, n long")
    pal = palette_df(spark, [1], [(250, 0, 0), (255, 0, 0)])
    assert cells(Q.pair_palettes(table, pal), "ref_slot", "out_slot") == {(0, 1)}
    masks = Q.mask_iou(table, Q.pair_palettes(table, pal))
    row = Q.sample_iou(table, masks).first()
    assert row.iou_unmatched == 1 and row.iou_mean == 0.5


def test_mask_areas_and_xor(spark, labels):
    ref = labels({1: ["aab", "aab", "bbb"]})
    out = labels({1: ["abb", "aab", "bbb"]})
    pairs = Q.pair_labels(ref, out)
    table = Q.contingency(pairs)
    assert table.agg(F.sum("n")).first()[0] == 9
    pal = palette_df(spark, [1], [(i, i, i) for i in range(100)])
    masks = Q.mask_iou(table, Q.pair_palettes(table, pal)).cache()
    got = {r.ref_slot: (r.iou, r.area_px) for r in masks.collect()}
    assert got == {97: (0.75, 4), 98: (0.8333, 5)}
    assert masks.agg(F.sum("area_pct")).first()[0] == pytest.approx(100, abs=0.02)
    assert cells(Q.xor_mask(pairs, masks, 0.8), "x", "y", "slot") == {(1, 0, 97)}


def test_edges_uniform_and_split(labels):
    got = Q.edge_map(labels({1: ["a" * 30] * 30, 2: ["a" * 20 + "b" * 20] * 40}))
    assert cells(got, "image_id", "x") == {(2, 19), (2, 20)}


def random_lines(seed, w, h, alphabet="ab"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(w)) for _ in range(h)]


def brute_edges(lines):
    h, w = len(lines), len(lines[0])
    return {
        (x, y) for y in range(h) for x in range(w)
        if any(0 <= x + i < w and 0 <= y + j < h and lines[y + j][x + i] != lines[y][x]
               for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))}


def test_edges_across_strips(labels):
    lines = ["a" * 11] * 40
    for y in (7, 8, 15, 16, 30):
        lines[y] = random_lines(y, 11, 1)[0]
    got = Q.edge_map(labels({1: lines}), strip_pixels=88)
    assert cells(got, "x", "y") == brute_edges(lines)


def dots(spark, points, w, h, image=1):
    return spark.createDataFrame([(image, x, y, w, h) for x, y in points],
                                 "image_id long, x long, y long, w long, h long")


def brute_nearest(a, b):
    return {(x, y, min((x - u) ** 2 + (y - v) ** 2 for u, v in b)) for x, y in a}


@pytest.mark.parametrize("a,b", [
    ([(x, 10) for x in range(10, 20)], [(x, 10) for x in range(10, 20)]),
    ([(x, 20) for x in range(10, 30)], [(x, 25) for x in range(10, 30)]),
    ([(0, 0), (5, 5), (59, 299)], [(59, 0)]),
    ([(30, 0)], [(0, 40), (30, 51), (59, 41)]),
])
def test_nearest_edge_is_exact(spark, a, b):
    got = Q.nearest_edge(dots(spark, a, 60, 300), dots(spark, b, 60, 300))
    assert cells(got, "x", "y", "d2") == brute_nearest(a, b)


def test_nearest_edge_random(spark):
    rnd = random.Random(5)
    a, b = ({(rnd.randrange(40), rnd.randrange(90)) for _ in range(n)} for n in (60, 9))
    got = Q.nearest_edge(dots(spark, a, 40, 90), dots(spark, b, 40, 90), strip_pixels=400)
    assert cells(got, "x", "y", "d2") == brute_nearest(a, b)


@pytest.mark.parametrize("band", [range(192, 256), [255]])
def test_far_targets_make_no_more_rows_than_pixels(spark, band):
    """Targets far from all queries: no row per pair, and no task gets more than a strip."""
    side, strip_pixels = 256, 256 * 32
    a = [(x, y) for x in range(side) for y in range(64)]
    b = [(x, y) for x in range(side) for y in band]
    queries, targets = dots(spark, a, side, side), dots(spark, b, side, side)
    table = Q._strip_table(queries, targets, ["image_id"], strip_pixels)
    per_strip = table.groupBy("image_id", "strip").count().collect()
    assert sum(r["count"] for r in per_strip) <= len(a) + len(b) + side * side // 32
    assert max(r["count"] for r in per_strip) <= 2 * strip_pixels + side
    got = Q.nearest_edge(queries, targets, strip_pixels=strip_pixels).collect()
    assert len(got) == len(a)
    assert all(r.d2 == (min(band) - r.y) ** 2 for r in got)


@pytest.mark.parametrize("cells,tables", [(1 << 20, 1), (1, 30)])
def test_strips_of_a_frame_are_worked_on_together(monkeypatch, cells, tables):
    """Strips of different heights and columns share one table, unless it grows beyond its cells; their
    targets lie inside, above or below, and queries of a strip without targets have no answer."""
    rnd = random.Random(3)
    rows, want = [], set()
    for strip in range(31):
        w, h, top = rnd.randrange(1, 20), rnd.randrange(1, 20), rnd.randrange(1, 30)
        inside = {(rnd.randrange(w), top + rnd.randrange(h)) for _ in range(rnd.randrange(1, 6))}
        above, below = rnd.randrange(top), top + h + rnd.randrange(9)
        goals = inside | {(0, above), (0, below)} if strip != 7 else set()
        asked = {(rnd.randrange(w), top + rnd.randrange(h)) for _ in range(20)}
        rows += [(strip, 0, x, y, -1) for x, y in asked]
        if goals:
            rows += [(strip, 1, x, y, -1) for x, y in inside] + [(strip, 2, 0, above, below)]
            want |= {(strip, *found) for found in brute_nearest(asked, goals)}
    frame = pd.DataFrame(rows, columns=["strip", "kind", "x", "y", "below"])
    calls, work = [], Q._table_nearest
    monkeypatch.setattr(Q, "_table_nearest", lambda *a: calls.append(1) or work(*a))
    got = Q._strips_nearest(frame, frame["strip"].to_numpy(), cells)
    assert set(got[["strip", "x", "y", "d2"]].itertuples(index=False, name=None)) == want
    assert len(calls) == tables


def test_chamfer_shift_and_empty(spark):
    line = [(x, 20) for x in range(10, 30)]
    moved = [(x, 25) for x in range(10, 30)]
    rows = [(1, x, y, 60, 60, True, False) for x, y in line]
    rows += [(1, x, y, 60, 60, False, True) for x, y in moved]
    rows += [(2, x, y, 60, 60, True, True) for x, y in line]
    rows += [(3, x, y, 60, 60, False, True) for x, y in line]
    edges = spark.createDataFrame(
        rows, "image_id long, x long, y long, w long, h long, ref_edge boolean, out_edge boolean")
    images = spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id long")
    got = {r.image_id: r.chamfer for r in Q.chamfer(edges, images).collect()}
    assert got == {1: 5.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_salted_join_equals_broadcast(spark, raster, monkeypatch):
    px = raster({1: (6, 50, lambda x, y: (y * 5, 0, 0)), 2: (4, 3, lambda x, y: (0, 0, 9))})
    pal = spark.createDataFrame(
        [(1, 6, 50, [(0, 0, 0, 0), (1, 255, 0, 0)]), (2, 4, 3, [(0, 0, 0, 0)])],
        "image_id long, w long, h long, palette array<struct<slot:long,r:long,g:long,b:long>>")
    want = cells(L.assign_nearest(px, pal), "image_id", "x", "y", "slot")
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    salted = L.assign_nearest(px, pal, strip_pixels=48)
    assert "_strip" in salted._jdf.queryExecution().toString()
    assert cells(salted, "image_id", "x", "y", "slot") == want


# --- regions ------------------------------------------------------------------------------


def brute_components(lines):
    h, w = len(lines), len(lines[0])
    seen, out = {}, set()
    for y in range(h):
        for x in range(w):
            if lines[y][x] == "." or (x, y) in seen:
                continue
            name, todo = y * w + x, [(x, y)]
            seen[x, y] = name
            while todo:
                u, v = todo.pop()
                for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                    p = (u + i, v + j)
                    if 0 <= p[0] < w and 0 <= p[1] < h and p not in seen and lines[p[1]][p[0]] == lines[v][u]:
                        seen[p] = name
                        todo.append(p)
    return {(x, y, n) for (x, y), n in seen.items()}


def mask(labels_df):
    return labels_df.select("image_id", "x", "y", "w", "h",
                            F.when(F.col("slot") != ord("."), F.col("slot")).alias("c"))


SPIRAL = [
    "aaaaaaaaa", "........a", "aaaaaaa.a", "a.....a.a", "a.aaa.a.a", "a.a...a.a", "a.aaaaa.a",
    "a.......a", "aaaaaaaaa", "........a", "aaaaaaa.a", "a.....a.a", "a.aaa.a.a", "a.a...a.a",
    "a.aaaaa.a", "a.......a", "aaaaaaaaa", "b.......b", "b.b.b.b.b", "bbb.bbb.b",
]


@pytest.mark.parametrize("strip_pixels", [72, 1 << 18])
def test_components_spiral_and_noise(labels, strip_pixels):
    images = {1: SPIRAL, 2: random_lines(1, 9, 33, "ab."), 3: ["." * 4] * 4, 4: ["a" * 3] * 50}
    got = R.region_pixels(R.connected_components(mask(labels(images)), strip_pixels)).cache()
    for i, lines in images.items():
        assert cells(got.filter(F.col("image_id") == i), "x", "y", "region") == brute_components(lines)


def brute_opening(lines):
    h, w = len(lines), len(lines[0])
    disk = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) <= 2]

    def at(x, y):
        return lines[y][x] if 0 <= x < w and 0 <= y < h else None

    core = {(x, y) for y in range(h) for x in range(w) if lines[y][x] != "."
            and all(at(x + i, y + j) == lines[y][x] for i, j in disk)}
    return {(x + i, y + j) for x, y in core for i, j in disk}


@pytest.mark.parametrize("strip_pixels", [96, 1 << 18])
def test_opening_across_strips(labels, strip_pixels):
    lines = [list("a" * 12) for _ in range(40)]
    rnd = random.Random(2)
    for _ in range(22):
        lines[rnd.randrange(40)][rnd.randrange(12)] = rnd.choice(".b")
    lines = ["".join(v) for v in lines]
    got = R.binary_opening(mask(labels({1: lines})), strip_pixels)
    assert cells(got, "x", "y") == brute_opening(lines)


def test_disk_is_recognised_and_snapped(raster):
    ink, white = (10, 20, 200), (255, 255, 255)

    def paint(x, y):
        d = math.hypot(x - 40, y - 40)
        return ink if d <= 25 + (0.8 if x % 2 else 0) and not (38 <= x <= 42 and 38 <= y <= 42) else white

    px = raster({1: (81, 81, paint), 2: (81, 81, lambda x, y: ink if x < 40 else white)})
    regions = R.connected_components(R.binary_opening(R.with_ink_code(px)), 800)
    stats = R.region_stats(regions).cache()
    assert cells(stats.filter("is_disk"), "image_id") == {(1,)}
    d = stats.filter("is_disk").first()
    frame = sum((x - d.cx) ** 2 + (y - d.cy) ** 2 <= d.radius ** 2 for x in range(81) for y in range(81))
    assert d.fill == pytest.approx(d.area / frame)
    out = R.snap_disks(px, stats).cache()
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in out.filter("image_id = 1").collect()}
    for (x, y), colour in got.items():
        d2 = (x - d.cx) ** 2 + (y - d.cy) ** 2
        if paint(x, y) == white:
            assert colour == white
        elif d2 <= d.radius ** 2:
            assert colour == ink
        elif d2 <= (1.05 * d.radius) ** 2:
            assert colour == white
    untouched = {(r.x, r.y): (r.r, r.g, r.b) for r in out.filter("image_id = 2").collect()}
    assert all(untouched[x, y] == (ink if x < 40 else white) for x, y in untouched)


def test_disks_keep_text_holes_and_alpha(spark):
    """Overlapping disks over text-like holes and varying alpha, against the rule pixel by pixel."""
    rng = random.Random(3)
    w, h = 61, 47
    inks = [(10, 20, 200), (200, 30, 10)]
    codes = [r * 65536 + g * 256 + b for r, g, b in inks]
    disks = [(codes[0], 5, 20.5, 22.0, 17.325), (codes[0], 90, 41.0, 24.5, 12.0), (codes[1], 7, 30.0, 40.0, 11.385)]
    source = {}
    for y in range(h):
        for x in range(w):
            near = [i for i, d in enumerate(disks) if (x - d[2]) ** 2 + (y - d[3]) ** 2 <= (d[4] * 1.08) ** 2]
            colour = inks[near[0] % 2] if near and rng.random() > 0.2 else (255, 255, 252)
            source[x, y] = (*colour, rng.choice([0, 255, 255, 255, 130]))
    px = spark.createDataFrame(
        [(1, x, y, w, h, *c) for (x, y), c in source.items()] + [(2, 0, 0, 1, 1, 9, 9, 9, 7)],
        "image_id long, x long, y long, w long, h long, r long, g long, b long, a long")
    stats = spark.createDataFrame(
        [(1, *d, w, h, True) for d in disks] + [(1, codes[1], 1, 5.0, 5.0, 9.0, w, h, False)],
        "image_id long, c long, region long, cx double, cy double, radius double, w long, h long, is_disk boolean")
    want = {}
    for (x, y), (r, g, b, a) in source.items():
        now, own, white = (r, g, b), r * 65536 + g * 256 + b, min(r, g, b) >= 250
        for c, _, cx, cy, radius in sorted(disks):
            d2 = (x - cx) ** 2 + (y - cy) ** 2
            if own == c and d2 <= (radius * 1.05) ** 2:
                now = (255, 255, 255)
            if d2 <= radius**2:
                now = (255, 255, 255) if white else (c >> 16, c >> 8 & 255, c & 255)
        want[x, y] = (*now, a)
    out = R.snap_disks(px, stats).collect()
    assert {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in out if r.image_id == 1} == want
    assert [(r.r, r.g, r.b, r.a) for r in out if r.image_id == 2] == [(9, 9, 9, 7)]
    runs = R.snapped_runs(px, stats).filter("image_id = 1")
    assert runs.agg(F.sum(F.expr("x1 - x0 + 1"))).first()[0] == w * h


def test_ring_statistics_expand_the_ring_only(raster):
    """The same statistics as over all pixels, from no more rows than the ring and its inner edge hold."""
    ink = (10, 20, 200)
    px = raster({1: (90, 70, lambda x, y: ink if math.hypot(x - 44, y - 33) <= 30 else (255, 255, 255))})
    regions = R.connected_components(R.with_ink_code(px))
    row = R.region_stats(regions).first()
    d = [math.hypot(r.x - row.cx, r.y - row.cy) for r in R.region_pixels(regions).collect()]
    ring = np.array([v for v in d if v >= row.radius * R.RING_FROM])
    assert row.ring_px == len(ring)
    assert row.ring_cv == pytest.approx(ring.std() / (ring.mean() + 1e-6))
    centre = regions.withColumn("radius", F.lit(row.radius)).withColumn("cx", F.lit(row.cx)).withColumn(
        "cy", F.lit(row.cy))
    heights = sum(1 for y in range(70) if abs(y - row.cy) < row.radius * R.RING_FROM)
    assert len(ring) <= centre.select(F.explode(R.ring_stretch())).count() <= len(ring) + 2 * heights


def test_evaluate_perfect_copy(raster):
    from inkloom.operators import palette as P

    px = raster({1: (30, 30, lambda x, y: (200, 30, 30) if 5 < x < 20 and 5 < y < 20 else (255, 255, 255))})
    row = Q.evaluate(px, px, P.palette_auto(px)).first()
    assert (row.iou_mean, row.iou_aw, row.iou_worst, row.chamfer, row.identical) == (1, 1, 1, 0, True)
    palettes = P.palette_auto(px)
    test = Q.self_test(L.assign_nearest(px, palettes), palettes).first()
    assert test.passed and test.shift_chamfer > 0.01
