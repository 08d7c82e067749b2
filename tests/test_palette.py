"""Palette and label rules on small drawn images."""

import pytest
from pyspark.sql import functions as F

from inkloom.functions import colour as C
from inkloom.functions.requests import palette_policy
from inkloom.operators import labels as L
from inkloom.operators import palette as P

WHITE = (255, 255, 255)


def box(x0, x1, y0, y1, colour):
    return lambda x, y: colour if x0 <= x < x1 and y0 <= y < y1 else None


def drawing(*boxes, ground=WHITE):
    def paint(x, y):
        out = ground
        for b in boxes:
            out = b(x, y) or out
        return out

    return paint


def palettes_of(df):
    return {r.image_id: [(p.r, p.g, p.b) for p in r.palette] for r in df.collect()}


@pytest.fixture(scope="module")
def corpus(raster):
    return raster({
        1: (80, 80, drawing(box(10, 40, 10, 70, (200, 30, 30)), box(45, 70, 10, 70, (20, 20, 20)))),
        2: (120, 80, drawing(box(5, 35, 5, 75, (200, 20, 20)), box(40, 70, 5, 75, (20, 20, 20)),
                             box(75, 110, 5, 75, (20, 180, 40)))),
        3: (100, 60, drawing(box(5, 45, 5, 55, (200, 40, 40)), box(55, 95, 5, 55, (40, 50, 190)))),
        4: (20, 20, drawing()),
        5: (60, 40, drawing(box(5, 30, 5, 35, (30, 30, 30)), box(32, 55, 5, 35, (120, 120, 120)))),
    })


def test_auto_palettes(corpus):
    got = palettes_of(P.palette_auto(corpus, 4).cache())
    assert got[1] == [WHITE, (20, 20, 20), (200, 30, 30)] or set(got[1]) == {
        WHITE, (20, 20, 20), (200, 30, 30)}
    assert all(p[0] == WHITE for p in got.values())
    assert {(200, 40, 40), (40, 50, 190)} <= set(got[3])
    assert got[4] == [WHITE]
    # Two far grey peaks: the guard undoes the grey collapse.
    assert set(got[5]) == {WHITE, (30, 30, 30), (120, 120, 120)}


def test_exact_two_inks(corpus):
    got = palettes_of(P.palette_exact(corpus, 2))
    assert len(got[2]) == 3 and got[2][0] == WHITE
    assert len(got[5]) == 3
    assert got[4] == [WHITE]


def swatches(spark, colours, masses=None):
    masses = masses or [1] * len(colours)
    rows = [(1, r, g, b, m, i) for i, ((r, g, b), m) in enumerate(zip(colours, masses))]
    df = spark.createDataFrame(
        rows, "image_id long, r long, g long, b long, mass long, first_ord long")
    return P.cluster_arrays(df)


def test_gradient_greys_collapse_to_one(spark):
    cols = [(20, 20, 20), (60, 60, 60), (100, 100, 100), (160, 160, 160), (210, 40, 40)]
    df = swatches(spark, cols).select(P.collapse_gradient_ramps(
        F.col("swatches"), 4, has_counts=False).alias("s"))
    out = [(s.r, s.g, s.b) for s in df.first().s]
    assert out == [(100, 100, 100), (210, 40, 40)]


def test_ramp_width_narrows_and_truncates(spark):
    cols = [(200, 40, 40), (200, 90, 40), (40, 200, 60), (40, 60, 200), (90, 90, 90)]
    df = swatches(spark, cols, [50, 40, 30, 20, 10])
    wide = df.select(P.collapse_gradient_ramps(F.col("swatches"), 4).alias("s")).first().s
    narrow = df.select(P.collapse_gradient_ramps(F.col("swatches"), 8).alias("s")).first().s
    assert len(wide) == 4 and len(narrow) == 5


def test_merge_keeps_first_anchor(spark):
    df = swatches(spark, [(200, 40, 40), (206, 44, 44), (40, 60, 190)], [50, 40, 30])
    out = df.select(P.merge_by_hsl(F.col("swatches")).alias("s")).first().s
    assert [(s.r, s.mass) for s in out] == [(200, 90), (40, 30)]


def test_exact_folds_dust_into_near_major(spark):
    df = swatches(spark, [(100, 0, 0), (0, 100, 0), (110, 20, 0), (0, 0, 255)], [500, 480, 6, 5])
    out = df.select(P.select_exact(F.col("swatches"), 2).alias("s")).first().s
    # The blue rest is equally far from both and goes to the heavier.
    assert [(s.r, s.g, s.mass) for s in out] == [(100, 0, 511), (0, 100, 480)]
    wide = df.select(P.select_up_to(F.col("swatches"), 3).alias("s")).first().s
    assert [(s.r, s.g, s.b) for s in wide] == [(100, 0, 0), (0, 100, 0), (0, 0, 255)]


def test_background_is_upper_median_of_light_border(spark, raster):
    # Even border sample: two light values with equal counts give the larger one.
    px = raster({1: (2, 2, lambda x, y: (240, 240, 240) if x == 0 else (250, 250, 250)),
                 2: (3, 3, lambda x, y: (10, 10, 10) if (x, y) != (1, 1) else WHITE)})
    got = {r.image_id: r.bg_r for r in P.estimate_background(px).collect()}
    assert got == {1: 250, 2: 10}
    working = P.working_counts(px)
    again = {r.image_id: r.bg_r for r in P.background_from_counts(working).collect()}
    assert again == got


def test_large_images_reduce_to_the_same_counts(raster):
    """The one-pass counts of a reduced image equal reducing first and counting then."""
    px = raster({7: (50, 37, lambda x, y: ((x * 7) % 256, (y * 11) % 256, (x * y) % 256)),
                 8: (9, 9, lambda x, y: (x * 20, 0, 0))})
    want = {tuple(r) for r in P.color_counts(P.box_downsample(px, 16)).select(
        "image_id", "r", "g", "b", "n", "first_ord").collect()}
    working = P.working_counts(px, 16).cache()
    got = {tuple(r) for r in working.filter("n > 0").select(
        "image_id", "r", "g", "b", "n", "first_ord").collect()}
    assert got == want
    bg = {tuple(r) for r in P.estimate_background(px).collect()}
    assert {tuple(r) for r in P.background_from_counts(working).collect()} == bg


def test_nearest_slot_forms_agree(spark, raster):
    """The unrolled arithmetic, the array form and brute force choose the same slot."""
    import random

    rnd = random.Random(3)
    colours = {n: [tuple(rnd.randrange(256) for _ in "rgb") for _ in range(n)] for n in (1, 3, 17, 40)}
    colours[3][1] = colours[3][0]  # a tie: the lower slot wins
    px = raster({n: (12, 12, lambda x, y: (x * 23 % 256, y * 37 % 256, (x * y) % 256)) for n in colours})
    rows = [(n, 12, 12, [(i, *c) for i, c in enumerate(cs)]) for n, cs in colours.items()]
    pal = spark.createDataFrame(
        rows, "image_id long, w long, h long, palette array<struct<slot:long,r:long,g:long,b:long>>")
    got = {(r.image_id, r.x, r.y): r.slot for r in L.assign_nearest(px, pal).collect()}
    for r in px.collect():
        d = [(r.r - c[0]) ** 2 + (r.g - c[1]) ** 2 + (r.b - c[2]) ** 2 for c in colours[r.image_id]]
        assert got[r.image_id, r.x, r.y] == d.index(min(d))


def test_empty_palette_is_an_error(spark, raster):
    pal = spark.createDataFrame(
        [(1, 2, 2, [])], "image_id long, w long, h long, palette array<struct<slot:long,r:long,g:long,b:long>>")
    with pytest.raises(Exception, match="palette must not be empty"):
        L.assign_nearest(raster({1: (2, 2, lambda x, y: WHITE)}), pal).collect()


def test_prepare_corpus_checks_and_alpha(raster):
    px = raster({1: (64, 64, lambda x, y: (220, 40, 40, 255) if 20 <= x < 44 and 20 <= y < 44 else (
        (20, 20, 200, 255) if 10 <= x < 54 and 10 <= y < 54 else (0, 0, 0, 0)))})
    out = L.prepare_corpus(px, 2).cache()
    assert {r.a for r in out.collect()} == {0, 255}
    assert out.select("r", "g", "b").distinct().count() == 3
    for bad in (0, 17, "4"):
        with pytest.raises(ValueError):
            L.prepare_corpus(px, bad)


def test_grey_hue_is_pinned(spark):
    a = C.Rgb(F.lit(100), F.lit(100), F.lit(101))
    b = C.Rgb(F.lit(100), F.lit(100), F.lit(100))
    got = spark.range(1).select(C.hsl_distance(a, b).alias("d")).first().d
    assert got == pytest.approx(0.6668, abs=1e-3)


def test_policy_table(spark):
    cases = [
        ("auto", "auto", 4, "up_to", None), ("2", "auto", 2, "exact", None),
        ("4", "up_to", 4, "up_to", None), (None, "nonsense", 4, "up_to", None),
        (" 3 ", None, 3, "exact", None), ("1_6", "default", 16, "exact", None),
        ("17", "bogus", None, None, "colors must be 1..16, got 17"),
        ("x", "", None, None, "colors must be auto or int 1..16"),
        ("5", "bogus", None, None, "colors_mode must be auto|up_to|exact"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, c string, m string")
    got = {r.i: tuple(r.p) for r in df.select("i", palette_policy(F.col("c"), F.col("m")).alias("p")).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}


def test_exact_gives_the_rest_to_the_nearest_kept(raster):
    """Four inks, two kept: all ink pixels are counted in the two."""
    inks = [((200, 30, 30), 20), ((20, 20, 20), 14), ((30, 160, 60), 6), ((40, 40, 190), 4)]
    rows = [c for c, n in inks for _ in range(n)]

    def paint(x, y):
        return rows[x - 8] if 8 <= x < 52 and 8 <= y < 32 else (255, 255, 255)

    px = raster({1: (60, 40, paint)})
    working = P.working_counts(px)
    clusters = P.color_clusters(P.ink_counts(working, P.background_from_counts(working)))
    arrays = P.cluster_arrays(clusters)
    kept = arrays.select(P.select_exact(arrays["swatches"], 2).alias("k")).first().k
    assert [(s["r"], s["g"], s["b"]) for s in kept] == [inks[0][0], inks[1][0]]
    # Green and blue are nearer to the dark ink than to the red one.
    assert [s["mass"] for s in kept] == [20 * 24, 24 * 24]


def test_colour_sketches_add_up(spark):
    """Estimates within their error, exact for few colours, and merged over strips and days."""
    n = 60_000
    px = spark.range(n).selectExpr(
        "id % 2 AS image_id", "id % 300 AS x", "id div 300 AS y", "300L AS w", f"{n // 300}L AS h",
        "(id * 7919) % 256 AS r", "(id div 256) % 256 AS g", "if(id % 2 = 0, (id div 7) % 256, 5) AS b")
    exact = {r.image_id: r.n_colors for r in P.unique_color_count(P.color_counts(px)).collect()}
    assert min(exact.values()) > 20_000
    sketches = P.color_sketches(px, strip_pixels=3000).cache()
    assert sketches.count() == 2 * (n // 3000)
    for found in (P.unique_color_estimate(sketches), P.unique_color_estimate(P.color_sketches(px))):
        for r in found.collect():
            assert abs(r.n_colors - exact[r.image_id]) <= 4 * P.SKETCH_ERROR * exact[r.image_id]
    first, second = px.filter("y < 90"), px.filter("y >= 60")
    days = P.color_sketches(first, 3000).unionByName(P.color_sketches(second, 3000))
    assert {tuple(r) for r in P.unique_color_estimate(days).collect()} == {
        tuple(r) for r in P.unique_color_estimate(sketches).collect()}
    few = px.selectExpr("image_id", "x", "y", "w", "h", "r % 5 AS r", "g % 4 AS g", "b % 3 AS b")
    want = {tuple(r) for r in P.unique_color_count(P.color_counts(few)).collect()}
    assert {tuple(r) for r in P.unique_color_estimate(P.color_sketches(few)).collect()} == want
