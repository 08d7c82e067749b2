"""Background estimate, colour clusters and palettes, one palette per image.

Everything after the first aggregation works on colour counts, not on pixels: a palette is a
function of the image's border medians and of its colour histogram. Per image that is at most
``PALETTE_SIDE`` squared rows, and at most 4,096 clusters, whatever the image's own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.colour import (
    AUTO_MAX_INKS, BG_DIST2, GRAY_SAT_MAX, HUE_BUCKET_DEG, MERGE_DIST2, MERGE_HSL,
    MIN_ABSOLUTE_COUNT, MIN_MAJOR_MASS, PALETTE_SIDE, ULTRA_CLOSE_DIST2, Rgb, bucket4,
    hsl_gap, hue_deg, hue_gap, is_goldish, is_greenish, is_near_white, let, lightness,
    rgb_dist2, saturation,
)
from inkloom.plans.spread import (
    STRIP_PIXELS, attach_image_facts, checkpoint, int_div, store, strip_of, tasks_for,
)

LIGHTNESS_BINS = 13


def px() -> Rgb:
    return Rgb.cols()


def bg() -> Rgb:
    return Rgb.cols("bg_r", "bg_g", "bg_b")


# --- background ---------------------------------------------------------------------------


def _upper_median(channel: str, light_only: bool) -> Column:
    """``sorted[n // 2]`` = the discrete median counted from the top."""
    only = " FILTER (WHERE light)" if light_only else ""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {channel} DESC){only}")


def border_hits() -> Column:
    """How often a pixel is in its image's border sample: frame pixels, thinned on large
    images; corners lie on a row and on a column and count twice."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    step = F.greatest(F.lit(1), int_div(F.least(w, h), 200))
    along_x = F.when(x % step == 0, (y == 0).cast("int") + (y == h - 1).cast("int")).otherwise(0)
    along_y = F.when(y % step == 0, (x == 0).cast("int") + (x == w - 1).cast("int")).otherwise(0)
    return along_x + along_y


def _is_light() -> Column:
    return is_near_white(px()) | (px().r + px().g + px().b > 600)


def border_sample(pixels: DataFrame) -> DataFrame:
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    return (
        pixels.filter((y == 0) | (y == h - 1) | (x == 0) | (x == w - 1))
        .filter(border_hits() > 0)
        .select("image_id", "w", "h", "r", "g", "b", F.explode(F.sequence(F.lit(1), border_hits())))
        .drop("col")
    )


def estimate_background(pixels: DataFrame) -> DataFrame:
    """Per image: ``w, h`` and the background ``bg_r, bg_g, bg_b``.

    Medians come from per-value counts (at most 256 per channel), merged map-side.
    """
    medians = [
        _upper_median(c, only).alias(f"{which}_{c}")
        for which, only in (("light", True), ("all", False))
        for c in "rgb"
    ]
    enough = F.col("n_light") >= F.greatest(F.lit(1), int_div(F.col("n"), 3))
    stats = (
        border_sample(pixels)
        .withColumn("light", _is_light())
        .groupBy("image_id")
        .agg(
            F.max("w").alias("w"), F.max("h").alias("h"),
            F.count(F.lit(1)).alias("n"), F.count_if("light").alias("n_light"), *medians,
        )
    )
    return stats.select(
        "image_id", "w", "h",
        *(
            F.when(enough, F.col(f"light_{c}")).otherwise(F.col(f"all_{c}")).cast("bigint")
            .alias(f"bg_{c}")
            for c in "rgb"
        ),
    )


# --- pixels to colour counts --------------------------------------------------------------


def working_size(w: Column, h: Column, side: int = PALETTE_SIDE) -> tuple[Column, Column]:
    scale = F.greatest(w, h) / F.lit(float(side))
    return tuple(F.greatest(F.lit(1).cast("bigint"), F.floor(v / scale)) for v in (w, h))


def box_downsample(pixels: DataFrame, side: int = PALETTE_SIDE) -> DataFrame:
    """Area-average images whose long side exceeds ``side``; smaller ones pass unchanged."""
    w, h = F.col("w"), F.col("h")
    large = F.greatest(w, h) > side
    w2, h2 = working_size(w, h, side)
    kept = pixels.filter(~large).select(
        "image_id", *(F.col(c).cast("bigint") for c in ("x", "y", "w", "h", "r", "g", "b"))
    )
    shrunk = (
        pixels.filter(large)
        .groupBy(
            "image_id", w2.alias("w2"), h2.alias("h2"),
            F.floor((F.col("x") + 0.5) * w2 / w).alias("x2"),
            F.floor((F.col("y") + 0.5) * h2 / h).alias("y2"),
        )
        .agg(*(F.sum(c).alias(c) for c in "rgb"), F.count(F.lit(1)).alias("n"))
        .select(
            "image_id", F.col("x2").alias("x"), F.col("y2").alias("y"),
            F.col("w2").alias("w"), F.col("h2").alias("h"),
            *(F.floor(F.col(c) / F.col("n") + 0.5).alias(c) for c in "rgb"),
        )
    )
    return kept.unionByName(shrunk)


def color_counts(pixels: DataFrame) -> DataFrame:
    """Exact colours per image with their pixel count and first row-major position."""
    at = F.col("y") * F.col("w") + F.col("x")
    return pixels.groupBy("image_id", "r", "g", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first_ord")
    )


def working_counts(pixels: DataFrame, side: int = PALETTE_SIDE) -> DataFrame:
    """All that a palette needs of an image, from one pass over its pixels.

    Rows are colours of the working copy (box-reduced when the image is larger than ``side``)
    with ``n, first_ord``, and with ``hits``, their count in the full-size border sample.
    ``n`` is 0 for colours that occur only in a reduced image's border. At most ``side``
    squared working rows per image, whatever its size, and all of it is summed map-side.
    """
    w, h = F.col("w"), F.col("h")
    large = F.greatest(w, h) > side
    w2, h2 = working_size(w, h, side)
    cell = F.when(large & ~F.col("_border"), F.floor((F.col("y") + 0.5) * h2 / h) * w2
                  + F.floor((F.col("x") + 0.5) * w2 / w))
    hits = border_hits()
    alpha = F.min("a") if "a" in pixels.columns else F.lit(255)
    roles = F.when(large & (hits > 0), F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False)))
    in_cell = F.col("_cell").isNotNull()
    first = (
        pixels.withColumn("_border", F.explode(roles))
        .withColumn("_cell", cell)
        .select(
            "image_id", "w", "h", "_border", "_cell", *(c for c in ("a",) if c in pixels.columns),
            *(F.when(in_cell, 0).otherwise(F.col(c)).alias(f"k{c}") for c in "rgb"),
            *(F.col(c) for c in "rgb"),
            F.when(in_cell, F.col("_cell")).otherwise(F.col("y") * w + F.col("x")).alias("at"),
            F.when(in_cell, 0).otherwise(hits).alias("hits"),
        )
        .groupBy("image_id", "w", "h", "_border", "_cell", "kr", "kg", "kb")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.sum("hits").alias("hits"),
             alpha.alias("min_a"), *(F.sum(c).alias(c) for c in "rgb"))
    )
    # Small images are finished here; cells and borders of large ones become colours once more.
    stored = store(first)
    done = stored.filter(~in_cell & ~F.col("_border")).select(
        "image_id", "w", "h", *(F.col(f"k{c}").cast("bigint").alias(c) for c in "rgb"), "n",
        F.col("at").cast("bigint").alias("first_ord"), "hits", "min_a")
    reduced = (
        stored.filter(in_cell | F.col("_border"))
        .select(
            "image_id", "w", "h", "min_a", "hits",
            *(F.when(in_cell, F.floor(F.col(c) / F.col("n") + 0.5)).otherwise(F.col(f"k{c}"))
              .cast("bigint").alias(c) for c in "rgb"),
            in_cell.cast("bigint").alias("n"),
            F.when(in_cell, F.col("at").cast("bigint")).alias("at"),
        )
        .groupBy("image_id", "w", "h", "r", "g", "b")
        .agg(F.sum("n").alias("n"), F.min("at").alias("first_ord"), F.sum("hits").alias("hits"),
             F.min("min_a").alias("min_a"))
    )
    return done.unionByName(reduced)


def background_from_counts(working: DataFrame) -> DataFrame:
    """The background of ``working_counts``, by upper medians over at most 256 values per channel."""
    hits, light = F.col("hits"), _is_light()
    channels = F.array(*(F.struct(F.lit(i).alias("ch"), F.col(c).alias("v"))
                         for i, c in enumerate("rgb")))
    values = (
        working.filter(hits > 0)
        .select("image_id", "w", "h", "hits", F.when(light, hits).otherwise(0).alias("light"),
                F.inline(channels))
        .groupBy("image_id", "w", "h", "ch", "v")
        .agg(F.sum("hits").alias("n"), F.sum("light").alias("n_light"))
    )
    whole = Window.partitionBy("image_id", "ch")
    up = whole.orderBy("v")
    ranked = values.select(
        "image_id", "w", "h", "ch", "v",
        *(F.sum(c).over(up).alias(f"{c}_cum") for c in ("n", "n_light")),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in ("n", "n_light")),
    )
    enough = F.col("n_light_all") >= F.greatest(F.lit(1), int_div(F.col("n_all"), 3))
    at_median = F.when(enough, F.col("n_light_cum") > int_div(F.col("n_light_all"), 2)).otherwise(
        F.col("n_cum") > int_div(F.col("n_all"), 2))
    return ranked.groupBy("image_id", "w", "h").agg(*(
        F.min(F.when((F.col("ch") == i) & at_median, F.col("v"))).alias(f"bg_{c}")
        for i, c in enumerate("rgb")))


def with_background(counts: DataFrame, background: DataFrame) -> DataFrame:
    """Colour rows with the background ``bg_r, bg_g, bg_b`` of their image.

    The key carries the red channel's high bits and a background row comes once for each of
    them, so an image that holds a third of all colours is joined by many tasks."""
    facts = background.select("image_id", "bg_r", "bg_g", "bg_b", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("_part"))
    keyed = counts.withColumn("_part", F.shiftright(F.col("r").cast("bigint"), 4))
    return keyed.join(facts, ["image_id", "_part"]).drop("_part")


def ink_counts(counts: DataFrame, background: DataFrame) -> DataFrame:
    """Colour counts outside the background's snapping distance."""
    if "hits" in counts.columns:
        counts = counts.filter(F.col("n") > 0).select(
            "image_id", "r", "g", "b", "n", "first_ord")
    return with_background(counts, background).filter(rgb_dist2(px(), bg()) > BG_DIST2)


def color_clusters(counts: DataFrame) -> DataFrame:
    """4-bit buckets with floor-mean centre, mass and first position."""
    keys = [c.alias(n) for c, n in zip(bucket4(px()), ("br", "bg", "bb"))]
    n = F.sum("n")
    return (
        counts.groupBy("image_id", *keys)
        .agg(
            *(int_div(F.sum(F.col(c) * F.col("n")), n).alias(c) for c in "rgb"),
            n.alias("mass"), F.min("first_ord").alias("first_ord"),
        )
    )


def mass_filter(clusters: DataFrame) -> DataFrame:
    """Clusters with at least 3 % of the largest mass and 8 pixels, else only the largest."""
    image = Window.partitionBy("image_id")
    rank = F.row_number().over(image.orderBy(F.desc("mass"), "first_ord"))
    bar = F.greatest(F.max("mass").over(image) * 0.03, F.lit(float(MIN_ABSOLUTE_COUNT)))
    # The heaviest cluster always stays: either it passes the bar or nothing does.
    return (
        clusters.withColumn("_bar", bar).withColumn("_rank", rank)
        .filter((F.col("mass") >= F.col("_bar")) | (F.col("_rank") == 1))
        .drop("_bar", "_rank")
    )


def top_k_by_mass(clusters: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.desc("mass"), "first_ord")
    return clusters.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- ordered rules over one image's clusters (arrays of at most 4,096 structs) -------------


def _swatch(r: Column, g: Column, b: Column, mass: Column, mass0: Column) -> Column:
    c = Rgb(r, g, b)
    return F.struct(
        r.cast("bigint").alias("r"), g.cast("bigint").alias("g"), b.cast("bigint").alias("b"),
        mass.cast("bigint").alias("mass"), mass0.cast("bigint").alias("mass0"),
        lightness(c).alias("light"), saturation(c).alias("sat"), hue_deg(c).alias("hue"),
    )


def cluster_arrays(clusters: DataFrame) -> DataFrame:
    """Per image its swatches by descending mass, then first position."""
    row = F.struct(
        (-F.col("mass")).alias("k"), F.col("first_ord").alias("o"),
        _swatch(*px(), F.col("mass"), F.col("mass")).alias("s"),
    )
    return clusters.groupBy("image_id").agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda e: e["s"]).alias("swatches")
    )


def _empty(like: Column) -> Column:
    return F.slice(like, 1, 0)


def _add_mass(swatches: Column, at: Column, extra: Column) -> Column:
    return F.transform(
        swatches, lambda s, i: F.when(i == at, s.withField("mass", s["mass"] + extra)).otherwise(s)
    )


def _resort(swatches: Column) -> Column:
    """Descending mass, ties in present order."""
    keyed = F.transform(
        swatches, lambda s, i: F.struct((-s["mass"]).alias("k"), i.alias("o"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda e: e["s"])


def _hsl_close(a: Column, b: Column) -> Column:
    gap = hsl_gap(a["light"], a["sat"], a["hue"], b["light"], b["sat"], b["hue"])
    return gap <= MERGE_HSL


def _d2(a: Column, b: Column) -> Column:
    return rgb_dist2(Rgb.of(a), Rgb.of(b))


def _best(swatches: Column, *keys) -> Column:
    """First swatch with the smallest key tuple."""
    ranked = F.transform(
        swatches,
        lambda s, i: F.struct(*(k(s).alias(f"k{n}") for n, k in enumerate(keys)),
                              i.alias("o"), s.alias("s")),
    )
    return F.array_min(ranked)["s"]


def merge_by_hsl(swatches: Column) -> Column:
    """Each swatch joins the first anchor within the HSL threshold, or becomes an anchor."""

    def step(anchors: Column, s: Column) -> Column:
        near = F.array_position(F.transform(anchors, lambda a: _hsl_close(s, a)), True)
        return let(near, lambda p: F.when(p > 0, _add_mass(anchors, p - 1, s["mass"]))
                   .otherwise(F.concat(anchors, F.array(s))))

    return F.aggregate(swatches, _empty(swatches), step)


def _drop_ultra_close(swatches: Column) -> Column:
    def step(kept: Column, s: Column) -> Column:
        close = F.exists(kept, lambda k: _d2(s, k) <= ULTRA_CLOSE_DIST2)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(swatches, _empty(swatches), step)


def _hue_anchors(chroma: Column, same) -> Column:
    """First-fit buckets in hue order; each bucket answers with its most saturated swatch.

    A bucket is (head, anchor): ``same(head, s)`` decides membership.
    """
    by_hue = F.transform(
        F.array_sort(F.transform(chroma, lambda s, i: F.struct(
            s["hue"].alias("k"), i.alias("o"), s.alias("s")))),
        lambda e: F.struct(e["s"].alias("head"), e["s"].alias("anchor")),
    )

    def better(new: Column, old: Column) -> Column:
        return (new["sat"] > old["sat"]) | (
            (new["sat"] == old["sat"]) & (new["light"] < old["light"])
        )

    def step(buckets: Column, e: Column) -> Column:
        s = e["head"]
        hit = F.array_position(F.transform(buckets, lambda k: same(k["head"], s)), True)

        def place(p: Column) -> Column:
            joined = F.transform(buckets, lambda k, i: F.when(
                (i == p - 1) & better(s, k["anchor"]), k.withField("anchor", s)).otherwise(k))
            return F.when(p > 0, joined).otherwise(F.concat(buckets, F.array(e)))

        return let(hit, place)

    return F.transform(F.aggregate(by_hue, _empty(by_hue), step), lambda k: k["anchor"])


def _grays(swatches: Column) -> Column:
    return F.filter(swatches, lambda s: s["sat"] <= GRAY_SAT_MAX)


def _chroma(swatches: Column) -> Column:
    return F.filter(swatches, lambda s: s["sat"] > GRAY_SAT_MAX)


def gradient_crush(swatches: Column) -> Column:
    """One grey (largest mass before merging), one anchor per hue group, no near-duplicates."""

    def crush(all_: Column) -> Column:
        grays = _grays(all_)
        gray = F.when(F.size(grays) > 0, F.array(_best(grays, lambda s: -s["mass0"]))).otherwise(
            _empty(all_))
        anchors = _hue_anchors(
            _chroma(all_),
            lambda head, s: (hue_gap(s["hue"], head["hue"]) <= HUE_BUCKET_DEG)
            & _hsl_close(s, head),
        )
        return _drop_ultra_close(F.concat(gray, anchors))

    return F.when(F.size(swatches) <= 1, swatches).otherwise(let(swatches, crush))


def collapse_gradient_ramps(swatches: Column, max_colors: int, has_counts: bool = True) -> Column:
    """The older collapse: hue-only buckets and truncation to ``max_colors``.

    ``has_counts`` picks the grey by mass; without it the middle grey by lightness is kept.
    """
    width = max(14.0, HUE_BUCKET_DEG * 4 / max_colors) if max_colors > 4 else HUE_BUCKET_DEG

    def middle(grays: Column) -> Column:
        keyed = F.array_sort(F.transform(grays, lambda s, i: F.struct(
            s["light"].alias("k"), i.alias("o"), s.alias("s"))))
        return F.get(keyed, F.floor(F.size(grays) / 2).cast("int"))["s"]

    def collapse(all_: Column) -> Column:
        grays = _grays(all_)
        pick = _best(grays, lambda s: -s["mass0"]) if has_counts else middle(grays)
        gray = F.when(F.size(grays) > 0, F.array(pick)).otherwise(_empty(all_))
        anchors = _hue_anchors(
            _chroma(all_), lambda head, s: hue_gap(s["hue"], head["hue"]) <= width
        )
        return let(_drop_ultra_close(F.concat(gray, anchors)), truncate)

    def truncate(out: Column) -> Column:
        ranked = F.transform(out, lambda s, i: F.struct(
            F.when(s["sat"] > GRAY_SAT_MAX, 0).otherwise(1).alias("k0"), (-s["sat"]).alias("k1"),
            s["light"].alias("k2"), i.alias("o"), s.alias("s")))
        best = F.transform(F.slice(F.array_sort(ranked), 1, max_colors), lambda e: e["s"])
        return F.when(F.size(out) > max_colors, best).otherwise(out)

    return F.when(F.size(swatches) <= 1, swatches).otherwise(let(swatches, collapse))


def _mass_candidates(swatches: Column, total: Column) -> Column:
    """Majors (ultra-close ones absorbed) with nearby dust folded in, then leftover minors."""

    def is_major(s: Column) -> Column:
        return (s["mass"] >= MIN_ABSOLUTE_COUNT) & (s["mass"] / total >= MIN_MAJOR_MASS)

    def nearest(selected: Column, s: Column) -> Column:
        return F.array_min(F.transform(
            selected, lambda k, i: F.struct(_d2(s, k).alias("d2"), i.alias("i"))))

    def take(selected: Column, s: Column) -> Column:
        return let(nearest(selected, s), lambda n: F.when(
            F.coalesce(n["d2"] <= ULTRA_CLOSE_DIST2, F.lit(False)),
            _add_mass(selected, n["i"], s["mass"]),
        ).otherwise(F.concat(selected, F.array(s))))

    def with_dust(selected: Column) -> Column:
        dust = F.transform(
            F.filter(swatches, lambda s: ~is_major(s)),
            lambda s: F.struct(s.alias("s"), nearest(selected, s).alias("n")),
        )

        def fold(d: Column) -> Column:
            near = F.filter(d, lambda e: F.coalesce(e["n"]["d2"] <= MERGE_DIST2, F.lit(False)))
            far = F.filter(d, lambda e: F.coalesce(e["n"]["d2"] > MERGE_DIST2, F.lit(True)))
            grown = F.transform(selected, lambda s, i: s.withField(
                "mass",
                s["mass"] + F.aggregate(
                    F.filter(near, lambda e: e["n"]["i"] == i),
                    F.lit(0).cast("bigint"), lambda acc, e: acc + e["s"]["mass"])))
            return _resort(F.concat(grown, F.transform(far, lambda e: e["s"])))

        return let(dust, fold)

    majors = F.filter(swatches, is_major)
    return let(F.aggregate(majors, _empty(swatches), take), with_dust)


def _total_mass(swatches: Column) -> Column:
    return F.aggregate(swatches, F.lit(0).cast("bigint"), lambda acc, s: acc + s["mass"])


def select_exact(swatches: Column, max_colors: int) -> Column:
    """The ``max_colors`` heaviest candidates (fewer when fewer exist). Each other candidate's
    mass goes to the nearest of them, the heavier on ties."""

    def cut(candidates: Column) -> Column:
        kept = F.slice(candidates, 1, max_colors)
        rest = F.filter(candidates, lambda s, i: i >= max_colors)

        def fold(kept: Column) -> Column:
            homes = F.transform(rest, lambda s: F.struct(
                s["mass"].alias("mass"),
                F.array_min(F.transform(kept, lambda k, i: F.struct(
                    _d2(s, k).alias("d2"), i.alias("i"))))["i"].alias("home")))
            return let(homes, lambda hs: F.transform(kept, lambda k, i: k.withField(
                "mass", k["mass"] + F.aggregate(
                    F.filter(hs, lambda h: h["home"] == i), F.lit(0).cast("bigint"),
                    lambda acc, h: acc + h["mass"]))))

        return F.when(F.size(candidates) <= max_colors, candidates).otherwise(let(kept, fold))

    return let(_total_mass(swatches), lambda total: let(_mass_candidates(swatches, total), cut))


def select_up_to(swatches: Column, max_colors: int) -> Column:
    """Majors first, then candidates clearly apart from everything picked."""

    def fill(candidates: Column, total: Column) -> Column:
        majors = F.filter(candidates, lambda s: (s["mass"] >= MIN_ABSOLUTE_COUNT)
                          & (s["mass"] / total >= MIN_MAJOR_MASS))
        first = F.when(F.size(majors) > 0, F.slice(majors, 1, max_colors)).otherwise(
            F.slice(candidates, 1, 1))

        def step(picked: Column, s: Column) -> Column:
            apart = ~F.exists(picked, lambda p: _d2(s, p) <= MERGE_DIST2)
            return F.when((F.size(picked) < max_colors) & apart,
                          F.concat(picked, F.array(s))).otherwise(picked)

        return F.aggregate(candidates, first, step)

    return let(_total_mass(swatches), lambda total: let(
        _mass_candidates(swatches, total), lambda c: fill(c, total)))


def auto_survivors(swatches: Column) -> Column:
    """HSL merge, re-rank, at most eight: the input of the gradient crush."""
    return F.slice(_resort(merge_by_hsl(swatches)), 1, AUTO_MAX_INKS)


# --- palettes -----------------------------------------------------------------------------


def lightness_peaks(ink: DataFrame) -> DataFrame:
    """Per image ``is_bimodal``: two heavy lightness bins at least three bins apart."""
    k = F.floor((px().r + px().g + px().b) / F.lit(3.0) / F.lit(20.0))
    bins = F.array(
        *(F.sum(F.when(k == i, F.col("n")).otherwise(0)) for i in range(LIGHTNESS_BINS))
    )
    peaks = F.filter(
        F.transform(F.col("bins"), lambda v, i: F.when(v / F.col("ink_n") > 0.10, i)),
        lambda i: i.isNotNull(),
    )
    return (
        ink.groupBy("image_id")
        .agg(
            bins.alias("bins"), F.sum("n").alias("ink_n"),
            (F.max(F.greatest(*px())) - F.min(F.least(*px()))).alias("span"),
        )
        .withColumn("peaks", peaks)
        .select(
            "image_id",
            ((F.col("span") > 60) & (F.size("peaks") >= 2)
             & (F.array_max("peaks") - F.array_min("peaks") >= 3)).alias("is_bimodal"),
        )
    )


def _with_background(inks: Column, cap: Column | int) -> Column:
    """Background in slot 0, then the inks clearly apart from it, at most ``cap`` of them."""
    plate = F.struct(bg().r.alias("r"), bg().g.alias("g"), bg().b.alias("b"))
    apart = F.filter(inks, lambda s: rgb_dist2(Rgb.of(s), bg()) > MERGE_DIST2)
    plain = F.transform(apart, lambda s: F.struct(s["r"].alias("r"), s["g"].alias("g"),
                                                  s["b"].alias("b")))
    kept = F.concat(F.array(plate), F.when(inks.isNotNull(), F.slice(plain, 1, cap)).otherwise(
        F.slice(F.array(plate), 1, 0)))
    return F.transform(kept, lambda p, i: F.struct(
        i.cast("bigint").alias("slot"), p["r"].alias("r"), p["g"].alias("g"), p["b"].alias("b")))


def _palette_inputs(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Background facts (with ``has_alpha``) and ink counts of a corpus.

    The stored working counts feed both.
    """
    working = working_counts(pixels)
    alpha = working.groupBy("image_id").agg((F.min("min_a") < 255).alias("has_alpha"))
    background = checkpoint(background_from_counts(working).join(alpha, "image_id"))
    return background, ink_counts(working, background)


def _auto_inks(full: DataFrame, ink: DataFrame, n: Column) -> DataFrame:
    """``image_id, auto_inks`` from the swatches of ``full``; ``n`` bounds the fallback."""
    image_top = F.get("swatches", F.lit(0))["mass"]
    bar = F.greatest(image_top * 0.03, F.lit(float(MIN_ABSOLUTE_COUNT)))
    heavy = F.filter("swatches", lambda s: s["mass"] >= bar)
    candidates = F.when(F.size(heavy) > 0, heavy).otherwise(F.slice("swatches", 1, 1))
    crushed = gradient_crush(F.col("survivors"))
    guard = (F.size("auto") == 1) & (n > 1) & F.col("is_bimodal")
    chosen = F.when(guard, select_up_to(F.col("swatches"), n)).otherwise(F.col("auto"))
    return (
        full.withColumn("candidates", candidates)
        .withColumn("survivors", auto_survivors(F.col("candidates")))
        .withColumn("auto", crushed)
        .join(lightness_peaks(ink), "image_id")
        .select("image_id", chosen.alias("auto_inks"))
    )


def _auto_cap(n: Column, inks: Column) -> Column:
    return F.greatest(n, F.coalesce(F.size(inks), F.lit(0)))


def _palette_row(inks: Column, cap: Column) -> list[Column]:
    return [*(F.col(c) for c in ("image_id", "w", "h", "has_alpha")), *bg(),
            _with_background(inks, cap).alias("palette")]


def palette_auto(pixels: DataFrame, max_colors: int = 4) -> DataFrame:
    """Automatic palette: ``image_id, w, h, has_alpha, bg_*, palette array<slot,r,g,b>``.

    An image whose inks collapse to one although its lightness has two far peaks falls back to
    the mass-aware choice.
    """
    background, ink = _palette_inputs(pixels)
    n = F.lit(max_colors)
    inks = _auto_inks(cluster_arrays(color_clusters(ink)), ink, n)
    found = F.col("auto_inks")
    return background.join(inks, "image_id", "left").select(
        *_palette_row(found, _auto_cap(n, found)))


def palette_exact(pixels: DataFrame, max_colors: int) -> DataFrame:
    """Background plus exactly the ``max_colors`` heaviest inks, no gradient crush."""
    background, ink = _palette_inputs(pixels)
    n = F.lit(max_colors)
    inks = cluster_arrays(color_clusters(ink)).select(
        "image_id", select_exact(F.col("swatches"), n).alias("inks"))
    return background.join(inks, "image_id", "left").select(*_palette_row(F.col("inks"), n))


def palette_by_settings(pixels: DataFrame, settings: DataFrame) -> DataFrame:
    """``palette_auto`` or ``palette_exact`` per image, by its row ``image_id, n, mode`` in
    ``settings`` (one per image; images without a row get no palette). ``pixels`` is a stored table; its
    colours are read once for both."""
    asked = checkpoint(settings.select("image_id", F.col("n").cast("int").alias("n"), "mode"))
    sizes = pixels.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    wanted = sizes.join(asked.select("image_id"), "image_id", "left_semi")
    tasks = tasks_for(pixels.sparkSession, pixels.count())
    background, ink = _palette_inputs(attach_image_facts(pixels, wanted, tasks=tasks))
    full = checkpoint(cluster_arrays(color_clusters(ink)).join(asked, "image_id"))
    exact = F.col("mode") == "exact"
    auto = _auto_inks(full.filter(~exact), ink, F.col("n"))
    heaviest = full.filter(exact).select(
        "image_id", select_exact(F.col("swatches"), F.col("n")).alias("exact_inks"))
    inks = F.when(exact, F.col("exact_inks")).otherwise(F.col("auto_inks"))
    cap = F.when(exact, F.col("n")).otherwise(_auto_cap(F.col("n"), F.col("auto_inks")))
    return (
        background.join(asked, "image_id").join(auto, "image_id", "left")
        .join(heaviest, "image_id", "left").select(*_palette_row(inks, cap)))


def palette_rows(palettes: DataFrame) -> DataFrame:
    """Palettes one colour per row."""
    return palettes.select("image_id", F.inline("palette")).withColumn(
        "is_bg", F.col("slot") == 0
    )


def extract_colors(pixels: DataFrame, max_colors: int = 4) -> DataFrame:
    """Only the colours of the automatic palette."""
    return palette_rows(palette_auto(pixels, max_colors)).drop("is_bg")


def bg_dedupe(inks: DataFrame, background: DataFrame) -> DataFrame:
    """Ink rows that are not within the merge distance of their image's background."""
    return with_background(inks, background).filter(rgb_dist2(px(), bg()) > MERGE_DIST2).drop(
        "bg_r", "bg_g", "bg_b"
    )


# --- corpus diagnostics -------------------------------------------------------------------


def unique_color_count(counts: DataFrame) -> DataFrame:
    return counts.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_colors"))


#: Logarithm of a sketch's registers, and its relative standard error.
SKETCH_LG = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG / 2)


def color_sketches(pixels: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """``image_id, strip, sketch``: a sketch of a few kB of each strip's distinct colours.

    Strips are combined before anything is shuffled, so a huge image costs as many small rows as it has
    strips and tasks. Sketches of other strips, days or corpora merge with these."""
    code = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("bigint")
    strip = strip_of(F.col("y"), F.col("w"), strip_pixels)
    return pixels.groupBy("image_id", strip.alias("strip")).agg(
        F.hll_sketch_agg(code, F.lit(SKETCH_LG)).alias("sketch"))


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """One sketch per group of ``by``: of what any of the merged ones has seen."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def unique_color_estimate(sketches: DataFrame) -> DataFrame:
    """``image_id, n_colors``: the sketched form of ``unique_color_count``. Its relative standard error is
    ``SKETCH_ERROR``; a few hundred colours are counted exactly."""
    return merge_sketches(sketches, "image_id").select(
        "image_id", F.hll_sketch_estimate("sketch").alias("n_colors"))


def raw_color_histogram(counts: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent exact colours with share, lightness and saturation."""
    totals = counts.groupBy("image_id").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "first_ord")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .join(totals, "image_id")
        .select(
            "image_id", F.col("rank").cast("bigint").alias("rank"), "r", "g", "b", "n",
            (F.col("n") / F.col("total")).alias("share"),
            lightness(px()).alias("lightness"), saturation(px()).alias("saturation"),
        )
    )


def white_fraction(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(
        (F.count_if(is_near_white(px())) / F.count(F.lit(1))).alias("white_fraction")
    )


def colour_families(counts: DataFrame, background: DataFrame) -> DataFrame:
    """Green-ish and gold-ish pixel counts, and how many of the green ones snap to background."""
    snapped = rgb_dist2(px(), bg()) <= BG_DIST2

    def count(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("n")).otherwise(0))

    return (
        with_background(counts, background)
        .groupBy("image_id")
        .agg(
            F.sum("n").alias("n_px"),
            count(is_greenish(px())).alias("green_px"),
            count(is_greenish(px()) & snapped).alias("green_as_bg"),
            count(is_goldish(px())).alias("gold_px"),
            count(is_goldish(px()) & snapped).alias("gold_as_bg"),
            count(~snapped & is_greenish(px())).alias("green_ink_px"),
        )
    )


def palette_trace(counts: DataFrame, background: DataFrame, k: int = 20) -> DataFrame:
    """Per image: background and ink share, and the top clusters with share and class."""
    ink = ink_counts(counts, background)
    totals = counts.groupBy("image_id").agg(F.sum("n").alias("total"))
    ink_totals = ink.groupBy("image_id").agg(F.sum("n").alias("ink_n"))
    share = F.col("mass") / F.col("ink_n")
    major = (F.col("mass") >= MIN_ABSOLUTE_COUNT) & (share >= MIN_MAJOR_MASS)
    return (
        top_k_by_mass(color_clusters(ink), k)
        .join(totals, "image_id")
        .join(ink_totals, "image_id")
        .select(
            "image_id", F.col("rank").cast("bigint").alias("rank"), "r", "g", "b", "mass",
            share.alias("share"),
            F.when(major, "MAJOR").otherwise("dust").alias("class"),
            F.when(saturation(px()) <= GRAY_SAT_MAX, "gray").otherwise("chroma").alias("family"),
            (F.col("ink_n") / F.col("total")).alias("ink_share"),
            (F.lit(1.0) - F.col("ink_n") / F.col("total")).alias("bg_share"),
        )
    )
