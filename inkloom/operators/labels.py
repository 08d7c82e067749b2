"""Nearest-palette assignment of pixels and the palette remap built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.colour import BG_DIST2, Rgb, alpha_rule, is_ink, rgb_dist2
from inkloom.operators import palette as P
from inkloom.plans.spread import STRIP_PIXELS, attach_image_facts

# A palette is the background and at most 16 inks. These many slots are unrolled into plain
# arithmetic; a longer palette takes the array form of the same rule.
UNROLLED_SLOTS = 17
SLOT_BITS = 5


def palette_coefficients(palette: Column) -> Column:
    """Four numbers per slot, so that ``r*a + g*b + b*c + d`` orders slots by distance.

    ``|p|^2 - 2 p.c`` ranks like the squared distance; it is scaled by 2^SLOT_BITS and carries
    the slot in the low bits, so the smallest value names the nearest slot, lowest on ties.
    """
    unit = 1 << SLOT_BITS

    def entry(p: Column, i: Column) -> Column:
        norm = p["r"] * p["r"] + p["g"] * p["g"] + p["b"] * p["b"]
        return F.array(
            *(p[c].cast("bigint") * (-2 * unit) for c in "rgb"),
            norm.cast("bigint") * unit + i,
        )

    return F.flatten(F.transform(palette, entry))


def nearest_slot(c: Rgb, palette: Column, coefficients: Column) -> Column:
    """Slot of the palette colour with the smallest squared distance, lowest slot on ties."""

    def code(i: int) -> Column:
        a, b, g, d = (F.get(coefficients, F.lit(4 * i + k)) for k in range(4))
        return c.r * a + c.g * b + c.b * g + d

    unrolled = F.least(*(code(i) for i in range(UNROLLED_SLOTS))).bitwiseAND((1 << SLOT_BITS) - 1)
    general = F.array_min(F.transform(
        palette, lambda p, i: F.struct(rgb_dist2(c, Rgb.of(p)).alias("d2"), i.alias("slot")))
    )["slot"]
    return F.when(F.size(palette) <= UNROLLED_SLOTS, unrolled).otherwise(general).cast("bigint")


def _require_colours(palettes: DataFrame) -> DataFrame:
    """An empty palette is an error, not an image that silently disappears."""
    checked = F.when(F.size("palette") > 0, F.col("palette")).otherwise(
        F.raise_error(F.lit("palette must not be empty"))
    )
    return palettes.withColumn("palette", checked)


def attach_palettes(
    pixels: DataFrame, palettes: DataFrame, strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    facts = _require_colours(palettes).withColumn("coef", palette_coefficients(F.col("palette")))
    return attach_image_facts(pixels, facts, strip_pixels, tasks=tasks)


def label_with(attached: DataFrame, name: str, c: Rgb) -> DataFrame:
    """Add the nearest slot of colour ``c`` under ``name`` to rows that carry a palette."""
    return attached.withColumn(name, nearest_slot(c, F.col("palette"), F.col("coef")))


def _palette_colour(slot: Column) -> Rgb:
    return Rgb.of(F.get("palette", slot.cast("int")))


def assign_nearest(
    pixels: DataFrame, palettes: DataFrame, strip_pixels: int = STRIP_PIXELS, keep_alpha: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Label raster: ``image_id, x, y, w, h, slot`` and the colour of the slot, with ``keep_alpha``
    also the source's alpha ``a``. No snapping. For ``tasks`` see ``attach_image_facts``."""
    labelled = label_with(attach_palettes(pixels, palettes, strip_pixels, tasks), "slot", P.px())
    colour = _palette_colour(F.col("slot"))
    return labelled.select(
        "image_id", "x", "y", "w", "h", "slot",
        *(v.cast("bigint").alias(n) for n, v in zip("rgb", colour)),
        *([F.col("a").cast("bigint").alias("a")] if keep_alpha else []),
    )


def remap_to_palette(
    pixels: DataFrame, palettes: DataFrame, keep_alpha: bool = False,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Nearest colour, except that pixels near the background take the background itself.

    ``palettes`` carries ``bg_r, bg_g, bg_b`` besides the palette. With ``keep_alpha`` the
    output alpha follows the alpha rule for images flagged ``has_alpha``, if that column is
    there, and for all images otherwise.
    """
    labelled = label_with(attach_palettes(pixels, palettes, strip_pixels), "slot", P.px())
    snapped = rgb_dist2(P.px(), P.bg()) <= BG_DIST2
    colour = _palette_colour(F.col("slot"))
    out = [
        F.when(snapped, b).otherwise(v).cast("bigint").alias(n)
        for n, v, b in zip("rgb", colour, P.bg())
    ]
    if keep_alpha:
        ruled = alpha_rule(F.col("a"), snapped)
        flagged = F.col("has_alpha") if "has_alpha" in palettes.columns else F.lit(True)
        out.append(F.when(flagged, ruled).otherwise(255).cast("bigint").alias("a"))
    return labelled.select(
        "image_id", "x", "y", "w", "h",
        F.when(snapped, 0).otherwise(F.col("slot")).cast("bigint").alias("slot"), *out,
    )


def has_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.min("a") < 255).alias("has_alpha"))


def prepare_corpus(
    pixels: DataFrame, max_colors: int = 4, colors_mode: str = "up_to",
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Alpha test, palette and remap of a whole corpus."""
    if not isinstance(max_colors, int) or not 1 <= max_colors <= 16:
        raise ValueError(f"colors must be an integer in 1..16, got {max_colors!r}")
    if colors_mode not in ("up_to", "exact"):
        raise ValueError(f"colors_mode must be up_to or exact, got {colors_mode!r}")
    build = P.palette_exact if colors_mode == "exact" else P.palette_auto
    palettes = build(pixels, max_colors)
    return remap_to_palette(pixels, palettes, keep_alpha=True, strip_pixels=strip_pixels)


def prepare_by_settings(
    pixels: DataFrame, settings: DataFrame, strip_pixels: int = STRIP_PIXELS
) -> DataFrame:
    """``prepare_corpus`` with each image's own ``n, mode``, as ``validate_requests`` resolves them."""
    palettes = P.palette_by_settings(pixels, settings)
    return remap_to_palette(pixels, palettes, keep_alpha=True, strip_pixels=strip_pixels)


def ink_coverage(pixels: DataFrame) -> DataFrame:
    """Share of visible non-white pixels per image; transparent pixels count in the total."""
    ink = is_ink(P.px(), F.col("a") if "a" in pixels.columns else None)
    return pixels.groupBy("image_id").agg(
        (F.count_if(ink) / F.count(F.lit(1))).alias("ink_coverage")
    )
