"""Colour arithmetic on channel columns (all 0..255 integers)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules below only give the expected palettes with these.
BG_DIST2 = 45 * 45
MERGE_DIST2 = 35 * 35
ULTRA_CLOSE_DIST2 = 12 * 12
NEAR_WHITE_MIN = 230
MIN_MAJOR_MASS = 0.03
MIN_ABSOLUTE_COUNT = 8
GRAY_SAT_MAX = 0.14
HUE_BUCKET_DEG = 28.0
MERGE_HSL = 0.18
AUTO_MAX_INKS = 8
PALETTE_SIDE = 320
ALPHA_MIN = 16


class Rgb(NamedTuple):
    """Three channel columns that travel together."""

    r: Column
    g: Column
    b: Column

    @staticmethod
    def cols(r: str = "r", g: str = "g", b: str = "b") -> "Rgb":
        return Rgb(F.col(r), F.col(g), F.col(b))

    @staticmethod
    def of(struct: Column, prefix: str = "") -> "Rgb":
        return Rgb(*(struct[prefix + c] for c in "rgb"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rgb_dist2(a: Rgb, b: Rgb) -> Column:
    dr, dg, db = a.r - b.r, a.g - b.g, a.b - b.b
    return dr * dr + dg * dg + db * db


def is_near_white(c: Rgb, minimum: int = NEAR_WHITE_MIN) -> Column:
    return F.least(*c) >= minimum


def lightness(c: Rgb) -> Column:
    """Plain channel mean, not the L of HSL."""
    return (c.r + c.g + c.b) / F.lit(3.0)


def saturation(c: Rgb) -> Column:
    top, low = F.greatest(*c) / F.lit(255.0), F.least(*c) / F.lit(255.0)
    return F.when(top < 1e-9, 0.0).otherwise((top - low) / F.nullif(top, F.lit(0.0)))


def hue_deg(c: Rgb) -> Column:
    """Hue in [0, 360); exact greys are pinned to 0; ties of the maximum go r, g, b."""
    r, g, b = (ch / F.lit(255.0) for ch in c)
    top, low = F.greatest(*c), F.least(*c)
    span = F.nullif(top / F.lit(255.0) - low / F.lit(255.0), F.lit(0.0))
    sector = (
        F.when(top == c.r, (g - b) / span)
        .when(top == c.g, F.lit(2.0) + (b - r) / span)
        .otherwise(F.lit(4.0) + (r - g) / span)
    ) * F.lit(60.0)
    return F.when(top == low, 0.0).when(sector < 0, sector + 360.0).otherwise(sector)


def hue_gap(h1: Column, h2: Column) -> Column:
    gap = F.abs(h1 - h2)
    return F.least(gap, F.lit(360.0) - gap)


def hsl_gap(l1: Column, s1: Column, h1: Column, l2: Column, s2: Column, h2: Column) -> Column:
    """Weighted distance from ready lightness, saturation and hue values."""
    dl = F.lit(2.0) * (F.abs(l1 - l2) / F.lit(255.0))
    ds = F.abs(s1 - s2)
    dh = hue_gap(h1, h2) / F.lit(180.0)
    return F.sqrt(dl * dl + ds * ds + dh * dh)


def hsl_distance(a: Rgb, b: Rgb) -> Column:
    return hsl_gap(
        lightness(a), saturation(a), hue_deg(a), lightness(b), saturation(b), hue_deg(b)
    )


def bucket4(c: Rgb) -> Rgb:
    """The 16-level bucket of each channel."""
    return Rgb(*(F.shiftright(ch, 4) for ch in c))


def hex_color(c: Rgb) -> Column:
    return F.format_string("#%02x%02x%02x", *c)


def hex_palette(palette: Column) -> Column:
    """``#rrggbb, #rrggbb``; a dash for an empty or missing palette."""
    text = F.concat_ws(", ", F.transform(palette, lambda p: hex_color(Rgb.of(p))))
    return F.when(F.coalesce(F.size(palette), F.lit(0)) > 0, text).otherwise("—")


def alpha_rule(alpha: Column, snapped: Column) -> Column:
    """Alpha of a remapped pixel: background and near-transparent pixels vanish."""
    return F.when(snapped | (alpha < ALPHA_MIN), 0).otherwise(alpha)


def is_greenish(c: Rgb) -> Column:
    return (c.g > c.r + 20) & (c.g > c.b + 10)


def is_goldish(c: Rgb) -> Column:
    return (c.r > c.g + 20) & (c.g > c.b + 10) & (c.r > 150)


def is_ink(c: Rgb, alpha: Column | None = None, white: int = 250) -> Column:
    """Visible and darker than ``white`` on some channel."""
    dark = F.least(*c) < white
    return dark if alpha is None else dark & (alpha >= ALPHA_MIN)
