"""Text measures of SVG documents, by regular expressions on the document column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.colour import NEAR_WHITE_MIN

# Fixed patterns.
D_ATTRIBUTE = r'(?i)\bd="([^"]*)"'
D_VALUE = r'(?i)(?<=\bd=")[^"]*(?=")'
NODE = r"(?i)[MLCQSTAZHV](?![a-z])"
SVG_TAG = r"(?i)<svg\b"
PATH_TAG = r"(?i)<path\b"
ZERO_PATH = r'd="M 0\.00 0\.00 L 0\.00 0\.00 Z"'
FILL = r'(?i)fill="(#[0-9A-Fa-f]{6})"'


def svg_d_extract(svg: Column) -> Column:
    """All path data strings of a document."""
    return F.regexp_extract_all(svg, F.lit(D_ATTRIBUTE), F.lit(1))


def svg_d_replace(svg: Column, by_place: Column) -> Column:
    """The document with the path data strings at the places of the map ``by_place`` exchanged."""
    between = F.split(svg, D_VALUE, -1)
    values = F.transform(svg_d_extract(svg), lambda d, i: F.coalesce(by_place[i], d))
    inner = F.transform(values, lambda d, i: F.concat(d, F.get(between, i + 1)))
    return F.when(by_place.isNull(), svg).otherwise(
        F.concat(F.get(between, F.lit(0)), F.array_join(inner, "")))


def svg_node_count(svg: Column) -> Column:
    """Drawing commands over all path data; a closing Z is a node too."""
    return F.aggregate(svg_d_extract(svg), F.lit(0),
                       lambda acc, d: acc + F.regexp_count(d, F.lit(NODE))).cast("bigint")


def degenerate_path_share(svg: Column) -> Column:
    """Share of zero-length paths among path elements; null without any path."""
    paths = F.regexp_count(svg, F.lit(PATH_TAG))
    return F.regexp_count(svg, F.lit(ZERO_PATH)) / F.nullif(paths, F.lit(0))


def looks_like_svg(svg: Column) -> Column:
    return F.coalesce(svg.rlike(SVG_TAG), F.lit(False))


def svg_fill_colors(svg: Column) -> Column:
    """Distinct fill colours that are not near-white, as written."""
    fills = F.array_distinct(F.regexp_extract_all(svg, F.lit(FILL), F.lit(1)))

    def channel(hex_: Column, at: int) -> Column:
        return F.conv(F.substring(hex_, at, 2), 16, 10).cast("int")

    return F.filter(fills, lambda f: F.least(*(channel(f, i) for i in (2, 4, 6))) < NEAR_WHITE_MIN)


def svg_rescale(svg: Column, scale: Column, width: Column, height: Column) -> Column:
    """Shrink traced coordinates back: one group after the opening tag, original size.

    Every ``width``/``height`` attribute of the document is set, not only the root's.
    """
    factor = F.format_string("%.6f", F.lit(1.0) / scale)
    sized = F.regexp_replace(
        F.regexp_replace(svg, F.lit(r'width="\d+(\.\d+)?"'),
                         F.concat(F.lit('width="'), width.cast("string"), F.lit('"'))),
        F.lit(r'height="\d+(\.\d+)?"'),
        F.concat(F.lit('height="'), height.cast("string"), F.lit('"')))
    # Only the first opening tag gets the group: the tail is taken lazily up to the end.
    grouped = F.regexp_replace(
        sized, F.lit(r"(?s)\A(.*?<svg\b[^>]*>)(.*)\z"),
        F.concat(F.lit('$1\n<g transform="scale('), factor, F.lit(", "), factor, F.lit(')">$2')))
    closed = F.replace(grouped, F.lit("</svg>"), F.lit("</g>\n</svg>"))
    return F.when(scale > 1.0, closed).otherwise(svg)
