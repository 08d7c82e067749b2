"""Whole evaluation records and the reports written from them."""

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import evaluation as E
from inkloom.operators import quality as Q
from inkloom.operators import reports as Rp

WHITE, RED, BLUE = (255, 255, 255), (200, 30, 30), (30, 40, 190)
SVG = '<svg><path d="M 0 0 L 9 0 L 9 9 Z"/></svg>'


@pytest.fixture(scope="module")
def corpus(spark):
    """Three images, two variants: a perfect one, one with noise; an image not rendered, one not traced."""
    rng = random.Random(4)
    source, rendered = [], []
    for i in (1, 2, 3):
        w, h = 20 + i, 15 + i
        for y in range(h):
            for x in range(w):
                c = RED if 3 <= x < 9 and 3 <= y < 10 else BLUE if x > 12 else WHITE
                source.append((i, x, y, w, h, *c))
                if i != 2:
                    rendered.append((i, "same", x, y, w, h, *c))
                    rendered.append((i, "noisy", x, y, w, h, *(rng.choice([WHITE, RED]) if rng.random() < 0.2 else c)))
    schema = "x long, y long, w long, h long, r long, g long, b long"
    source = spark.createDataFrame(source, f"image_id long, {schema}")
    rendered = spark.createDataFrame(rendered, f"image_id long, variant string, {schema}")
    colours = [dict(slot=k, r=c[0], g=c[1], b=c[2]) for k, c in enumerate((WHITE, RED, BLUE))]
    palettes = spark.createDataFrame(
        [(i, 20 + i, 15 + i, *WHITE, colours) for i in (1, 2, 3)],
        "image_id long, w long, h long, bg_r long, bg_g long, bg_b long, "
        "palette array<struct<slot:bigint,r:bigint,g:bigint,b:bigint>>")
    traces = spark.createDataFrame(
        [(i, v, f"logo.{i}.png", None if i == 3 else SVG, 4, up, 1.0, "outline", 0.0 if i == 1 else 2.5,
          "tracer stopped" if i == 3 else None)
         for i in (1, 2, 3) for v, up in (("same", "off"), ("noisy", "auto"))],
        "image_id long, variant string, file string, svg string, colors_requested int, upscale string, "
        "effective_scale double, engine string, elapsed double, error string")
    records = E.evaluation_records(source, rendered, palettes, traces, ["same", "noisy"]).cache()
    return source, rendered, palettes, records


def test_records(corpus):
    source, rendered, palettes, records = corpus
    assert records.columns == E.RECORD
    rows = {(r.file, r.variant): r for r in records.collect()}
    assert len(rows) == 6
    same, noisy = rows["logo.1.png", "same"], rows["logo.1.png", "noisy"]
    assert (same.sample, same.iou_mean, same.chamfer, same.degenerate, same.nodes, same.svg_bytes) == (
        "logo.1", 1.0, 0.0, True, 4, len(SVG))
    assert [m.color for m in same.per_mask] == ["#ffffff", "#c81e1e", "#1e28be"]
    assert sum(m.area_pct for m in same.per_mask) == pytest.approx(100, abs=0.02) and same.bg_color == "#ffffff"
    assert noisy.iou_mean < 1 and noisy.chamfer > 0 and not noisy.degenerate and noisy.render_ok
    plain = Q.evaluate(source, rendered.filter("variant = 'noisy'"), palettes).filter("image_id = 1").first()
    for k in ("iou_mean", "iou_worst", "iou_aw", "iou_bg", "iou_unmatched", "chamfer"):
        assert noisy[k] == plain[k]
    lost = rows["logo.2.png", "same"]
    assert (lost.render_ok, lost.iou_mean, lost.nodes, lost.iou_unmatched, lost.per_mask, lost.error) == (
        False, None, 4, 0, None, None)
    bad = rows["logo.3.png", "noisy"]
    assert (bad.render_ok, bad.palette, bad.bg_color, bad.nodes, bad.svg_bytes, bad.chamfer, bad.error) == (
        False, [], None, None, 0, None, "tracer stopped")


@pytest.mark.parametrize("strip_pixels", [40, 1 << 18])
def test_pixels_are_exchanged_once(corpus, strip_pixels):
    source, rendered, palettes, _ = corpus
    traces = E.label_traces(source, rendered, palettes, ["same", "noisy"], strip_pixels)
    plan = traces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    got = {tuple(r) for r in traces.filter("image_id = 3").collect()}  # image 1, noisy
    pairs = Q.label_pairs(source, rendered.filter("variant = 'noisy'"), palettes).filter("image_id = 1")
    edges = Q.edge_pair(pairs).select("image_id", "x", "y", "ref_edge", "out_edge")
    want = pairs.join(edges, ["image_id", "x", "y"], "left").select(
        F.lit(3), "x", "y", "w", "h", "ref_slot", "out_slot", F.coalesce("ref_edge", F.lit(False)),
        F.coalesce("out_edge", F.lit(False)))
    assert got == {tuple(r) for r in want.collect()}


def test_report_sections(corpus):
    records = corpus[3]
    lines = [r.line for r in Rp.report_lines(records.filter("variant = 'same'"), "v9", "today").orderBy("section", "no").collect()]
    text = "\n".join(lines)
    assert lines[:5] == ["# Evaluation (v9)", "", "**Samples:** 3", "**Date:** today", ""]
    assert "**Upscale:**" not in text
    assert "| 1 | `logo.1.png` | 21×16 | #ffffff, #c81e1e, #1e28be | 1.0000 ⚠ | 1.0000 | 1.0000 | 1.0000 | 0.00 | 4 | 0.0 | — |" in lines
    assert "| 2 | `logo.2.png` | 22×17 | #ffffff, #c81e1e, #1e28be | — | — | — | — | — | 4 | 0.0 | 2.5s |" in lines
    assert "| 3 | `logo.3.png` | 23×18 | — | — | — | — | — | — | None | 0.0 | 2.5s |" in lines
    assert "> ⚠ = degenerate metric" in lines and "- **Degenerate samples:** 1" in lines
    assert "| `logo.1.png` | #c81e1e | ink | 1.0000 | 12.5% |" in lines
    assert "- **IoU mean:**  1.0000  (min: 1.0000, max: 1.0000)" in lines
    assert not any(x.startswith("- **Chamfer mean") for x in lines)  # the only one is degenerate
    assert lines[lines.index("## Worst Chamfer") + 2] == "- `logo.1.png` — Chamfer 0.00 px, IoU mean 1.0000"
    assert lines[-3:] == ["## Render Failures", "- `logo.2.png` — render-back failed", "- `logo.3.png` — tracer stopped"]
    noisy = [r.line for r in Rp.report_lines(records.filter("variant = 'noisy'"), "v9", "today").orderBy("section", "no").collect()]
    assert noisy[5:7] == ["**Upscale:** auto", ""] and "> ⚠ = degenerate metric" not in noisy
    empty = [r.line for r in Rp.report_lines(records.limit(0), "v9", "today").orderBy("section", "no").collect()]
    assert "**Samples:** 0" in empty and "## Render Failures" not in empty and "## Per-Mask Detail" not in empty


def test_matrix_sections(corpus):
    lines = [r.line for r in Rp.matrix_lines(corpus[3], ["same", "noisy"], "today").orderBy("section", "sample", "no").collect()]
    at = lines.index("## IoU aw")
    assert lines[at + 2] == "| Sample | same | noisy |" and lines[at + 4].startswith("| `logo.1` | 1.0000 | 0.")
    assert lines[at + 5:at + 8] == ["| `logo.2` | — | — |", "| `logo.3` | — | — |", ""]
    assert "| Nodes | 4 | 4 |" in lines and "## Aggregate (mean across samples)" in lines
