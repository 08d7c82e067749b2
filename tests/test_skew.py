"""The pixel queries where one image holds a third of all pixels and no fact is broadcast."""

import os
from pathlib import Path

import duckdb
import pytest
from compare import TABLES, compare

from inkloom.operators import labels as L
from inkloom.operators import palette as P
from inkloom.operators import quality as Q
from inkloom.operators import regions as R
from inkloom.plans import derived, spread
from inkloom.plans.spread import tasks_for, with_halo

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for t in TABLES:
        if t != "lineitem":
            Path(folder, f"{t}.parquet").symlink_to(f"{SOURCE}/{t}.parquet")
    # The bigger table makes the hot image tall enough to be box-reduced.
    duckdb.connect().execute(f"""
        COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 8 ELSE l_suppkey END AS l_suppkey)
              FROM '/root/testdata/sf0.01/lineitem.parquet' WHERE l_orderkey % 2 = 0)
        TO '{folder}/lineitem.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", [
    "A3_color_clusters", "A11_palette_auto", "J2b_prepare_corpus", "A17_sample_iou", "A18_edge_map",
    "A19_chamfer", "R0_binary_opening", "S6_sample_report",
])
def test_hot_image(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(derived, "RANGE_ROWS", 1024)
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    ok, text = compare(spark, name, skewed)
    assert ok, text


def test_scratch_leaves_nothing(spark, raster):
    def paint(x, y):
        return (200, 30, 30) if 5 < x < 20 and 5 < y < 20 else (255, 255, 255)

    px = raster({1: (30, 30, paint)})
    palettes = P.palette_auto(px)
    with spread.scratch(spark) as folder:
        rows = Q.evaluate(px, px, palettes).collect()
        path = folder.removeprefix("file:")
        assert rows and os.listdir(path)
    assert not os.path.exists(path)


def test_strips_are_dealt_by_their_rows(spark, raster):
    """The number of tasks follows the pixels, not their compressed bytes."""
    assert tasks_for(spark, 10, 1000) == spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 10**9, 1 << 20) == 954
    px = raster({1: (8, 64, lambda x, y: (1, 2, 3))})
    for named in (None, 23):
        placed = with_halo(px, 1, 64, named)
        assert placed.rdd.getNumPartitions() == (named or spark.sparkContext.defaultParallelism)


def test_pixel_joins_keep_a_named_number_of_tasks(spark, skewed, monkeypatch):
    """Merged to tasks by compressed bytes, or dealt to a fixed number, a task's pixels grow with the table."""
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    px = spread.store(derived.pixels(spark, skewed))
    palettes = spread.store(derived.band_palettes(px))
    pairs = Q.label_pairs(px, derived.traced(px), palettes, tasks=13)
    runs = R.label_runs(L.assign_nearest(px, palettes, tasks=13), [], 13)
    for df, exchanges in ((pairs, 3), (runs, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count(", 13), REPARTITION_BY_NUM") == exchanges


def test_halo_rows_are_generated_code(spark, raster):
    px = raster({1: (2, 40, lambda x, y: (y, 0, 0))})
    placed = with_halo(px, 1, strip_pixels=20, tasks=4)
    assert "lambdafunction" not in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.filter("own").count() == 80 and placed.filter("NOT own").count() == 2 * 2 * 3


@pytest.mark.parametrize("name", ["R2_snap_disks_alpha", "E2_requested_palettes"])
def test_hot_image_more(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    ok, text = compare(spark, name, skewed)
    assert ok, text


def test_wanted_images_meet_their_pixels_by_strip(spark, skewed, monkeypatch):
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)
    seen, attach = [], P.attach_image_facts
    monkeypatch.setattr(P, "attach_image_facts", lambda *a, **k: seen.append(k["tasks"]) or attach(*a, **k))
    px = spread.store(derived.pixels(spark, skewed))
    ids = [r[0] for r in px.select("image_id").distinct().orderBy("image_id").limit(3).collect()]
    settings = spark.createDataFrame([(i, 3, "auto") for i in ids[:2]], "image_id long, n int, mode string")
    got = {r.image_id for r in P.palette_by_settings(px, settings).collect()}
    assert got == set(ids[:2]) and seen == [tasks_for(spark, px.count())]
