"""Files in and out: images, SVG documents, metrics, run log, streams."""

import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkloom.functions.requests import effective_scale, requested_scale, run_id, safe_name, sniff_format
from inkloom.operators import intake as I
from inkloom.operators import reports as Rp
from inkloom.sources import images as Im
from inkloom.sources import sinks
from inkloom.streaming.run_log import stream_rejects, stream_run_log


def png(path, w, h, paint, channels=3):
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + bytes(v for x in range(w) for v in paint(x, y)) for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("channels,paint", [
    (3, lambda x, y: (x * 3, y * 5, 7)), (4, lambda x, y: (x, y, 200, (x * y) % 256)), (1, lambda x, y: (x + y,)),
])
def test_pixels_of_png(spark, tmp_path, channels, paint, monkeypatch):
    monkeypatch.setattr(Im, "STRIP_PIXELS", 100)
    png(tmp_path / "sample_1.png", 31, 17, paint, channels)
    files = Im.read_images(spark, str(tmp_path))
    good, bad = files.filter('reason IS NULL'), files.filter('reason IS NOT NULL')
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in Im.explode_pixels(good).collect()}
    assert len(got) == 31 * 17 and bad.count() == 0
    for (x, y), colour in got.items():
        p = paint(x, y)
        want = {1: p * 3 + (255,), 3: p + (255,), 4: p}[channels]
        assert colour == want


def test_quarantine_and_glob(spark, tmp_path):
    png(tmp_path / "sample_1.png", 3, 3, lambda x, y: (1, 2, 3))
    png(tmp_path / "other.png", 3, 3, lambda x, y: (1, 2, 3))
    (tmp_path / "sample_2.jpg").write_bytes(b"not an image")
    files = Im.read_images(spark, str(tmp_path), Im.SAMPLE_GLOB)
    good, bad = files.filter('reason IS NULL'), files.filter('reason IS NOT NULL')
    assert good.count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["sample_2.jpg"]
    kinds = {r.path.rsplit("/", 1)[1]: r.ext for r in Im.read_file_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"sample_1.png": ".png", "other.png": ".png", "sample_2.jpg": ".jpg"}
    files = Im.read_file_kinds(spark, str(tmp_path))
    assert I.sample_filter(files).count() == 2


def test_svg_files(spark, tmp_path):
    (tmp_path / "a.svg").write_text("<?xml?>\n<SVG width='1'>\n</SVG>")
    (tmp_path / "b.svg").write_text("nothing")
    good, bad = Im.read_svg_docs(spark, str(tmp_path))
    assert good.count() == 1 and good.first().svg.startswith("<?xml?>")
    assert bad.first().path.endswith("b.svg")


def test_sniff_and_names(spark):
    cases = [("a.JPEG", b"", ".jpg"), ("x", b"\xff\xd8\xff1", ".jpg"), ("x.tar", b"\x89PNG\r\n\x1a\n", ".png"),
             ("x", b"RIFF1234WEBPxx", ".webp"), ("x", b"GIF89a", ".gif"), ("x", b"GIF88a", ".bin"), ("x", b"", ".bin")]
    df = spark.createDataFrame([(n, bytearray(c), w) for n, c, w in cases], "n string, c binary, w string")
    assert df.filter(sniff_format(F.col("n"), F.col("c")) != F.col("w")).count() == 0
    names = [("/a/b c.png", "b_c.png"), ("..__", "upload.bin"), ("", "upload.bin"), (None, "upload.bin"),
             ("dir/.hid!den.", "hid_den"), ("é.jpg", "jpg"), ("x" * 100, "x" * 80), ("a/..", "upload.bin")]
    df = spark.createDataFrame(names, "n string, w string")
    assert df.filter(safe_name(F.col("n")) != F.col("w")).collect() == []


def test_scales_and_run_id(spark):
    df = spark.createDataFrame([(4000, 3000), (1000, 1000), (2000, 2000), (3000, 100)], "w int, h int")
    got = [r[0] for r in df.select(effective_scale(F.col("w"), F.col("h"))).collect()]
    assert got == pytest.approx([1.0, 2.0, 1.536, 1.0])
    assert spark.range(1).select(requested_scale(F.lit("4x-smooth"))).first()[0] == 4.0
    ts = spark.createDataFrame([(datetime(2026, 7, 21, 10, 5, 9, 123999),)], "ts timestamp_ntz")
    got = ts.select(run_id(F.col("ts"))).first()[0]
    assert got.startswith("ui_20260721_100509_") and got.endswith("123")


def metric_rows(spark):
    cols = ("sample string, variant string, iou_mean double, iou_aw double, iou_bg double, chamfer double, "
            "nodes long, svg_bytes long, elapsed double, render_ok boolean, degenerate boolean, error string, "
            "palette array<struct<r:int,g:int,b:int>>")
    return spark.createDataFrame([
        ("s1", "a", 0.9, 0.95, None, 1.0, 10, 2048, 2.0, True, False, None, [(1, 2, 255)]),
        ("s2", "a", 0.7, 0.85, 0.5, 9.0, 20, 1024, 0.0, True, True, None, []),
        ("s3", "a", None, None, None, None, None, 0, 1.0, False, False, None, None),
        ("s1", "b", 0.5, 0.6, 0.4, 3.0, 12, 512, 3.0, True, False, None, [(0, 0, 0)]),
    ], cols)


def test_reports(spark, tmp_path):
    m = metric_rows(spark)
    row = Rp.report_aggregates(m.filter("variant = 'a'")).first()
    assert (row.samples, row.degenerates, row.iou_bg_avg, row.chamfer_max) == (3, 1, 0.5, 1.0)
    assert row.iou_mean_avg == pytest.approx(0.8) and row.time_avg == 1.5 and row.time_total == 3.0
    assert [r.sample for r in Rp.worst_chamfer(m, 2).collect()] == ["s2", "s1"]
    assert Rp.render_failures(m).first().reason == "render-back failed"
    matrix = {r["sample"]: r for r in Rp.variant_matrix(m, ["a", "b"]).collect()}
    assert matrix["s1"].b_chamfer == 3.0 and matrix["s3"].a_nodes is None
    lines = Rp.sample_report(m)
    assert [r.no for r in lines.orderBy("no").collect()] == [1, 2, 3, 4]
    sinks.write_report(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "| 1 | `s1` | #0102ff | 0.9000 | 0.9500 | — | 1.00 | 10 | 2.0 | 2.0s |" in text
    assert any("—" in t and "`s3`" in t for t in text) and any("⚠" in t for t in text)
    stored = sinks.write_metrics(m, str(tmp_path / "metrics"))
    assert stored.filter("variant = 'b'").count() == 1 and stored.columns == m.columns


def test_keep_newest(spark):
    files = spark.createDataFrame(
        [(f"ui_20260101_{i:06d}_00000_x.jpg", i) for i in range(10)] + [("ui_short", 99), ("last.jpg", 100)],
        "name string, ts long")
    got = {r.key: r.keep for r in I.keep_newest_runs(files, 3).collect()}
    assert len(got) == 11 and {k for k, v in got.items() if v} == {
        "ui_short", "ui_20260101_000009_00000", "ui_20260101_000008_00000"}
    assert I.keep_newest_runs(files, 0).filter("NOT keep").count() == 0


def test_artifact_checks(spark):
    svg = "<SVG>" + "<path d='x'/>" * 60
    rows = [
        (1, True, 900, ".svg", svg, 0.5, None, None), (2, False, 900, ".svg", svg, 0.5, None, "missing output"),
        (3, True, 499, ".svg", svg, 0.5, None, "output too small"), (4, True, 900, ".pdf", "x", 0.5, None, "not a PDF"),
        (5, True, 900, ".PDF", "%PDF-", 0.001, None, "blank render"), (6, True, 900, ".svg", "<s>", 0.5, None, "not an SVG"),
        (7, True, 900, ".png", "", 0.5, None, "unsupported type"),
        (8, True, 900, ".pdf", "%PDF-", 0.01, 0.9, "output ink much lower than source"),
        (9, True, 900, ".svg", '<svg><path d="M 0.00 0.00 L 0.00 0.00 Z"/></svg>', 0.5, None,
         "mostly degenerate zero-paths"),
    ]
    df = spark.createDataFrame(rows, "id int, present boolean, n_bytes long, suffix string, content string, "
                               "ink_coverage double, source_coverage double, want string")
    assert I.artifact_qa(df).filter(~F.col("reason").eqNullSafe(F.col("want"))).count() == 0


def test_streamed_intake(spark, tmp_path):
    asks = spark.createDataFrame(
        [(1, "auto", "auto", "pdf", "off", 10), (2, "99", "auto", "pdf", "off", 10), (3, "2", "auto", "pdf", "off", 0)],
        "req_id long, palette string, colors_mode string, format string, geom string, n_bytes long")
    asks.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(asks.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        stream_rejects(live, str(tmp_path / "rej"), str(tmp_path / "ck1")).awaitTermination()
    got = {r.req_id: r.reject_reason for r in spark.read.parquet(str(tmp_path / "rej")).collect()}
    assert got == {2: "colors must be 1..16, got 99", 3: "empty file"}

    runs = spark.createDataFrame(
        [(datetime(2026, 1, 1), "api", "a b.png", 2, "exact", "off", "pdf", [(1, 2, 3)], 5, 6),
         (datetime(2026, 1, 2), "api", "c.png", 2, "exact", "off", "pdf", [], 0, 6)],
        "ts timestamp, source string, filename_hint string, colors int, colors_mode string, geom string, fmt string, "
        "palette array<struct<r:int,g:int,b:int>>, input_bytes long, output_bytes long")
    runs.write.parquet(str(tmp_path / "runs"))
    live = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))
    stream_run_log(live, str(tmp_path / "log"), str(tmp_path / "ck2")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 1 and log.first().filename_hint == "a_b.png"
    assert sinks.append_runs(I.run_records(runs), str(tmp_path / "log2")).count() == 1
    assert sinks.append_runs(I.run_records(runs), str(tmp_path / "log2")).count() == 2
    assert I.latest_run(log).first().id == log.first().id


@pytest.mark.parametrize("kind,tolerance", [("jpg", 3), ("gif", 0)])
def test_other_image_formats(spark, tmp_path, kind, tolerance):
    """Files written by the JVM's own encoder read back with their colours.

    JPEG stores colour at half resolution and blends it at borders, so for it only the flat
    parts, two pixels away from the border, are compared.
    """
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(32, 16, 1)
    for x in range(32):
        for y in range(16):
            image.setRGB(x, y, 0xC82814 if x < 16 else 0x1428C8)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / f"sample_1.{kind}")))
    files = Im.read_images(spark, str(tmp_path))
    good, bad = files.filter('reason IS NULL'), files.filter('reason IS NOT NULL')
    assert bad.count() == 0
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in Im.explode_pixels(good).collect()}
    assert len(got) == 512
    for (x, y), colour in got.items():
        if kind == "jpg" and 13 < x < 18:
            continue
        want = (200, 40, 20) if x < 16 else (20, 40, 200)
        assert all(abs(a - b) <= tolerance for a, b in zip(colour, want)), (x, y, colour)
