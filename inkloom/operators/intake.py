"""Requests, output artifacts and the run log as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.requests import (
    is_sample_file, request_verdict, run_group, run_id, safe_name,
)
from inkloom.functions.svg import degenerate_path_share

# Fixed values.
MIN_ARTIFACT_BYTES = 500
MIN_COVERAGE = 0.002
MAX_DEGENERATE_SHARE = 0.5
SOURCE_COVERAGE = 0.01
KEPT_INK_SHARE = 0.05
MAX_RUNS = 500


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``reject_code``, ``reject_reason`` and the resolved ``n``, ``mode``."""
    extra = {c: F.col(c) for c in ("colors", "engine") if c in requests.columns}
    verdict = request_verdict(F.col("palette"), F.col("colors_mode"), F.col("format"),
                              F.col("geom"), F.col("n_bytes"), **extra)
    return (
        requests.withColumn("_v", verdict)
        .withColumn("reject_code", F.col("_v.code")).withColumn("reject_reason", F.col("_v.reason"))
        .withColumn("n", F.col("_v.n")).withColumn("mode", F.col("_v.mode")).drop("_v")
    )


def lost_ink(coverage: Column, source_coverage: Column) -> Column:
    """The output keeps less than a twentieth of the ink of a source that has some."""
    return F.coalesce((source_coverage > SOURCE_COVERAGE)
                      & (coverage < source_coverage * KEPT_INK_SHARE), F.lit(False))


def source_vs_output(source: DataFrame, output: DataFrame) -> DataFrame:
    """Coverage of both sides per image and whether the output lost the source's ink."""
    right = output.select("image_id", F.col("ink_coverage").alias("output_coverage"))
    left = source.select("image_id", F.col("ink_coverage").alias("source_coverage"))
    return left.join(right, "image_id").withColumn(
        "lost", lost_ink(F.col("output_coverage"), F.col("source_coverage")))


def artifact_qa(artifacts: DataFrame) -> DataFrame:
    """Adds ``status`` and ``reason``: pass, or the first failing check.

    Columns: ``present, n_bytes, suffix, content, ink_coverage, source_coverage`` (the last may
    be null, then it is not compared).
    """
    suffix = F.lower("suffix")
    reason = F.coalesce(
        F.when(~F.col("present"), "missing output"),
        F.when(F.col("n_bytes") < MIN_ARTIFACT_BYTES, "output too small"),
        F.when((suffix == ".pdf") & ~F.col("content").startswith("%PDF"), "not a PDF"),
        F.when((suffix == ".svg") & ~F.lower("content").contains("<svg"), "not an SVG"),
        F.when((suffix == ".svg") & (degenerate_path_share(F.col("content"))
                                     > MAX_DEGENERATE_SHARE), "mostly degenerate zero-paths"),
        F.when(~suffix.isin(".pdf", ".svg"), "unsupported type"),
        F.when(F.col("ink_coverage") < MIN_COVERAGE, "blank render"),
        F.when(lost_ink(F.col("ink_coverage"), F.col("source_coverage")),
               "output ink much lower than source"),
    )
    return artifacts.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "pass").otherwise("fail"))


def sample_filter(files: DataFrame, column: str = "path") -> DataFrame:
    """Corpus files named ``sample_*.jpg`` or ``sample_*.png``, in path order."""
    return files.filter(is_sample_file(F.regexp_extract(column, r"([^/]*)$", 1))).orderBy(column)


# --- run log ------------------------------------------------------------------------------


def run_records(runs: DataFrame) -> DataFrame:
    """Log records of finished runs; runs without input or output leave none."""
    fields = ["id", "ts", "source", "filename_hint", "colors", "colors_mode", "geom", "fmt",
              "palette", "input_bytes", "output_bytes"]
    return (
        runs.filter((F.col("input_bytes") > 0) & (F.col("output_bytes") > 0))
        .withColumn("id", run_id(F.col("ts")))
        .withColumn("filename_hint", safe_name(F.col("filename_hint")))
        .select(*fields)
    )


def run_groups(files: DataFrame) -> DataFrame:
    """Files ``name, ts`` grouped to runs: ``key`` and the newest time."""
    return files.filter(F.col("name").startswith("ui_")).groupBy(
        run_group(F.col("name")).alias("key")).agg(F.max("ts").alias("newest"))


def keep_newest_runs(files: DataFrame, max_runs: int = MAX_RUNS) -> DataFrame:
    """Run groups with ``keep``; the others are the list to delete. Nothing is deleted here.

    The newest ``max_runs`` groups come from a distributed top-k, not from a global ranking.
    """
    groups = run_groups(files)
    if max_runs <= 0:
        return groups.withColumn("keep", F.lit(True))
    newest = groups.orderBy(F.desc("newest"), F.desc("key")).limit(max_runs)
    marked = newest.select("key", F.lit(True).alias("keep"))
    return groups.join(marked, "key", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def latest_run(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The newest record, one row."""
    row = F.struct(*records.columns)
    return records.agg(F.max_by(row, F.struct(*(order or ["ts"]))).alias("r")).select("r.*")
