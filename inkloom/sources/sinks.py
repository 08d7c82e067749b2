"""Metric tables and the run log on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_metrics(metrics: DataFrame, path: str, by: str = "variant") -> DataFrame:
    """Store metrics partitioned by variant and return the stored table."""
    metrics.write.mode("overwrite").partitionBy(by).parquet(path)
    stored = metrics.sparkSession.read.schema(metrics.schema).parquet(path)
    return stored.select(*metrics.columns)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text files in reading order."""
    lines.orderBy("no").select("line").write.mode("overwrite").text(path)


def append_runs(records: DataFrame, path: str) -> DataFrame:
    """Append run records to the log and return the whole log."""
    records.write.mode("append").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path)
