"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def id_or_least() -> Column:
    """doc_id, with the least bigint for null."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver; tasks get its few MB with their closure."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def map_rows(
    df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], Iterator]]
) -> DataFrame:
    """``mapInArrow`` with per-task state: ``start()`` runs once in a task and returns the
    function that turns a batch into batches (or tables)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if batch.num_rows:
                for out in work(batch):
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``chars`` bytes of ``column``; one long text is a slice."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > chars:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)
