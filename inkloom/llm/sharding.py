"""Sharding by a keyed permutation of global row numbers.

Rows get dense numbers 0 .. n-1 in the order of (doc_id, text); a Feistel network permutes
[0, 4^b), the smallest such range that holds n, and walks a cycle until it is back below n. Row p of the
permuted order goes to shard ``p mod shards``, slot ``p div shards``: the shuffle depends only on
the rows, their number and the seed, shard counts differ by one at most (law ``rows``), and
``position``/``row_at`` compute place from row and row from place without any table.

The numbering shuffles 40-byte rows, not texts: they are range-partitioned, written sorted to the
shared folder with their place in their file, and a count per file gives the offsets. Equal rows
may fill several files, so no key is tied to one task, and a lost executor cannot renumber rows
that have been written.

Null doc_ids come first; a null text counts as empty (16 bytes with the overhead, checksum 0);
rows equal in doc_id and text take adjacent numbers in any order, which leaves the result the
same. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.plans.spread import shared_table_path

ROUNDS = 8
OVERHEAD = 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    steps = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(steps + np.uint64(seed & (2**64 - 1)))


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, keys: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> b, x & low
    for k in keys if forward else keys[::-1]:
        if forward:
            left, right = right, left ^ (_mix(right ^ k) & low)
        else:
            left, right = right ^ (_mix(left ^ k) & low), left
    return (left << b) | right


def _walk(x: np.ndarray, n: int, seed: int, forward: bool) -> np.ndarray:
    keys, bits = _keys(seed), _half_bits(n)
    out = _network(np.asarray(x).astype(np.uint64), keys, bits, forward)
    away = np.flatnonzero(out >= n)
    while len(away):
        out[away] = _network(out[away], keys, bits, forward)
        away = away[out[away] >= n]
    return out.astype(np.int64)


def position(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Permuted places of row numbers below ``n``."""
    return _walk(rows, n, seed, True)


def row_at(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of ``position``."""
    return _walk(places, n, seed, False)


def number_rows(rows: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """``rows`` with a dense 0-based number in the order of ``order``, and their count."""
    spark = rows.sparkSession
    path = shared_table_path(spark, "numbered")
    (rows.withColumn("_salt", F.monotonically_increasing_id())
     .repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
     .withColumn("_at", F.monotonically_increasing_id())
     .write.parquet(path))
    written = spark.read.parquet(path).withColumn("_file", F.shiftright("_at", 33))
    counts = sorted(tuple(r) for r in written.groupBy("_file").count().collect())  # one per task
    starts, n = [], 0
    for file, c in counts:
        starts.append((file, n))
        n += c
    offsets = spark.createDataFrame(starts or [(0, 0)], "_file bigint, _start bigint")
    numbered = written.join(F.broadcast(offsets), "_file").withColumn(
        name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("_file", "_start", "_at"), n


def assign(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus overhead), text_crc32, row, shard, slot per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"))
    rows, n = number_rows(light, ["doc_id", "text_crc32", "_h"])

    @F.pandas_udf("bigint")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(position(row.to_numpy(), n, seed))

    return (
        rows.withColumn("_p", place("row"))
        .withColumn("shard", (F.col("_p") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_p") / shards).cast("bigint"))
        .drop("_p", "_h")
    )


def query(docs: DataFrame) -> DataFrame:
    return assign(docs, 40, seed=2024).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("row").alias("row_number"))
