"""How work is spread over tasks.

An image or an outline may be arbitrarily large, so no operator partitions by ``image_id``
or ``path_id`` alone. Pixels are grouped in *strips*: bands of whole rows holding about
``STRIP_PIXELS`` pixels. Per-image facts reach the pixels through an equi-join on
``(image_id, strip)``, with the fact row repeated once per strip; neighbourhood windows run
inside a strip after the rows next to its border have been copied into it.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRIP_PIXELS = 1 << 18
# A fact row holds at most a palette of 17 colours with its coefficients, about 1.5 kB.
BROADCAST_ROWS = 20_000
MIN_STRIP_ROWS = 8
#: Rows of a task that sorts pixels, give or take a few strips.
TASK_ROWS = 1 << 20


def int_div(a: Column, b) -> Column:
    """Integer quotient as bigint, for non-negative operands."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, b)


def strip_rows(w: Column, strip_pixels: int = STRIP_PIXELS) -> Column:
    return F.greatest(int_div(F.lit(strip_pixels), F.greatest(w, F.lit(1))), F.lit(MIN_STRIP_ROWS))


def strip_of(y: Column, w: Column, strip_pixels: int = STRIP_PIXELS) -> Column:
    return int_div(y, strip_rows(w, strip_pixels))


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for so many rows. A named number is kept as it is, where a shuffle without one is merged to
    tasks by its compressed bytes, whatever their rows take once they are sorted."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def join_large(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the tables, by shuffle and sort.

    The planner guesses a side's size from its file, which folds and exploded rows leave far behind; a side
    guessed small would be broadcast through the driver whatever it holds.
    """
    return left.join(right.hint("merge"), on, how)


def attach_image_facts(
    pixels: DataFrame, facts: DataFrame, strip_pixels: int = STRIP_PIXELS, how: str = "inner",
    tasks: int | None = None,
) -> DataFrame:
    """Join of per-image ``facts`` (with ``w`` and ``h``) to pixel rows.

    The facts are stored first, which makes their number known: up to ``BROADCAST_ROWS`` they
    are broadcast and the pixels are not shuffled at all. Beyond it the join key carries the
    strip, so one huge image never lands in one task; ``tasks`` then names the number of tasks.
    """
    stored = checkpoint(facts)
    if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return pixels.join(F.broadcast(stored.drop("w", "h")), "image_id", how)
    last = strip_of(F.col("h") - 1, F.col("w"), strip_pixels)
    per_strip = stored.withColumn("_strip", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    keyed = pixels.withColumn("_strip", strip_of(F.col("y"), F.col("w"), strip_pixels))
    if tasks:
        keyed = keyed.repartition(tasks, "image_id", "_strip")
    return join_large(keyed, per_strip.drop("w", "h"), ["image_id", "_strip"], how).drop("_strip")


def with_halo(
    pixels: DataFrame, halo: int, strip_pixels: int = STRIP_PIXELS, tasks: int | None = None
) -> DataFrame:
    """Place every pixel in its strip and copy border rows to the adjacent strips.

    Adds ``strip`` and ``own`` (false on copies) and shuffles once on (image_id, strip), which
    serves all later windows that also partition by a row or a column of the strip. Without
    ``tasks`` the pixels are counted; a caller who knows their number spares that pass.
    """
    tasks = tasks or tasks_for(pixels.sparkSession, pixels.count())
    rows = strip_rows(F.col("w"), strip_pixels)
    home = strip_of(F.col("y"), F.col("w"), strip_pixels)
    offset = F.col("y") - home * rows
    last = strip_of(F.col("h") - 1, F.col("w"), strip_pixels)
    # Nulls are filtered behind the explode: ``array_compact`` would take the stage out of code generation.
    places = F.array(
        home,
        F.when((offset < halo) & (home > 0), home - 1),
        F.when((offset >= rows - halo) & (home < last), home + 1),
    )
    return (
        pixels.withColumn("_home", home)
        .withColumn("strip", F.explode(places)).filter("strip IS NOT NULL")
        .withColumn("own", F.col("strip") == F.col("_home"))
        .drop("_home")
        .repartition(tasks, "image_id", "strip")
    )


def number_rows(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], total: str | None = None
) -> DataFrame:
    """0-based position ``i`` of each row within ``keys``, ordered by ``order``.

    ``bucket`` is a coarse, order-preserving column. Rows are numbered inside (keys, bucket) and
    shifted by the counts of the earlier buckets, so a huge group is numbered by many tasks.
    ``total`` names an extra column for the group's row count.
    """
    group = Window.partitionBy(*keys)
    starts = (
        df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_start", F.sum("_c").over(group.orderBy(bucket)) - F.col("_c"))
    )
    if total:
        starts = starts.withColumn(total, F.sum("_c").over(group))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    numbered = df.withColumn("_k", F.row_number().over(within) - 1)
    return (
        join_large(numbered, starts.drop("_c"), [*keys, bucket])
        .withColumn("i", F.col("_k") + F.col("_start"))
        .drop("_k", "_start")
    )


def whole_groups(
    df: DataFrame, keys: list[str], order: list[str], work, schema: str, tasks: int | None = None
) -> DataFrame:
    """Run ``work`` on pandas frames holding many whole groups of ``keys``, rows in ``order``.

    For groups of bounded size. One shuffle and one sort; a group cut by a batch border waits
    for its remaining rows, so ``work`` can treat all groups of a frame at once. ``tasks`` names the number
    of tasks, for groups whose rows are known to be many.
    """
    # Executors need not have this package installed.
    for name in {work.__module__, __name__} - {"__main__"}:
        cloudpickle.register_pickle_by_value(sys.modules[name])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for frame in frames:
            if frame.empty:
                continue
            last = frame[keys].iloc[-1]
            tail = (frame[keys] == last).all(axis=1)
            if waiting and tail.all() and (waiting[0][keys].iloc[0] == last).all():
                waiting.append(frame)
                continue
            ready = pd.concat([*waiting, frame[~tail]], ignore_index=True)
            waiting = [frame[tail]]
            if len(ready):
                yield work(ready)
        if waiting:
            yield work(pd.concat(waiting, ignore_index=True))

    dealt = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(batches, schema)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one named by ``spark.checkpoint.dir``. Only a local master may fall back
    to a scratch folder of its own.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write a pixel-sized intermediate as a Parquet table in the shared folder and read it.

    Unlike a checkpoint it is columnar and compressed, later reads take only the columns they
    need, and the planner knows its size.
    """
    spark = df.sparkSession
    path = shared_table_path(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_table_path(spark: SparkSession, name: str) -> str:
    """A new table location in the shared folder, inside the open ``scratch`` if there is one."""
    folder = _scratch[-1] if _scratch else shared_dir(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables that operators store; it goes when the block ends.

    Results that are needed later must be written before that. Checkpoints are Spark's own: with
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` they go with their last reference.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a stored table or scratch folder of this run from the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkloom-ckpt-"))
    return spark.sparkContext.getCheckpointDir()
