"""The corpus pipeline: stages that clean, de-duplicate and pack ``documents``.

Each stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents``, and
returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it again as the
next stage's ``docs``. All but the last return the columns of ``documents`` (others are dropped).
Null and empty texts, repeated rows and empty tables are handled as the operators say; a document
whose text was cut away whole stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import packing, quality_rules, simhash, suffix_dedup, toxicity
from inkloom.llm.common import table
from inkloom.plans.spread import remove, scratch, shared_table_path

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that may stand only once: the least that 50 short words take.
PASSAGE = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from ``labels`` does not call toxic."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, *DOCUMENTS).filter("predicted = 0").select(DOCUMENTS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps."""
    return quality_rules.ledger(docs.select(DOCUMENTS)).filter(
        quality_rules.passes()).select(DOCUMENTS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return simhash.one_per_group(docs.select(DOCUMENTS), simhash.WIDE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, or place, has already."""
    cut = suffix_dedup.dedup(docs.select(DOCUMENTS), PASSAGE, keep="first")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(DOCUMENTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the sequence and offset of each."""
    return packing.query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]
#: SQL can express neither the learned model nor the token ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stores for itself goes with it, and its result when
    the next one is written; the last result stays in the shared folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_table_path(spark, "stage")
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
