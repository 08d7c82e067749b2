"""The queries of this subpackage, by the names under which the driver knows them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.llm import (
    ann, chat_format, fingerprints, hard_negatives, license_scan, packing, piece_nbest,
    quality_rules, sharding, simhash, spelling, suffix_dedup, toxicity,
)
from inkloom.llm.common import table


def _over(name: str, query: Callable[[DataFrame], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(table(spark, sf_dir, name))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": lambda spark, sf_dir: toxicity.query(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op2_chat_format": _over("conversations", chat_format.query),
        "op3_ann": _over("embeddings", ann.query),
        "op4_piece_nbest": _over("documents", piece_nbest.query),
        "op5_simhash": _over("documents", simhash.query),
        "op6_sharding": _over("documents", sharding.query),
        "op7_packing": _over("documents", packing.query),
        "op8_suffix_dedup": _over("documents", suffix_dedup.query),
        "op9_license_scan": _over("documents", license_scan.query),
        "op10_quality_rules": _over("documents", quality_rules.query),
        "op11_spelling": _over("documents", spelling.query),
        "op12_hard_negatives": _over("embeddings", hard_negatives.query),
        "op13_fingerprints": _over("documents", fingerprints.query),
    }


def sql() -> dict[str, str]:
    return {
        "op10_quality_rules": quality_rules.SQL,
        "op11_spelling": spelling.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
    }
