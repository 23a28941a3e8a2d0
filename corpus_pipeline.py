"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

``STAGES`` are applied in order; each gets what its predecessor kept, with the columns of
documents, and all but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import op3_packing, op4_lsh_forest, op7_suffix_dedup, op8_pseudonyms, op9_quality_rules
from sparkloom.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger rejects go."""
    bits = op9_quality_rules.rule_bits(F.coalesce(F.col("text").cast("string"), F.lit("")))
    mask = op9_quality_rules.POLICIES[op9_quality_rules.CURRENT]
    return docs.where(bits.bitwiseAND(F.lit(mask)) == 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return op4_lsh_forest.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that stand earlier as well are cut out."""
    return op7_suffix_dedup.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become format-preserving pseudonyms."""
    return op8_pseudonyms.pseudonymised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the last stage."""
    return op3_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
