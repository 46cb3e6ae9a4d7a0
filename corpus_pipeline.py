"""A corpus from raw documents to packed sequences, stage by stage.

Every stage but the last takes and returns the columns of `documents`; the last
returns the packed pieces. `run` writes each stage's result to the shared folder
and reads it back, as a cluster would between jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from preflens.llm import exact_dedup, jaccard_join, packing, quality_rules, suffix_dedup
from preflens.llm.store import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the production policy keeps."""
    return quality_rules.apply_policy(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.drop_near_duplicates(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur elsewhere too."""
    return suffix_dedup.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens with the sources in their proportions."""
    return packing.digest(packing.packed_documents(docs))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near duplicates", near),
    ("repeated strings", repeats),
    ("packing", pack),
]

#: SQL can express neither the suffix stage at this size nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
