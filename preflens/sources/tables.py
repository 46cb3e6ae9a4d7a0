"""Schemas of the input tables and the reader of one named split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

PREFERENCE_COLUMNS = ("prompt", "chosen", "rejected")

PREFERENCE_PAIRS = T.StructType(
    [
        T.StructField("pair_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", MESSAGES),
        T.StructField("rejected", MESSAGES),
        T.StructField("split", T.StringType()),
    ]
)

COMPLETIONS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("prompt_id", T.LongType()),
        T.StructField("model_role", T.StringType()),
        T.StructField("completion", T.StringType()),
    ]
)

VERDICTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("prompt_id", T.LongType()),
        T.StructField("ord", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)


def select_split(df: DataFrame, split: str) -> DataFrame:
    """One named subset; on a table partitioned by `split` only its files are read."""
    return df.where(F.col("split") == split)


def read_split(
    spark: SparkSession,
    path: str,
    split: str,
    schema: T.StructType = PREFERENCE_PAIRS,
    fmt: str = "parquet",
) -> DataFrame:
    """One named split of a Parquet or JSON-lines table with a declared schema.

    Malformed JSON fails the job instead of turning into nulls.
    """
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return select_split(reader.format(fmt).load(path), split)
