from pyspark.sql import functions as F

from preflens.operators.lineage import ensure_checkpoint_dir, materialise


def test_checkpoints_go_where_the_session_says(spark):
    folder = ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder and (named is None or named.rstrip("/") in folder)


def test_materialised_rows_start_a_new_plan(spark):
    df = spark.range(1000).withColumn("p", F.spark_partition_id())
    kept = materialise(df)
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 1000 and kept.columns == ["id", "p"]
