"""Reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Read from `spark.checkpoint.dir`. Only a local-mode session without one gets
    a temporary folder, deleted when its JVM ends; on a cluster that would not be
    shared between executors, so the setting is required there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="preflens-checkpoints-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
        place = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there.

    Lost executors then re-read files instead of re-running the plan, and every
    later reader sees the very same rows in the very same partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
