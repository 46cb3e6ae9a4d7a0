"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that `saved` returned.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Names of those that `bucketed` returned.
_NAMES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, read from `spark.checkpoint.dir`.

    A local-mode session without that setting (tests) gets a temporary folder.
    On a cluster the setting is required: a machine's own folder is not shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master in ("local",) or context.master.startswith("local["):
            folder = folder or tempfile.mkdtemp(prefix="llm-checkpoints-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """`df` as a table written once; later readers see the same rows and columns they need.

    Lost executors re-read files instead of repeating the plan. The files go when
    the session's JVM ends, or with `freed`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def bucketed(df: DataFrame, key: str, codec: str = "zstd") -> DataFrame:
    """`saved` as a table bucketed by `key`: joins on it move the other side's rows only."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    rows = df.repartition(n, key).write.format("parquet").option("path", path).option("compression", codec)
    rows.bucketBy(n, key).sortBy(key).saveAsTable(name)
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    table = spark.table(name)
    _FOLDERS[table], _NAMES[table] = path, name
    return table


def freed(*tables: DataFrame) -> None:
    """Delete the files of tables that `saved` or `bucketed` returned. What was made from them has to be saved by then."""
    for table in tables:
        if table in _NAMES:
            table.sparkSession.sql(f"drop table {_NAMES.pop(table)}")
        system, target = _file_system(table.sparkSession, _FOLDERS.pop(table))
        system.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for jobs that run inside, so that large rows fit a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
