"""Writers for results, audit rows and the leaderboard."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.report import markdown_head, markdown_rows

JSON_TYPES = (T.NumericType, T.BooleanType, T.StringType, T.ArrayType, T.StructType, T.MapType)


def json_documents(df: DataFrame) -> DataFrame:
    """One indented JSON document per row; types JSON lacks are written as text."""
    fields = [
        F.col(f.name) if isinstance(f.dataType, JSON_TYPES) else F.col(f.name).cast("string").alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(
        F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")
    )


def write_json(df: DataFrame, path: str) -> None:
    """Each row as an indented JSON document (one per run, say)."""
    json_documents(df).write.mode("overwrite").text(path, lineSep="\n")


def write_run_json(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Documents in one folder per run: <path>/run_id=<run>/."""
    documents = df.select(run, F.struct(*[c for c in df.columns if c != run]).alias("_doc"))
    documents.select(
        run, F.to_json("_doc", {"pretty": "true", "ignoreNullFields": "false"}).alias("value")
    ).write.mode("overwrite").partitionBy(run).text(path)


def write_artifacts(documents: DataFrame, runs_dir: str, name: str) -> None:
    """Rows of (run_id, document) as the file `name` in each run's directory, as read_artifact finds it.

    The documents are first written, by all tasks, to a folder of this job beside the
    runs. Only when that job has ended well and has one document per run is each file
    put in place by a rename, so a file is the old one or the new one as a whole. When
    a task fails for good, or a run has two documents, the runs stay as they were. A
    run id that is null, empty or no plain directory name fails the job.
    """
    spark = documents.sparkSession
    run = F.col("run_id").cast("string")
    plain = F.coalesce(run.rlike(r"^[^/]+$") & ~run.isin(".", "..") & ~run.rlike(r"^[._]"), F.lit(False))
    checked = F.when(plain, run).otherwise(F.raise_error(F.concat(F.lit("no run directory: "), F.coalesce(run, F.lit("null")))))
    hadoop = spark._jvm.org.apache.hadoop.fs
    stage = hadoop.Path(f"{runs_dir}/_{name}-{uuid.uuid4().hex}")
    files = stage.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows = documents.select(checked.alias("run_id"), F.coalesce("document", F.lit("null")).alias("value"))
        written = Observation()
        rows = rows.observe(written, F.count(F.lit(1)).alias("documents"))
        rows.write.partitionBy("run_id").text(stage.toString(), lineSep="\n")
        folders = [f.getPath() for f in files.listStatus(stage) if f.isDirectory()]  # one per run
        if written.get["documents"] != len(folders):
            raise ValueError(f"{written.get['documents']} documents for {len(folders)} runs")
        for folder in folders:
            part = files.listStatus(folder)[0].getPath()
            # A run id may hold a colon, which a path made of text would read as a scheme.
            run_folder = hadoop.Path(None, None, unquote(folder.getName().removeprefix("run_id=")))
            place = hadoop.Path(hadoop.Path(runs_dir), run_folder)
            files.mkdirs(place)
            target = hadoop.Path(place, name)
            files.delete(target, False)
            if not files.rename(part, target):
                raise OSError(f"could not put {target.toString()} in place")
    finally:
        files.delete(stage, True)


def write_audit(audit: DataFrame, path: str, partitions: Sequence[str] = ("run_id", "seed")) -> None:
    """Judged pairs as Parquet, one folder per run and seed.

    Rows are written where they are: a shuffle by run would put a big run into
    one task.
    """
    audit.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """The Markdown table as a text file; it has one line per run."""
    spark = board.sparkSession
    head = spark.createDataFrame(list(enumerate(markdown_head())), "place int, line string")
    lines = markdown_rows(board).select(F.lit(len(markdown_head())).alias("place"), "run", "line")
    table = head.select("place", F.lit("").alias("run"), "line").unionByName(lines)
    table.coalesce(1).sortWithinPartitions("place", "run").select("line").write.mode("overwrite").text(path)
