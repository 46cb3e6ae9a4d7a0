"""Exact duplicates by skew-safe combining, native expressions only.

Texts are equal when identical without the characters of `[\\x20\\x09-\\x0D]`.
Rows are first combined inside each task, then per (digest, salt, content), and
the winners of a hot digest's salts once more per (digest, content). The content
itself is part of every grouping key, so two texts with one digest never merge.

Defined cases: a null text counts as empty, so null, empty and blank texts form
one group. Of equal texts the row with the most code points stays, then the
smallest doc_id; a null doc_id counts as the largest. Of rows that agree in
doc_id and text exactly one stays. An empty table gives an empty result. Other
columns of the input are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .store import saved

BLANKS = " \t\n\x0b\f\r"
#: A digest is hot above total / HOT rows, so there are fewer than HOT hot digests to broadcast.
HOT = 1000
SALTS = 16
_LAST = 2**63 - 1


def normalised(text: Column) -> Column:
    kept = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        kept = F.replace(kept, F.lit(blank), F.lit(""))
    return kept


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(n_points: Column, doc_id: Column) -> Column:
    """A number that is larger for more code points, then for the smaller doc_id."""
    high = n_points.cast("decimal(18,0)") * F.lit(str(2**64)).cast("decimal(20,0)")
    return (high - F.coalesce(doc_id, F.lit(_LAST)).cast("decimal(20,0)")).cast("decimal(38,0)")


def _rows(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    raw = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        docs[key].cast("bigint").alias("doc_id"), normalised(docs[text]).alias("content"), F.length(raw).alias("points")
    ).select(
        "doc_id",
        "content",
        digest(F.col("content")).alias("digest"),
        _rank(F.col("points"), F.col("doc_id")).alias("rank"),
    )


def _combine(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("size").alias("size"), F.max("rank").alias("rank"), F.max_by("keep_id", "rank").alias("keep_id")
    )


def duplicate_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    hot: int = HOT,
    salts: int = SALTS,
) -> tuple[DataFrame, DataFrame]:
    """The narrow row table and one row per distinct content.

    Rows: row_id, doc_id, digest, rank, heavy. Classes: digest, size, rank,
    keep_id, heavy, n_contents (contents with this digest, 1 unless digests collide).
    """
    rows = saved(
        _rows(docs, key, text, digest)
        .drop("content")
        .withColumn("row_id", F.monotonically_increasing_id())
    )
    floor = rows.count() // hot + 1
    heavy = F.broadcast(rows.groupBy("digest").count().where(F.col("count") > floor).select("digest", F.lit(True).alias("heavy")))
    salted = (
        _rows(docs, key, text, digest)
        .join(heavy, "digest", "left")
        .withColumn("heavy", F.coalesce("heavy", F.lit(False)))
        .withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)))
        .withColumns({"size": F.lit(1).cast("bigint"), "keep_id": F.col("doc_id")})
    )
    by_salt = _combine(salted, "heavy", "digest", "salt", "content")
    whole = by_salt.where(~F.col("heavy")).select("heavy", "digest", "content", "size", "rank", "keep_id")
    merged = _combine(by_salt.where("heavy"), "heavy", "digest", "content")
    found = whole.unionByName(merged).drop("content")
    per_digest = saved(found)
    collisions = per_digest.groupBy("digest").agg(F.count("*").alias("n_contents")).where("n_contents > 1")
    classes = per_digest.join(collisions, "digest", "left").fillna(1, ["n_contents"])
    return rows.join(heavy, "digest", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))), classes


def _on_digest(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their class: hot digests by a broadcast of fewer than HOT classes, the rest by a plain join."""
    facts = classes.select(
        "digest", F.col("rank").alias("best"), F.col("size").alias("group_size"), "keep_id", "first_row", "heavy"
    )
    plain = rows.where(~F.col("heavy")).drop("heavy").join(facts.where(~F.col("heavy")).drop("heavy"), "digest")
    hot = rows.where("heavy").drop("heavy").join(F.broadcast(facts.where("heavy").drop("heavy")), "digest")
    return plain.unionByName(hot)


def exact_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    hot: int = HOT,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, rank."""
    rows, classes = duplicate_classes(docs, key, text, digest, hot, salts)
    alone = classes.where("n_contents = 1")
    winners = rows.join(alone.select("digest", F.col("rank")), ["digest", "rank"]).groupBy("digest").agg(
        F.min("row_id").alias("first_row")
    )
    labelled = _on_digest(rows, alone.join(winners, "digest")).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("first_row")).alias("kept"), "digest", "rank"
    )
    collided = classes.where("n_contents > 1")
    if collided.isEmpty():
        return labelled
    # Contents that share a digest: the rows of these digests are told apart by their content.
    whole = _rows(docs, key, text, digest).join(collided.select("digest").distinct(), "digest", "left_semi")
    numbered = saved(whole.withColumn("row_id", F.monotonically_increasing_id()))
    facts = numbered.groupBy("digest", "content").agg(
        F.count("*").alias("group_size"),
        F.max("rank").alias("best"),
        F.max_by("doc_id", "rank").alias("keep_id"),
        F.max_by("row_id", F.struct("rank", -F.col("row_id"))).alias("first_row"),
    )
    split = numbered.join(facts, ["digest", "content"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("first_row")).alias("kept"), "digest", "rank"
    )
    return labelled.unionByName(split)


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all its columns unchanged."""
    columns = docs.columns
    stays = exact_duplicates(docs, key, text).where("kept").select(
        F.col("digest").alias("__digest"), F.col("rank").alias("__rank")
    )
    points = F.length(F.coalesce(docs[text], F.lit("")))
    marked = docs.withColumns(
        {"__digest": sha256_hex(normalised(docs[text])), "__rank": _rank(points, docs[key].cast("bigint"))}
    )
    # Rows that agree in doc_id and text share digest and rank; one of them stays.
    return (
        marked.join(stays, ["__digest", "__rank"], "left_semi")
        .dropDuplicates(["__digest", "__rank"])
        .select(*[F.col(f"`{c}`") for c in columns])
    )


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n
  from documents),
g as (
  select n, count(*) as group_size, arg_max(doc_id, cast(length(t) as hugeint) * 18446744073709551616 - doc_id) as keep_id
  from d group by n)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.n) as text_sha256
from d join g on d.n = g.n
"""


@query("op5_exact_dedup", SQL)
def op5_exact_dedup(spark, sf_dir):
    """Every document with the document that stays for it."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("rank").withColumnRenamed(
        "digest", "text_sha256"
    )
