"""Positions inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HASH_SPACE, hash52

# A group is cut into ranges of about so many rows, each sorted in one task, but into no more than 2**10 ranges.
ROWS_PER_RANGE = 100_000
FINE = 32
MOST_RANGES = FINE * FINE
SAMPLE_PER_RANGE = 16


def _lookup(rows: DataFrame, values: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of `values`, which has one row per key; null keys equal each other."""
    renamed = values.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in values.columns if c not in keys]
    )
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(renamed, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def _cut_points(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """group, _cuts: ascending (order) values that part a group into ranges of similar size; none for a small group.

    They are picked from a sample that the hash of group and order columns chooses,
    sorted as a whole, so they are a pure function of the rows: each reader of the
    plan finds the same ones, also after an executor is lost. The sample of a group
    has about SAMPLE_PER_RANGE rows per range, whatever the size of the group.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ranges = F.least(F.lit(MOST_RANGES), F.ceil(F.col("_n") / ROWS_PER_RANGE))
    sizes = sizes.select(*group, "_n", ranges.cast("int").alias("_ranges")).where("_ranges > 1")
    share = F.col("_ranges") * SAMPLE_PER_RANGE / F.col("_n")
    sampled = _lookup(rows.select(*group, *order), sizes, group)
    sampled = sampled.where(hash52("cut", *[F.col(c) for c in (*group, *order)]) < share * HASH_SPACE)
    ordered = F.array_sort(F.collect_list(F.struct(*order)))
    found = sampled.groupBy(*group).agg(ordered.alias("_sample"), F.max("_ranges").alias("_ranges"))
    place = lambda i: F.floor(i * F.size("_sample") / F.col("_ranges")).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), F.col("_ranges") - 1), lambda i: F.get("_sample", place(i)))
    return found.select(*group, cuts.alias("_cuts"))


def _range_of(cuts: Column, row: Column) -> Column:
    """How many cut points are not above the row: first among every FINE-th, then among the FINE from there on."""
    upto = lambda points: F.size(F.filter(points, lambda c: c <= row))
    coarse = upto(F.filter(cuts, lambda c, i: i % FINE == FINE - 1))
    found = F.transform(F.array(coarse), lambda k: k * FINE + upto(F.slice(cuts, k * FINE + 1, FINE)))[0]
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    position: str,
    size: str | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group, and the group's size.

    Same numbers as `row_number() - 1 over (partition by group order by order)`,
    but that window sorts a whole group in one task, and one run may hold a third
    of all rows. Here a group is cut into ranges of its order; a row's place in its
    range plus the rows of the ranges before it is its position. `order` has to be
    unique within a group, which also keeps the ranges even when a value repeats.

    One lazy plan: no job runs here and nothing is written. It reads group and order
    columns three times, from `base` if given (the same rows, cheaper to compute),
    and `df` once; narrow rows that come out of a shuffle are read again from there.
    """
    group, order = list(group), list(order)
    narrow = (df if base is None else base).select(*group, *order)
    cuts = _cut_points(narrow, group, order)

    def ranged(rows: DataFrame) -> DataFrame:
        found = _lookup(rows, cuts, group, "left")
        return found.withColumn("_range", _range_of(F.col("_cuts"), F.struct(*order))).drop("_cuts")

    # One row per group and range, at most MOST_RANGES of a group.
    spans = ranged(narrow).groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*group, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")]
    if size is not None:
        columns.append(F.sum("_rows").over(Window.partitionBy(*group)).alias(size))
    place = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    placed = _lookup(ranged(df).withColumn("_place", place), spans.select(*columns), [*group, "_range"])
    return placed.withColumn(position, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")
