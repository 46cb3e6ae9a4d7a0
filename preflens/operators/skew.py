"""Keeping work even when groups differ vastly in size or rows in cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A group is hot if it holds more than this part of all rows, so fewer than a
# thousand groups can be hot, however large the table.
HOT_PART = 1000


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows x lookup on `keys`, where a few keys may hold most of the rows.

    `lookup` has one row per key (or a few, such as one per reward model). Keys
    are counted first, with partial sums before the shuffle. Hot ones, fewer than
    HOT_PART, are joined where their rows lie, by a broadcast of their lookup rows;
    only the others are shuffled. Adaptive skew-join handling would not help a
    lookup that comes out of an aggregation with the join's own partitioning.
    Rows with a null key match nothing. `rows` is read three times: keep it and
    the lookup narrow.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.agg(F.sum("_rows")).scalar()
    hot_keys = F.broadcast(sizes.where(F.col("_rows") * HOT_PART > total).select(*keys))
    hot = F.broadcast(lookup.join(hot_keys, keys))
    in_place = rows.join(hot, keys)
    shuffled = rows.join(hot_keys, keys, "left_anti").join(lookup, keys)
    return in_place.unionByName(shuffled)


def deal_out(rows: DataFrame) -> DataFrame:
    """Deal rows evenly over as many tasks as the session gives a shuffle.

    For rows that are small now but will each become very many or take long.
    The number is given so that adaptive execution, which only sees how small
    they are, does not put them into one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
