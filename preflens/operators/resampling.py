"""A Poisson bootstrap of the mean whose resamples are added up as arrays.

Row r counts in replicate b as often as a Poisson(1) number says that is drawn by
mixing the row's hash with b, so draws depend on neither partitions nor order. A
task reads its rows group by group and keeps two arrays for the group at hand, one
place per replicate: summed weights, and summed weights times values. Only these
leave the task, in slices; slices of one group and range are added as they stream
by. No row is multiplied by the number of replicates, anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import hash52
from .skew import deal_out

# Where the distribution of a Poisson(1) number steps up, in 2**32nds, as far as a step is seen.
POISSON_STEPS = [
    round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(11)
]

# The counter's step, and the finaliser of the 32-bit Murmur3 hash by its shifts and the factors between.
# Products stay below 2**64, so any SQL engine can recompute the draws in unsigned 64-bit numbers.
COUNTER_STEP = 0x9E3779B9
MIX_SHIFTS = (16, 13, 16)
MIX_FACTORS = (0x85EBCA6B, 0xC2B2AE35)

# Replicates that are shuffled as one row.
SLICE = 500


def _mix(words: np.ndarray) -> None:
    """Mix 32-bit words in place."""
    for shift, factor in zip(MIX_SHIFTS, MIX_FACTORS):
        words ^= words >> np.uint32(shift)
        words *= np.uint32(factor)
    words ^= words >> np.uint32(MIX_SHIFTS[-1])


def poisson_weights(draw: int, replicates: int) -> np.ndarray:
    """How often a row with this 52-bit hash counts in each replicate.

    The low word of the hash is mixed with the replicate's counter, the result once
    more with the high word.
    """
    words = np.arange(1, replicates + 1, dtype="u4")
    words *= np.uint32(COUNTER_STEP)
    words ^= np.uint32(draw & 0xFFFFFFFF)
    _mix(words)
    words += np.uint32(draw >> 32)
    _mix(words)
    return np.searchsorted(np.array(POISSON_STEPS, "u4"), words, side="right")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def resampled_means(values: DataFrame, by: Sequence[str], value: Column, key: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """by, means (one array per slice of the replicates), and on one slice of each group `n` and `total`.

    A replicate in which no row counts has no mean. Null and NaN values are left out.
    """
    by = list(by)
    number = value.cast("double")
    rows = values.where(number.isNotNull() & ~F.isnan(number))
    # A narrow row costs `replicates` steps, which partition sizes do not show.
    rows = deal_out(rows.select(*by, number.alias("_value"), hash52(seed, *[F.col(k) for k in key]).alias("_draw")))
    rows = rows.sortWithinPartitions(*by, "_draw")
    groups = [rows.schema[name] for name in by]
    part = T.StructType(
        [
            *groups,
            T.StructField("_slice", T.IntegerType()),
            T.StructField("_weights", T.BinaryType()),
            T.StructField("_sums", T.BinaryType()),
            T.StructField("_n", T.LongType()),
            T.StructField("_total", T.DoubleType()),
        ]
    )
    whole = T.StructType([*groups, T.StructField("means", T.ArrayType(T.DoubleType())), *part.fields[-2:]])
    part_arrow, whole_arrow, keys = to_arrow_schema(part), to_arrow_schema(whole), len(by)

    def folded(batches):
        for group, members in groupby(_rows(batches), key=lambda r: r[:keys]):
            weights, sums, n, total = np.zeros(replicates, "i8"), np.zeros(replicates), 0, 0.0
            for row in members:
                drawn = poisson_weights(row[-1], replicates)
                weights += drawn
                sums += drawn * row[-2]
                n, total = n + 1, total + row[-2]
            parts = [
                (*group, i, weights[at : at + SLICE].tobytes(), sums[at : at + SLICE].tobytes(), n * (i == 0), total * (i == 0))
                for i, at in enumerate(range(0, replicates, SLICE))
            ]
            yield _batch(parts, part_arrow)

    def added(batches):
        for group, members in groupby(_rows(batches), key=lambda r: r[: keys + 1]):
            weights, sums, n, total = 0, 0.0, 0, 0.0
            for row in members:
                weights = weights + np.frombuffer(row[-4], "i8")
                sums = sums + np.frombuffer(row[-3], "f8")
                n, total = n + row[-2], total + row[-1]
            drawn = weights > 0
            yield _batch([(*group[:-1], (sums[drawn] / weights[drawn]).tolist(), n, total)], whole_arrow)

    sliced = rows.mapInArrow(folded, part).repartition(*by, "_slice").sortWithinPartitions(*by, "_slice")
    return sliced.mapInArrow(added, whole)


def percentile_bounds(means: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """by, mean, n, ci_lo, ci_hi: percentiles between the two nearest resampled means."""
    ordered = F.array_sort(F.flatten(F.collect_list("means")))
    found = means.groupBy(*by).agg(
        (F.sum("_total") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"), ordered.alias("_means")
    )

    def at(share: float) -> Column:
        place = (F.size("_means") - 1) * F.lit(share)
        below = F.floor(place).cast("int")
        low, high = F.get("_means", below), F.get("_means", F.least(below + 1, F.size("_means") - 1))
        return low + (high - low) * (place - below)

    return found.select(*by, "mean", "n", at(alpha / 2).alias("ci_lo"), at(1 - alpha / 2).alias("ci_hi"))
