"""Reproducible subsamples, splits and packing.

A row's place in a sample is decided by hash52(seed:key) alone, so results do
not depend on partitioning, and a smaller sample is always part of a larger one
drawn with the same seed. `key` has to identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash52
from ..functions.text import MAX_LENGTH, word_tokens
from .ranking import with_position

# The defaults of the loaders. They take all rows unless the caller names a cap.
SEED = 17
EVAL_SHARE = 0.02

# The hash is cut into 2**20 equal buckets to find where a sample ends.
BUCKET_SHIFT = 32


def _sample_order(seed: int, key: str) -> Column:
    return F.struct(hash52(seed, F.col(key)).alias("hash"), F.col(key).alias("key"))


def _last_of_first(df: DataFrame, key: str, seed: int, target: Callable[[Column], Column]) -> Column:
    """Place (hash, key) of the last row of the first target(total) rows in hash order.

    Null where that is beyond the last row. A sort with a limit would move all
    chosen rows into one task. Instead only the key column is read: counts per
    hash bucket show which bucket the limit falls in, and only that bucket's rows
    (a 2**-20 share of the table, the hash being uniform) are put in order.
    """
    places = df.select(_sample_order(seed, key).alias("place"))
    places = places.withColumn("bucket", F.shiftright(F.col("place.hash"), BUCKET_SHIFT))
    # Never more than 2**20 rows, so these two windows fit one task at any scale.
    buckets = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    overall = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = (
        buckets.withColumn("upto", F.sum("rows").over(upto))
        .withColumn("target", target(F.sum("rows").over(overall)))
        .where((F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("rows") < F.col("target")))
        .select((F.col("target") - F.col("upto") + F.col("rows")).alias("rest"), "bucket")
    )
    # `edge` is one row at most.
    in_order = Window.partitionBy("bucket").orderBy("place")
    last = (
        places.join(F.broadcast(edge), "bucket")
        .withColumn("nth", F.row_number().over(in_order))
        .where(F.col("nth") == F.col("rest"))
        .select("place")
    )
    return last.scalar()


def _first_in_hash_order(
    df: DataFrame, key: str, seed: int, target: Callable[[Column], Column]
) -> Column:
    """Whether a row is among the first target(total) ones in hash order."""
    return F.coalesce(
        _sample_order(seed, key) <= _last_of_first(df, key, seed, target), F.lit(True)
    )


def seeded_subsample(df: DataFrame, n: int | None, seed: int, key: str) -> DataFrame:
    """n rows chosen by seed; everything if n is None or not below the row count."""
    if n is None:
        return df
    if n <= 0:
        return df.where(F.lit(False))
    return df.where(_first_in_hash_order(df, key, seed, lambda total: F.lit(n)))


def nested_fraction(
    df: DataFrame, fraction: float, seed: int, key: str, max_samples: int | None = None
) -> DataFrame:
    """max(1, int(rows * fraction)) rows of the seeded subsample.

    The order does not depend on the number of rows taken, so with one seed the
    10 % sample lies in the 50 % sample, and that in the whole.
    """
    if fraction >= 1.0:
        return seeded_subsample(df, max_samples, seed, key)
    return df.where(_first_in_hash_order(df, key, seed, _fraction_of(fraction, max_samples)))


def _fraction_of(fraction: float, max_samples: int | None) -> Callable[[Column], Column]:
    def target(total: Column) -> Column:
        available = total if max_samples is None else F.least(total, F.lit(max_samples))
        return F.greatest(F.lit(1), F.floor(available * F.lit(float(fraction))))

    return target


def nested_share(df: DataFrame, fractions: Sequence[float], seed: int, key: str) -> Column:
    """The number of the first of the rising fractions whose nested sample holds the row; null if none does."""
    share = F.lit(None).cast("int")
    for number, fraction in reversed(list(enumerate(fractions))):
        inside = F.lit(True)
        if fraction < 1.0:
            inside = _first_in_hash_order(df, key, seed, _fraction_of(fraction, None))
        share = F.when(inside, F.lit(number)).otherwise(share)
    return share


def train_eval_split(
    df: DataFrame, seed: int, key: str, eval_share: float = EVAL_SHARE, column: str = "split"
) -> DataFrame:
    """Add a column holding 'eval' for ceil(share * rows) rows, else 'train'."""
    held_out = _first_in_hash_order(
        df, key, seed, lambda total: F.ceil(total * F.lit(float(eval_share)))
    )
    return df.withColumn(column, F.when(held_out, "eval").otherwise("train"))


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns, in the table's order; absent names are ignored."""
    return df.select(*[name for name in df.columns if name in set(columns)])


def instruction_data(
    df: DataFrame, key: str, max_samples: int | None = None, seed: int = SEED
) -> DataFrame:
    """Fine-tuning examples: subsampled, with a small held-out share marked 'eval'."""
    return train_eval_split(seeded_subsample(df, max_samples, seed, key), seed, key)


def preference_data(
    train: DataFrame,
    held_out: DataFrame,
    key: str,
    columns: Sequence[str],
    fraction: float = 1.0,
    max_train_samples: int | None = None,
    max_eval_samples: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Preference pairs to train and evaluate on, in one table with a `split` column.

    `fraction` shrinks the training side to a nested share; the evaluation side
    does not change with it.
    """
    sides = {
        "train": nested_fraction(train, fraction, seed, key, max_train_samples),
        "eval": seeded_subsample(held_out, max_eval_samples, seed, key),
    }
    marked = [
        keep_columns(side, [key, *columns]).withColumn("split", F.lit(name))
        for name, side in sides.items()
    ]
    return marked[0].unionByName(marked[1])


def prompt_source(
    df: DataFrame, key: str, n: int | None = None, seed: int = SEED
) -> DataFrame:
    """Prompts only, subsampled: what a sampling policy is run on."""
    return keep_columns(seeded_subsample(df, n, seed, key), [key, "prompt"])


def eval_prompts(
    df: DataFrame,
    key: str,
    n: int | None = None,
    seed: int = SEED,
    max_eval_samples: int | None = None,
) -> DataFrame:
    """Held-out prompts, drawn with a seed of their own; n of 0 or None means `max_eval_samples`."""
    return keep_columns(seeded_subsample(df, n or max_eval_samples, seed + 1, key), [key, "prompt"])


def sequence_packing(
    df: DataFrame,
    key: str,
    text: str,
    max_length: int = MAX_LENGTH,
    rows_per_shard: int = 1000,
    seed: int = SEED,
) -> DataFrame:
    """Lay short examples end to end in blocks of max_length tokens.

    Examples are dealt into shards by hash. The number of shards grows with the
    table, so a shard stays near `rows_per_shard` rows and is one small sorted
    group; blocks never cross shards. An example starts in `block` and ends in
    `last_block`.
    """
    tokens = df.select(key, F.size(word_tokens(F.col(text))).cast("bigint").alias("n_tokens"))
    shards = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(rows_per_shard)))).scalar()
    before = Window.partitionBy("shard").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    return (
        tokens.withColumn("shard", F.pmod(hash52(seed, F.col(key)), shards))
        .withColumn("start", start)
        .withColumn("block", F.floor(F.col("start") / max_length))
        .withColumn(
            "last_block",
            F.floor((F.col("start") + F.greatest(F.col("n_tokens") - 1, F.lit(0))) / max_length),
        )
    )


def plan_blocks(counts: dict[int, int], max_length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing of pieces into blocks, from the number of pieces of each length alone.

    Rows (length, from_rank, to_rank, first_block, per_block, start): the pieces of
    this length with these ranks go `per_block` to a block, the first at `start`.
    Blocks that are filled alike are one entry, so work and result grow with the
    number of lengths, not of pieces.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of blocks (first, how many)
    n_blocks = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            # The tightest blocks that have room; a piece put there leaves them the tightest for the next.
            room = min((r for r in free if r >= length), default=max_length)
            if room in free:
                first, count = free[room].pop()
                if not free[room]:
                    del free[room]
            else:
                first, count = n_blocks, -(-left // (max_length // length))
                n_blocks += count
            each = room // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            for blocks, at, per_block in ((full, first, each), (1 if rest else 0, first + full, rest)):
                if blocks:
                    taken = blocks * per_block
                    plan.append((length, rank, rank + taken, at, per_block, max_length - room))
                    rank, left = rank + taken, left - taken
                    free.setdefault(room - per_block * length, []).append((at, blocks))
            used = full + (1 if rest else 0)
            if used < count:
                free.setdefault(room, []).append((first + used, count - used))
    return plan


def whole_packing(df: DataFrame, key: str, text: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """key, piece, n_tokens, block, start: examples in blocks of max_length tokens, cut only if longer than that.

    An example above `max_length` is cut into pieces of that length and a last one;
    every other example is one piece. Pieces are packed best-fit-decreasing. What
    reaches the driver is the number of pieces of each length, at most `max_length`
    rows; the plan made of them goes back to all tasks, where a piece's rank among
    those of its length tells its block and place. An example without tokens is a
    piece of length 0 at the start of block 0.
    """
    tokens = df.select(key, F.coalesce(F.size(word_tokens(F.col(text))), F.lit(0)).cast("bigint").alias("_all"))
    last = F.floor(F.greatest(F.col("_all") - 1, F.lit(0)) / max_length)
    pieces = tokens.select(key, "_all", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    size = F.least(F.lit(max_length), F.col("_all") - F.col("piece") * max_length)
    pieces = pieces.select(key, "piece", size.cast("bigint").alias("n_tokens")).repartition(key)
    counts = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    empty = counts.pop(0, 0)
    plan = plan_blocks(counts, max_length)
    plan += [(0, 0, empty, 0, empty, 0)] if empty else []
    columns = "n_tokens long, _from long, _to long, _first long, _each long, _start long"
    planned = F.broadcast(df.sparkSession.createDataFrame(plan, columns))
    ranked = with_position(pieces, ["n_tokens"], [key, "piece"], "_rank")
    found = ranked.join(planned, "n_tokens").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    place = F.col("_rank") - F.col("_from")
    return found.select(
        key,
        "piece",
        "n_tokens",
        (F.col("_first") + F.call_function("div", place, F.col("_each"))).alias("block"),
        (F.col("_start") + place % F.col("_each") * F.col("n_tokens")).alias("start"),
    )
