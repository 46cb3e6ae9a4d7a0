import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from preflens.operators import sampling
from tests import plain


def first(ids, n, seed):
    return sorted(sorted(ids, key=lambda i: (plain.hash52(f"{seed}:{i}"), i))[:n])


def ids_of(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("n", [1, 2, 37, 499, 500])
def test_subsample_takes_the_first_in_hash_order(spark, n):
    df = spark.range(500)
    assert ids_of(sampling.seeded_subsample(df, n, 17, "id")) == first(range(500), n, 17)


def test_subsample_limits(spark):
    df = spark.range(20)
    assert sampling.seeded_subsample(df, None, 1, "id").count() == 20
    assert sampling.seeded_subsample(df, 0, 1, "id").count() == 0
    assert sampling.seeded_subsample(df, 20, 1, "id").count() == 20
    assert sampling.seeded_subsample(df, 10**9, 1, "id").count() == 20
    assert sampling.seeded_subsample(df.where("id < 0"), 5, 1, "id").count() == 0


@pytest.mark.parametrize("partitions", [1, 16])
def test_samples_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).repartition(partitions)
    assert ids_of(sampling.seeded_subsample(df, 100, 3, "id")) == first(range(1000), 100, 3)
    held_out = sampling.train_eval_split(df, 3, "id").where(F.col("split") == "eval")
    assert ids_of(held_out) == first(range(1000), 20, 3)


def test_fractions_are_nested(spark):
    df = spark.range(333)
    tenth, half, whole = [ids_of(sampling.nested_fraction(df, f, 17, "id")) for f in (0.1, 0.5, 1.0)]
    assert (len(tenth), len(half), len(whole)) == (33, 166, 333)
    assert set(tenth) < set(half) < set(whole)
    assert half == first(range(333), 166, 17)


def test_fraction_of_a_capped_sample(spark):
    df = spark.range(333)
    assert ids_of(sampling.nested_fraction(df, 0.5, 17, "id", 100)) == first(range(333), 50, 17)
    assert ids_of(sampling.nested_fraction(df, 1.0, 17, "id", 100)) == first(range(333), 100, 17)
    assert sampling.nested_fraction(spark.range(3), 0.1, 17, "id").count() == 1


@pytest.mark.parametrize("rows", [1, 49, 50, 51])
def test_split_rounds_up(spark, rows):
    split = sampling.train_eval_split(spark.range(rows), 5, "id")
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts["eval"] == math.ceil(0.02 * rows) and sum(counts.values()) == rows


def test_string_keys(spark):
    df = spark.range(200).select(F.concat(F.lit("k"), "id").alias("id"))
    assert ids_of(sampling.seeded_subsample(df, 50, 17, "id")) == first([f"k{i}" for i in range(200)], 50, 17)


def test_prompt_loaders(spark):
    df = spark.range(100).select(F.col("id"), F.lit("q").alias("prompt"), F.lit(1).alias("other"))
    source = sampling.prompt_source(df, "id", 10, 17)
    assert source.columns == ["id", "prompt"] and ids_of(source) == first(range(100), 10, 17)
    evaluated = sampling.eval_prompts(df, "id", n=0, seed=17, max_eval_samples=10)
    assert ids_of(evaluated) == first(range(100), 10, 18)
    assert sampling.eval_prompts(df, "id", n=3, seed=17, max_eval_samples=10).count() == 3


def test_loaders_combine_the_steps(spark):
    train, held_out = spark.range(100).withColumn("x", F.lit(1)), spark.range(1000, 1040)
    data = sampling.preference_data(train, held_out, "id", [], 0.5, 60, 10, seed=17)
    assert data.columns == ["id", "split"]
    assert ids_of(data.where("split = 'train'")) == first(range(100), 30, 17)
    assert ids_of(data.where("split = 'eval'")) == first(range(1000, 1040), 10, 17)
    examples = sampling.instruction_data(train, "id", 60, 17)
    assert ids_of(examples) == first(range(100), 60, 17)
    assert ids_of(examples.where("split = 'eval'")) == first(range(100), 2, 17)


def test_keep_columns_ignores_absent_names(spark):
    df = spark.range(1).selectExpr("id as b", "id as a", "id as c")
    assert sampling.keep_columns(df, ["a", "b", "zzz"]).columns == ["b", "a"]


def test_packing_lays_examples_end_to_end(spark):
    texts = [(i, "w " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(texts, "id bigint, text string").repartition(5)
    packed = sampling.sequence_packing(df, "id", "text", max_length=10, rows_per_shard=100).collect()
    assert len(packed) == 300 and {r.shard for r in packed} == {0, 1, 2}
    for shard in range(3):
        start = 0
        for row in sorted((r for r in packed if r.shard == shard), key=lambda r: r.id):
            assert row.shard == plain.hash52(f"17:{row.id}") % 3
            assert row.n_tokens == row.id % 7 and row.start == start and row.block == start // 10
            assert row.last_block == (start + max(row.n_tokens - 1, 0)) // 10
            start += row.n_tokens


def best_fit_decreasing(lengths, room):
    """Piece by piece: how many blocks, and how full each is."""
    blocks = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, used in enumerate(blocks) if used + n <= room]
        if fits:
            blocks[max(fits, key=lambda i: blocks[i])] += n
        else:
            blocks.append(n)
    return sorted(blocks)


def test_block_plan_equals_best_fit_decreasing():
    rng = random.Random(5)
    for room in (10, 37, 100):
        for _ in range(60):
            lengths = [rng.randint(1, room if rng.random() < 0.5 else room // 3) for _ in range(rng.randrange(1, 200))]
            counts = collections.Counter(lengths)
            fill, taken = collections.defaultdict(list), collections.Counter()
            for length, low, high, first, each, start in sampling.plan_blocks(dict(counts), room):
                assert low == taken[length] and start + each * length <= room
                taken[length] = high
                for rank in range(high - low):
                    fill[first + rank // each].append((start + rank % each * length, length))
            assert taken == counts
            for pieces in fill.values():
                places = sorted(pieces)
                assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
            assert sorted(sum(n for _, n in p) for p in fill.values()) == best_fit_decreasing(lengths, room)


def test_block_plan_does_not_grow_with_the_pieces():
    plan = sampling.plan_blocks({n: 10**9 + n for n in range(1, 1537)}, 1536)
    assert len(plan) < 6 * 1536


def test_whole_packing_cuts_long_examples_only(spark):
    texts = [(i, "w " * (i % 23)) for i in range(200)] + [(500, None), (501, "w " * 47)]
    df = spark.createDataFrame(texts, "id bigint, text string").repartition(3)
    rows = sampling.whole_packing(df, "id", "text", max_length=15).collect()
    by_id = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        by_id[r.id].append(r.n_tokens)
    assert by_id[500] == [0] and by_id[501] == [15, 15, 15, 2] and by_id[22] == [15, 7]
    assert all(by_id[i] == [i % 23] for i in range(200) if i % 23 <= 15)
    blocks = collections.defaultdict(list)
    for r in rows:
        if r.n_tokens:
            blocks[r.block] += range(r.start, r.start + r.n_tokens)
    assert all(len(b) == len(set(b)) and max(b) < 15 for b in blocks.values())
    pieces = [r.n_tokens for r in rows if r.n_tokens]
    assert sorted(map(len, blocks.values())) == best_fit_decreasing(pieces, 15)
    assert sampling.whole_packing(df.where("id < 0"), "id", "text").count() == 0
