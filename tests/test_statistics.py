import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from preflens.functions.columns import exact_mean
from preflens.operators import diagnostics, ranking, resampling, winrate
from preflens.operators.ranking import with_position
from tests import plain


@pytest.fixture(scope="module")
def skewed(spark):
    """One group of 4,000 rows among 40 small ones, with many equal values."""
    return spark.range(6000).select(
        F.when(F.col("id") < 4000, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        "id",
        (F.pmod(F.hash("id"), F.lit(50))).alias("v"),
    )


@pytest.mark.parametrize("partitions", [1, 16])
def test_positions_equal_row_numbers(spark, skewed, partitions):
    got = with_position(skewed.repartition(partitions), ["g"], ["v", "id"], "position", "n")
    window = Window.partitionBy("g").orderBy("v", "id")
    want = skewed.withColumn("want", F.row_number().over(window) - 1).withColumn(
        "size", F.count("*").over(Window.partitionBy("g"))
    )
    joined = got.join(want.select("id", "want", "size"), "id")
    assert joined.count() == 6000
    assert joined.where((F.col("position") != F.col("want")) | (F.col("n") != F.col("size"))).count() == 0


@pytest.mark.parametrize("rows_per_range", [3000, 100, 3])
def test_positions_over_many_ranges(spark, skewed, monkeypatch, rows_per_range):
    """Few, many and the most ranges; equal, null and NaN values; a null group."""
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", rows_per_range)
    value = F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 > 0, F.col("v") * 0.5)
    rows = skewed.select(F.when(F.col("g") != "g7", F.col("g")).alias("g"), "id", value.alias("v")).repartition(9)
    window = Window.partitionBy("g").orderBy("v", "id")
    got = with_position(rows, ["g"], ["v", "id"], "position", "n")
    want = rows.withColumn("want", F.row_number().over(window) - 1).select("id", "want")
    assert got.join(want, "id").where("position = want").count() == 6000
    assert {r.n for r in got.where("g is null").collect()} == {rows.where("g is null").count()}
    ranges = ranking._cut_points(rows, ["g"], ["v", "id"]).where("g = 'big'").select(F.size("_cuts")).first()
    assert ranges[0] == min(1024, -(-4000 // rows_per_range)) - 1


def test_ranges_of_a_big_group_are_even(spark, skewed, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 200)
    cuts = ranking._cut_points(skewed, ["g"], ["v", "id"]).where("g = 'big'")
    ranged = skewed.where("g = 'big'").join(cuts, "g").select(ranking._range_of(F.col("_cuts"), F.struct("v", "id")).alias("r"))
    sizes = [r["count"] for r in ranged.groupBy("r").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 200


def test_building_a_ranking_starts_no_job_and_writes_nothing(spark, skewed):
    rows = skewed.withColumn("s", F.col("v") * 0.5)
    spark.sparkContext.setJobGroup("building", "")
    built = diagnostics.length_reward_corr(rows, ["g"], ["id"], length="v", score="s")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Generate" not in plan


def test_exact_means(spark):
    values = [0.1] * 10 + [0.7, -0.3, 1e12]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", float("nan")), ("b", 1.0), ("c", None), ("d", 1e300)], "g string, v double")
    means = [{r.g: r.m for r in df.repartition(n).groupBy("g").agg(exact_mean(F.col("v")).alias("m")).collect()} for n in (1, 4, 13)]
    assert means[0]["a"] == means[1]["a"] == means[2]["a"] == pytest.approx(sum(values) / 13)
    assert math.isnan(means[0]["b"]) and means[0]["c"] is None and means[0]["d"] == 1e300


def test_spearman_by_ordinal_rank(spark):
    rng = random.Random(1)
    runs = {
        "ties": [(rng.randint(0, 9), rng.randint(0, 5) / 10) for _ in range(200)],
        "constant": [(7, i / 10) for i in range(50)],
        "one": [(3, 1.0)],
        "opposite": [(i, -float(i)) for i in range(30)],
    }
    rows = [(run, i, x, y) for run, pairs in runs.items() for i, (x, y) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "run_id string, prompt_id int, chars int, rm_score double").repartition(7)
    out = diagnostics.length_reward_corr(df, ["run_id"], ["prompt_id"])
    got = {r.run_id: r.length_reward_corr for r in out.collect()}
    for run, pairs in runs.items():
        assert got[run] == pytest.approx(plain.spearman([p[0] for p in pairs], [p[1] for p in pairs]))
    assert got["one"] == 0.0 and got["constant"] == pytest.approx(1.0) and got["opposite"] == pytest.approx(-1)


def scores(spark, wins, ties, losses, group="r"):
    values = [1.0] * wins + [0.5] * ties + [0.0] * losses
    rows = [(group, i, v, v != 0.5) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, prompt_id int, score double, consistent boolean")


def test_summary_counts(spark):
    row = winrate.win_rate_summary(scores(spark, 3, 4, 1), ["run_id"]).first()
    assert (row.win_rate, row.n, row.wins, row.ties, row.losses) == (5 / 8, 8, 3, 4, 1)
    assert row.swap_consistency == 0.5


def exact_bounds(wins, ties, losses, shares=(0.025, 0.975)):
    """Quantiles of the resampled sum by folding the distribution of one draw with itself."""
    n, total = wins + ties + losses, np.array([1.0])
    for _ in range(n):
        total = np.convolve(total, np.array([losses, ties, wins]) / n)
    return [int(np.searchsorted(np.cumsum(total), s - 1e-9)) / (2 * n) for s in shares]


@pytest.mark.parametrize("counts", [(1, 0, 0), (0, 3, 0), (2, 1, 1), (31, 8, 22), (0, 40, 3), (150, 1, 49), (400, 300, 200)])
def test_bounds_from_counts_are_those_of_the_exact_distribution(counts):
    assert winrate.resampled_bounds(*counts) == pytest.approx(exact_bounds(*counts), abs=1e-12)


def test_bounds_from_counts_do_not_cost_more_for_many_pairs():
    started = time.perf_counter()
    lo, hi = winrate.resampled_bounds(5_200_000, 1_300_000, 3_500_000)
    assert time.perf_counter() - started < 2
    mean, spread = 0.585, math.sqrt((0.52 + 0.13 / 4 - 0.585**2) / 1e7)
    assert (lo, hi) == (pytest.approx(mean - 1.959964 * spread, abs=2e-7), pytest.approx(mean + 1.959964 * spread, abs=2e-7))


def test_all_forms_agree_on_an_interval(spark):
    scored = scores(spark, 52, 17, 43)
    summary = winrate.win_rate_summary(scored, ["run_id"])
    lo, hi = exact_bounds(52, 17, 43)
    by_count = winrate.bootstrap_ci_counts(summary).first()
    assert (by_count.ci_lo, by_count.ci_hi, by_count.n) == (pytest.approx(lo), pytest.approx(hi), 112)
    by_draw = winrate.bootstrap_ci(summary, 3000).first()
    by_row = winrate.bootstrap_ci_values(scored, ["run_id"], "score", ["prompt_id"], 3000).first()
    assert by_row.mean == pytest.approx(121 / 224) and by_row.n == 112
    for row in (by_draw, by_row):
        assert row.ci_lo == pytest.approx(lo, abs=0.012) and row.ci_hi == pytest.approx(hi, abs=0.012)


def test_poisson_draws_match_brute_force(spark):
    rng = random.Random(6)
    values = [rng.gauss(3, 2) for _ in range(40)]
    rows = [("r", i, v) for i, v in enumerate(values)] + [("r", 90, math.nan), ("r", 91, None), ("empty", 1, None)]
    df = spark.createDataFrame(rows, "run_id string, k int, v double")
    got = {r.run_id: r for r in winrate.bootstrap_ci_values(df, ["run_id"], "v", ["k"], 30, seed=2).collect()}
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(c + 1)) for c in range(11)]
    word = 2**32

    def mixed(z):
        z = ((z ^ z >> 16) * 0x85EBCA6B) % word
        z = ((z ^ z >> 13) * 0xC2B2AE35) % word
        return z ^ z >> 16

    def uniform(draw, b):
        return mixed((mixed(draw % word ^ b * 0x9E3779B9 % word) + draw // word) % word) / word

    means = []
    for b in range(1, 31):
        weights = [sum(uniform(plain.hash52(f"2:{i}"), b) >= step for step in steps) for i in range(40)]
        means.append(np.dot(weights, values) / sum(weights))
    lo, hi = np.quantile(means, [0.025, 0.975])
    assert set(got) == {"r"} and (got["r"].ci_lo, got["r"].ci_hi, got["r"].n) == (pytest.approx(lo), pytest.approx(hi), 40)


def test_weights_are_poisson_and_independent_between_rows():
    drawn = np.array([resampling.poisson_weights(plain.hash52(f"0:{i}"), 4000) for i in range(200)])
    for count in range(5):
        assert (drawn == count).mean() == pytest.approx(math.exp(-1) / math.factorial(count), abs=2e-3)
    between = np.corrcoef(drawn)
    np.fill_diagonal(between, 0)
    assert np.abs(between).max() < 0.09 and abs(np.corrcoef(drawn[:, :-1].ravel(), drawn[:, 1:].ravel())[0, 1]) < 5e-3


def test_only_slices_of_sums_are_shuffled(spark, monkeypatch):
    """Two tasks, three groups and four slices: 24 rows at most, however many rows and replicates there are."""
    monkeypatch.setattr(resampling, "SLICE", 250)
    df = spark.range(3000).repartition(2).selectExpr("id % 3 as g", "id", "id * 1.0d as v")
    out = winrate.bootstrap_ci_values(df, ["g"], "v", ["id"], 1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    means = resampling.resampled_means(df, ["g"], F.col("v"), ["id"], 1000, 0)
    assert means.count() == 12 and means.selectExpr("sum(_n)", "sum(size(means))").first() == (3000, 3000)
    assert all(abs(r.mean - 1499.5) < 2 and r.ci_lo < r.mean < r.ci_hi and r.n == 1000 for r in out.collect())


def test_many_small_groups_and_null_keys(spark):
    df = spark.range(400).selectExpr("if(id < 5, null, id % 200) as g", "'x' as h", "id", "cast(id as double) as v")
    rows = winrate.bootstrap_ci_values(df, ["g", "h"], "v", ["id"], 20).collect()
    assert len(rows) == 201 and sum(r.n for r in rows) == 400
    one = next(r for r in rows if r.g == 3)
    assert one.n == 1 and one.ci_lo == one.ci_hi == one.mean
    assert winrate.bootstrap_ci_values(df.where("id < 0"), ["g"], "v", ["id"], 20).count() == 0


def test_draws_match_brute_force_across_pieces(spark):
    """A group of more draws than fit one piece, against plain Python."""
    n, losses, ties, replicates = winrate.DRAWS_PER_PIECE + 904, 2000, 1500, 5
    summary = spark.createDataFrame(
        [("r", 0.0, n, n - losses - ties, ties, losses)],
        "run_id string, win_rate double, n bigint, wins bigint, ties bigint, losses bigint",
    )
    row = winrate.bootstrap_ci(summary, replicates).first()
    means = []
    for b in range(replicates):
        places = [plain.hash52(f"0:{b}:{i}") % n for i in range(n)]
        means.append(sum(0.0 if p < losses else 0.5 if p < losses + ties else 1.0 for p in places) / n)
    lo, hi = np.quantile(means, [0.025, 0.975])
    assert (row.ci_lo, row.ci_hi) == (pytest.approx(lo), pytest.approx(hi))


def test_draws_of_all_groups_come_from_the_same_hashes(spark):
    """No row per draw: hashes are made in arrays, a piece at a time, and groups of all sizes share them."""
    counts = [("a", 40, 10, 9), ("a", 40, 10, 9), ("b", 3, 0, 1), ("c", 1, 1, 0), ("d", 0, 0, 0), ("e", None, None, None), (None, 57, 20, 30)]
    summary = spark.createDataFrame(counts, "run_id string, n bigint, losses bigint, ties bigint")
    out = winrate.bootstrap_ci(summary, 230, seed=4)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    got = {r.run_id: r for r in rows}
    assert len(rows) == len(got) == 6 and out.columns == ["run_id", "n", "losses", "ties", "ci_lo", "ci_hi"]
    for run, n, losses, ties in counts:
        want = (None, None)
        if n:
            points = [0.0] * losses + [0.5] * ties + [1.0] * (n - losses - ties)
            means = [sum(points[plain.hash52(f"4:{b}:{i}") % n] for i in range(n)) / n for b in range(230)]
            want = tuple(pytest.approx(v) for v in np.quantile(means, [0.025, 0.975]))
        assert (got[run].ci_lo, got[run].ci_hi) == want


def test_interval_edge_cases(spark):
    assert all(math.isnan(v) for v in winrate.resampled_bounds(0, 0, 0))
    assert winrate.resampled_bounds(5, 0, 0) == (1.0, 1.0) and winrate.resampled_bounds(0, 0, 9) == (0.0, 0.0)
    one = scores(spark, 0, 1, 0)
    summary = winrate.win_rate_summary(one, ["run_id"])
    row = winrate.bootstrap_ci(summary, 50).first()
    assert (row.win_rate, row.n, row.swap_consistency, row.ci_lo, row.ci_hi) == (0.5, 1, 0.0, 0.5, 0.5)
    unscored = one.withColumn("score", F.lit(None).cast("double"))
    row = winrate.bootstrap_ci(winrate.win_rate_summary(unscored, ["run_id"]), 50).first()
    assert (row.win_rate, row.n, row.ci_lo, row.ci_hi) == (None, 0, None, None)
    row = winrate.bootstrap_ci_counts(summary).first()
    assert (row.win_rate, row.ci_lo, row.ci_hi) == (0.5, 0.5, 0.5)
    row = winrate.bootstrap_ci_counts(winrate.win_rate_summary(unscored, ["run_id"])).first()
    assert (row.n, row.n_unjudged, row.ci_lo, row.ci_hi) == (0, 1, None, None)


@pytest.mark.parametrize("partitions", [1, 16])
def test_intervals_do_not_depend_on_partitions(spark, partitions):
    def intervals(scored):
        summary = winrate.win_rate_summary(scored, ["run_id"])
        return [
            tuple(winrate.bootstrap_ci_counts(summary).first()),
            tuple(winrate.bootstrap_ci(summary, 50).first()),
            tuple(winrate.bootstrap_ci_values(scored, ["run_id"], "score", ["prompt_id"], 50).first()),
        ]

    scored = scores(spark, 30, 20, 25)
    for got, want in zip(intervals(scored.repartition(partitions)), intervals(scored)):
        assert got[0] == want[0] and got[1:] == pytest.approx(want[1:], abs=1e-12)


def test_seed_rollups(spark):
    by_seed = spark.createDataFrame(
        [("r", 0, 0.5, 0.4, 0.6, 0.8), ("r", 1, 0.7, 0.55, 0.9, 0.6), ("s", 0, 0.1, 0.0, 0.2, 1.0)],
        "run_id string, seed int, win_rate double, ci_lo double, ci_hi double, swap_consistency double",
    )
    runs = {r.run_id: r for r in winrate.seed_rollup(by_seed).collect()}
    assert runs["r"].win_rate_mean == pytest.approx(0.6)
    assert (runs["r"].seeds, runs["r"].win_rate_min, runs["r"].win_rate_max) == (2, 0.5, 0.7)
    cover = {r.run_id: r for r in winrate.seed_ci_envelope(by_seed).collect()}
    assert (cover["r"].ci_lo, cover["r"].ci_hi) == (0.4, 0.9)
    assert cover["r"].swap_consistency == pytest.approx(0.7)
    nested = {r.run_id: r for r in winrate.results_with_seeds(by_seed).collect()}
    assert [s.seed for s in nested["r"].per_seed] == [0, 1] and nested["r"].per_seed[1].ci95 == [0.55, 0.9]


def test_mean_lengths_cover_all_completions(spark):
    df = spark.createDataFrame(
        [("r", "policy", "xx"), ("r", "policy", "xxxx"), ("r", "baseline", "é中")],
        "run_id string, model_role string, completion string",
    )
    row = winrate.mean_lengths(df, ["run_id"]).first()
    assert (row.mean_len_policy, row.mean_len_baseline) == (3.0, 2.0)
