import math

import pytest
from pyspark.sql import functions as F

from preflens.functions.columns import fixed3, hash52
from preflens.functions.verdicts import (
    parse_verdict,
    score_outcome,
    score_verdict,
    swap_consistent,
    swap_score,
)
from preflens.operators import pairing
from tests import plain

NAN, INF = math.nan, math.inf


def test_parse_verdict(spark):
    cases = {
        "A": "A", " b.": "B", "Answer: B": "A", "": "TIE", "TIE": "TIE", "**B**": "B", "both": "B",
        "1) a": "A", "éa": "A", "Tie, a": "TIE", "\n": "TIE",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, verdict string")
    assert df.where(parse_verdict(F.col("raw")) != F.col("verdict")).count() == 0


def test_all_nine_combinations(spark):
    expected = {
        ("A", "B"): (1.0, True), ("B", "A"): (0.0, True), ("TIE", "TIE"): (0.5, True),
        ("A", "A"): (0.5, False), ("B", "B"): (0.5, False), ("A", "TIE"): (0.5, False),
        ("TIE", "A"): (0.5, False), ("B", "TIE"): (0.5, False), ("TIE", "B"): (0.5, False),
    }
    df = spark.createDataFrame(list(expected), "ab string, ba string")
    out = df.select(
        "ab", "ba", swap_score(F.col("ab"), F.col("ba")), swap_consistent(F.col("ab"), F.col("ba"))
    )
    assert {(r[0], r[1]): (r[2], r[3]) for r in out.collect()} == expected


@pytest.mark.parametrize(
    ("a", "b", "verdict", "outcome"),
    [
        (1.0, 0.0, "A", 1.0), (0.0, 1.0, "B", 0.0), (1.0, 1.0, "TIE", 0.5), (1.0, 1.0005, "TIE", 0.0),
        (1.0005, 1.0, "TIE", 1.0), (NAN, 1.0, "B", 0.0), (1.0, NAN, "B", 0.0), (NAN, NAN, "B", 0.0),
        (INF, 1.0, "A", 1.0), (-INF, 1.0, "B", 0.0), (INF, INF, "B", 0.5), (None, 1.0, None, None),
    ],
)
def test_score_verdict_and_outcome(spark, a, b, verdict, outcome):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    columns = F.col("a"), F.col("b")
    assert tuple(df.select(score_verdict(*columns), score_outcome(*columns)).first()) == (verdict, outcome)


def test_orders_come_together_again(spark):
    pairs = spark.createDataFrame(
        [(1, 2.0, 1.0), (2, 1.0, 2.0), (3, 1.0, 1.0), (4, NAN, 1.0)],
        "id int, rm_score_policy double, rm_score_baseline double",
    )
    expanded = pairing.both_orders(pairs).select("id", "ord", "verdict")
    assert expanded.count() == 8
    wide = pairing.with_swap_scores(pairing.verdicts_by_order(expanded, ["id"]))
    rows = {r.id: (r.verdict_ab, r.verdict_ba, r.score, r.consistent) for r in wide.collect()}
    direct = {
        r.id: (r.verdict_ab, r.verdict_ba, r.score, r.consistent)
        for r in pairing.scored_pairs(pairs).collect()
    }
    assert rows == direct
    # A score that is no number loses both orders' first place: the judge contradicts itself.
    assert rows[4] == ("B", "B", 0.5, False)


def test_pairs_judged_once_only_are_left_out(spark):
    raw = spark.createDataFrame(
        [(1, "ab", "A"), (1, "ba", "B"), (2, "ab", "A")], "id int, ord string, raw string"
    )
    out = {r.id: (r.score, r.consistent) for r in pairing.judged_pairs(raw, ["id"]).collect()}
    assert out == {1: (1.0, True), 2: (None, None)}


def test_pairing_drops_and_counts_rows_without_partner(spark):
    completions = spark.createDataFrame(
        [("r", 0, 1, "policy", "p"), ("r", 0, 1, "baseline", "b"), ("r", 0, 2, "policy", "x"),
         ("r", 0, 3, "baseline", "y"), ("r", 0, 4, "baseline", "z")],
        "run_id string, seed int, prompt_id int, model_role string, completion string",
    )
    key = ["run_id", "seed", "prompt_id"]
    pairs = pairing.pair_policy_baseline(*pairing.sides(completions), on=key, values=["completion"])
    assert [tuple(r) for r in pairs.collect()] == [("r", 0, 1, "p", "b")]
    coverage = pairing.pairing_coverage(completions, key, ["run_id", "seed"]).first()
    assert (coverage.matched, coverage.policy_only, coverage.baseline_only) == (1, 1, 2)


def test_one_baseline_serves_all_runs(spark):
    policy = spark.createDataFrame(
        [("r1", 1, "a"), ("r2", 1, "b")], "run_id string, prompt_id int, completion string"
    )
    baseline = spark.createDataFrame([(1, "base")], "prompt_id int, completion string")
    pairs = pairing.pair_policy_baseline(policy, baseline, ["prompt_id"], ["completion"])
    assert {(r.run_id, r.completion_baseline) for r in pairs.collect()} == {("r1", "base"), ("r2", "base")}


def test_fixed3_rounds_like_printf(spark):
    values = [i / 16 for i in range(-40, 40)] + [i / 80 for i in range(200)] + [i / 2000 for i in range(-3000, 3000)]
    values += [0.0005, 0.0015, 0.0025, 2.0005, 1e9 + 0.0625, 1 / 3, 123456.7895, 1e-9, -1e-9, 5e13, 0.9995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [
        (r.v, r.s) for r in df.select("v", fixed3(F.col("v")).alias("s")).collect() if r.s != f"{r.v:.3f}"
    ]
    assert not wrong
    odd = spark.createDataFrame([(NAN,), (None,), (-0.0,), (INF,), (-INF,)], "v double").select(fixed3(F.col("v")).alias("s"))
    assert [r.s for r in odd.collect()] == ["nan", None, "-0.000", "inf", "-inf"]


def test_hash52_is_the_md5_prefix(spark):
    out = spark.range(50).select("id", hash52(17, F.col("id")).alias("h")).collect()
    assert all(r.h == plain.hash52(f"17:{r.id}") for r in out)


def test_a_hot_prompt_is_split_when_pairing(spark):
    """One prompt holds most policy rows; adaptive execution splits its join task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    policy = spark.range(0, 30000, 1, 8).select(
        F.col("id").alias("sample"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("prompt_id"),
        F.lit(1.0).alias("rm_score"),
    )
    baseline = spark.range(30000).select(F.col("id").alias("prompt_id"), F.lit(0.5).alias("rm_score"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        pairs = pairing.pair_policy_baseline(policy, baseline, ["prompt_id"], ["rm_score"])
        assert len(pairs.collect()) == 30000
        assert "skew=true" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
