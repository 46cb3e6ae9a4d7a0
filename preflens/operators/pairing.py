"""Bringing the two sides of a comparison together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import VERDICTS, parse_verdict, score_verdict, swap_consistent, swap_score

ORDERS = ("ab", "ba")


def pair_policy_baseline(
    policy: DataFrame, baseline: DataFrame, on: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Policy and baseline rows of the same key, each value with a suffix per side.

    An explicit key takes the place of list positions, and rows without a
    partner drop out. A baseline sampled once for all runs simply has no run
    column: leave it out of `on`. Select only the values needed before or here,
    since whole texts would otherwise travel through the shuffle. No broadcast is
    asked for, since the baseline grows with the prompts; a hot key (one prompt
    with a great many rows) is split by adaptive skew-join handling.
    """
    on = list(on)
    kept = [c for c in policy.columns if c not in values and c not in on and c != "model_role"]
    left = policy.select(*on, *kept, *[F.col(v).alias(f"{v}_policy") for v in values])
    right = baseline.select(*on, *[F.col(v).alias(f"{v}_baseline") for v in values])
    return left.join(right, on)


def sides(completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The policy and the baseline rows of a completions table."""
    role = F.col("model_role")
    return completions.where(role == "policy"), completions.where(role == "baseline")


def pairing_coverage(completions: DataFrame, on: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Matched pairs and rows without a partner, per group."""
    is_policy = (F.col("model_role") == "policy").cast("int")
    keys = completions.groupBy(*dict.fromkeys([*group, *on])).agg(
        F.max(is_policy).alias("policy"), F.max(1 - is_policy).alias("baseline")
    )
    return keys.groupBy(*group).agg(
        F.sum(F.col("policy") * F.col("baseline")).alias("matched"),
        F.sum(F.col("policy") * (1 - F.col("baseline"))).alias("policy_only"),
        F.sum(F.col("baseline") * (1 - F.col("policy"))).alias("baseline_only"),
    )


def both_orders(pairs: DataFrame, score: str = "rm_score") -> DataFrame:
    """Each pair judged by score twice: policy shown first, then second."""
    policy, baseline = F.col(f"{score}_policy"), F.col(f"{score}_baseline")
    judged = F.array(
        F.struct(F.lit("ab").alias("ord"), score_verdict(policy, baseline).alias("verdict")),
        F.struct(F.lit("ba").alias("ord"), score_verdict(baseline, policy).alias("verdict")),
    )
    return pairs.select("*", F.inline(judged))


def verdicts_by_order(verdicts: DataFrame, on: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """One row per pair with the verdicts of both orders side by side.

    Verdicts are aggregated as small numbers: a maximum of strings would make
    Spark sort instead of hash.
    """
    code = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col(verdict))
    pick = lambda order: F.max(F.when(F.col("ord") == order, code))
    codes = verdicts.groupBy(*on).agg(*[pick(o).alias(o) for o in ORDERS])
    name = lambda order: F.try_element_at(
        F.array(*[F.lit(v) for v in VERDICTS]), F.col(order).cast("int")
    )
    return codes.select(*on, *[name(o).alias(f"verdict_{o}") for o in ORDERS])


def judged_pairs(raw_verdicts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Raw judge output -> one row per pair, scored if it was judged in both orders.

    A pair with a verdict missing or null in one order keeps a null score.
    """
    parsed = raw_verdicts.select(*on, "ord", parse_verdict(F.col("raw")).alias("verdict"))
    return with_swap_scores(verdicts_by_order(parsed, on))


def scored_pairs(pairs: DataFrame, score: str = "rm_score") -> DataFrame:
    """Both orders of a scoring judge in one go: pure arithmetic on two scores."""
    policy, baseline = F.col(f"{score}_policy"), F.col(f"{score}_baseline")
    return with_swap_scores(
        pairs.withColumn("verdict_ab", score_verdict(policy, baseline)).withColumn(
            "verdict_ba", score_verdict(baseline, policy)
        )
    )


def with_swap_scores(pairs: DataFrame) -> DataFrame:
    verdicts = F.col("verdict_ab"), F.col("verdict_ba")
    return pairs.withColumn("score", swap_score(*verdicts)).withColumn(
        "consistent", swap_consistent(*verdicts)
    )
