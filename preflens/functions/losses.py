"""Preference losses, implicit rewards and divergences as column arithmetic.

Formulas are the published ones: Bradley-Terry; DPO (arXiv 2305.18290); IPO
(arXiv 2310.12036); robust DPO (arXiv 2403.00409).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import let

LOSS_TYPES = ("sigmoid", "ipo", "hinge", "robust")


def log_sigmoid(x: Column) -> Column:
    """log(1 / (1 + exp(-x))) without overflow on either side."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def bradley_terry_loss(chosen: Column, rejected: Column) -> Column:
    return -log_sigmoid(chosen - rejected)


def centring_penalty(chosen: Column, rejected: Column) -> Column:
    """Squared sum of both scores: zero when they are centred on zero."""
    return F.pow(chosen + rejected, F.lit(2.0))


def log_ratio_gap(
    policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column
) -> Column:
    """How much more than the reference the policy prefers the chosen answer."""
    return (policy_chosen - ref_chosen) - (policy_rejected - ref_rejected)


def preference_loss(gap: Column, loss_type: str, beta: float, label_smoothing: float = 0.0) -> Column:
    margin = gap * F.lit(float(beta))
    agree, disagree = log_sigmoid(margin), log_sigmoid(-margin)
    eps = float(label_smoothing)
    if loss_type == "sigmoid":
        return -agree * (1.0 - eps) - disagree * eps
    if loss_type == "hinge":
        return F.greatest(F.lit(0.0), F.lit(1.0) - margin)
    if loss_type == "ipo":
        return F.pow(gap - F.lit(1.0 / (2.0 * beta)), F.lit(2.0))
    if loss_type == "robust":
        if eps >= 0.5:
            raise ValueError("the robust loss needs label_smoothing below 0.5")
        return (-agree * (1.0 - eps) + disagree * eps) / (1.0 - 2.0 * eps)
    raise ValueError(f"unknown loss type {loss_type!r}; expected one of {LOSS_TYPES}")


#: What two lists of logits, or parts of them, leave for their divergence: how many there
#: are, the largest of each, and the sums of exp(policy - max), exp(reference - max) and
#: exp(policy - max) * (policy - reference).
SOFTMAX_STATE = T.StructType([T.StructField("size", T.LongType())])
for _sum in ("policy_max", "policy_sum", "reference_max", "reference_sum", "cross"):
    SOFTMAX_STATE.add(_sum, T.DoubleType())


@F.pandas_udf(SOFTMAX_STATE)
def softmax_state(policy: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """The state of one part of a vocabulary, from two arrays; null if one is missing.

    Arrays are read as NumPy vectors. Arrays of different lengths belong to
    different vocabularies and fail the job. A token of probability 0 adds nothing.
    """

    def state(p, q):
        if p is None or q is None:
            return (None,) * 6
        p, q = np.asarray(p, "f8"), np.asarray(q, "f8")
        if len(p) != len(q):
            raise ValueError("token_kl: policy and reference logits differ in length")
        if not len(p):
            return 0, -math.inf, 0.0, -math.inf, 0.0, 0.0
        top_p, top_q = p.max(), q.max()
        with np.errstate(invalid="ignore", over="ignore"):
            chance = np.exp(p - top_p)
            gaps = np.where(chance == 0, 0.0, chance * (p - q))
            return len(p), top_p, chance.sum(), top_q, np.exp(q - top_q).sum(), gaps.sum()

    names = SOFTMAX_STATE.names
    found = pd.DataFrame([state(p, q) for p, q in zip(policy, reference)], columns=names)
    return found.astype({"size": "Int64"} | {n: "Float64" for n in names[1:]})


def merged_states(states: Column) -> Column:
    """One state from an array of the states of a vocabulary's parts, as if it had been one part."""

    def merge(one: Column, other: Column) -> Column:
        tops = {side: F.greatest(one[f"{side}_max"], other[f"{side}_max"]) for side in ("policy", "reference")}

        def scaled(name: str, side: str) -> Column:
            # A part without entries has the maximum -inf and adds 0.
            share = lambda s: F.when(s["size"] == 0, 0.0).otherwise(s[name] * F.exp(s[f"{side}_max"] - tops[side]))
            return share(one) + share(other)

        return F.struct(
            (one["size"] + other["size"]).alias("size"),
            tops["policy"].alias("policy_max"),
            scaled("policy_sum", "policy").alias("policy_sum"),
            tops["reference"].alias("reference_max"),
            scaled("reference_sum", "reference").alias("reference_sum"),
            scaled("cross", "policy").alias("cross"),
        )

    return F.reduce(F.slice(states, F.lit(2), F.size(states)), F.get(states, 0), merge)


def kl_of_state(state: Column) -> Column:
    """KL(policy || reference) from the state of the whole vocabulary; null for an empty one."""
    norm = lambda side: state[f"{side}_max"] + F.log(state[f"{side}_sum"])
    return F.when(state["size"] > 0, state["cross"] / state["policy_sum"] - norm("policy") + norm("reference"))


def token_kl(policy: Column, reference: Column) -> Column:
    """KL(policy || reference) at one position, from two logit arrays that stay in their row."""
    return let(softmax_state(policy, reference), kl_of_state)
