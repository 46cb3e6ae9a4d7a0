"""Verdicts and the score they give to a pair of completions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three verdicts and the width of a score tie.
VERDICTS = FIRST, SECOND, TIE = "A", "B", "TIE"
SCORE_TIE = 1e-3


def parse_verdict(raw: Column) -> Column:
    """Judge output -> 'A', 'B' or 'TIE', by its first ASCII letter."""
    letter = F.substring(F.regexp_replace(F.upper(raw), "[^A-Za-z]", ""), 1, 1)
    return (
        F.when(raw.isNull(), None)
        .when(letter.isin(FIRST, SECOND), letter)
        .otherwise(F.lit(TIE))
    )


def score_verdict(score_a: Column, score_b: Column, tie: float = SCORE_TIE) -> Column:
    """Verdict of a scoring judge.

    Scores that cannot be compared (NaN, or the same infinity twice) read 'B':
    neither "close enough" nor "A is higher" holds for them.
    """
    gap = score_a - score_b
    return (
        F.when(gap.isNull(), None)
        .when(F.isnan(gap), F.lit(SECOND))
        .when(F.abs(gap) < tie, F.lit(TIE))
        .when(gap > 0, F.lit(FIRST))
        .otherwise(F.lit(SECOND))
    )


def swap_consistent(verdict_ab: Column, verdict_ba: Column) -> Column:
    """Whether the judge kept its opinion when the two answers changed places.

    In the second order the policy is answer B, so agreement means different
    letters, or a tie both times. Null if a verdict is missing.
    """
    both_tie = (verdict_ab == TIE) & (verdict_ba == TIE)
    same_winner = (verdict_ab != TIE) & (verdict_ba != TIE) & (verdict_ab != verdict_ba)
    return F.when(verdict_ab.isNotNull() & verdict_ba.isNotNull(), both_tie | same_winner)


def swap_score(verdict_ab: Column, verdict_ba: Column) -> Column:
    """1.0 won in both orders, 0.0 lost in both, 0.5 for anything else."""
    return (
        F.when(verdict_ab.isNull() | verdict_ba.isNull(), None)
        .when((verdict_ab == FIRST) & (verdict_ba == SECOND), F.lit(1.0))
        .when((verdict_ab == SECOND) & (verdict_ba == FIRST), F.lit(0.0))
        .otherwise(F.lit(0.5))
    )


def score_outcome(policy: Column, reference: Column) -> Column:
    """Exact comparison of two scores: 1.0 higher, 0.5 equal, 0.0 lower or NaN."""
    return (
        F.when(policy.isNull() | reference.isNull(), None)
        .when(F.isnan(policy) | F.isnan(reference), F.lit(0.0))
        .when(policy > reference, F.lit(1.0))
        .when(policy == reference, F.lit(0.5))
        .otherwise(F.lit(0.0))
    )
