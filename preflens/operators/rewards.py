"""Rewards, reward-model metrics and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import losses, text
from ..functions.columns import exact_mean, hash52
from .lineage import materialise
from .logistic import Fit, logistic_fits
from .sampling import SEED, nested_fraction, nested_share
from .skew import join_lookup

# Our choices where the formulas leave them open.
ADVANTAGE_EPSILON = 1e-4

# The loss settings compared, and the reward-model data shares.
BETAS = (0.01, 0.05, 0.1, 0.5)
RM_FRACTIONS = (0.1, 0.5, 1.0)


def composite_reward(
    rm_score: Column | None,
    completion: Column,
    length_penalty_weight: float = 0.0,
    target_chars: int = text.TARGET_CHARS,
    repetition_penalty_weight: float = 0.0,
) -> Column:
    """Reward-model score plus shaping terms whose weight is above 0."""
    if rm_score is None:
        raise ValueError("a reward needs a reward-model score: train and apply one first")
    reward = rm_score.cast("double") * 1.0
    if length_penalty_weight > 0:
        reward = reward + text.length_penalty(completion, target_chars) * length_penalty_weight
    if repetition_penalty_weight > 0:
        reward = reward + text.repetition_penalty(completion) * repetition_penalty_weight
    return reward


def group_advantage(
    rollouts: DataFrame,
    group: Sequence[str],
    reward: str = "reward",
    epsilon: float = ADVANTAGE_EPSILON,
) -> DataFrame:
    """Reward standardised within its prompt's group; 0 for a group of one.

    A group is the few samples of one prompt under one run, so a window holds it
    and the rewards are read and shuffled once. Rows with null group keys form
    groups of their own. Pass rewards, not texts.
    """
    own = Window.partitionBy(*group)
    mean, spread = F.avg(reward).over(own), F.stddev_samp(reward).over(own)
    alone = F.count(F.lit(1)).over(own) == 1
    return rollouts.withColumn(
        "advantage", F.when(alone, F.lit(0.0)).otherwise((F.col(reward) - mean) / (spread + epsilon))
    )


def incomplete_groups(rollouts: DataFrame, group: Sequence[str], group_size: Column | int) -> DataFrame:
    """Prompts whose number of samples is not a multiple of the group size."""
    size = group_size if isinstance(group_size, Column) else F.lit(group_size)
    return (
        rollouts.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("samples"), F.max(size).cast("bigint").alias("group_size"))
        .where(F.pmod("samples", "group_size") != 0)
    )


def pair_scores(
    pairs: DataFrame,
    scores: DataFrame,
    run: Sequence[str],
    completion: str,
    key: Sequence[str] = ("pair_id", "split"),
) -> DataFrame:
    """Both scores of each preference pair, from a table of one score per completion.

    One completion may be part of very many pairs. Both sides of the pairs are
    looked up in one join, which keeps hot completions in place, and come
    together again on the pair's own key. A pair with one score keeps a null for
    the other; a pair that a run scored neither side of is not the run's.
    """
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.col(f"{side}_id").alias(completion))
            for side in ("chosen", "rejected")
        ]
    )
    wanted = pairs.select(*key, F.inline(sides))
    scored = join_lookup(wanted, scores.select(*run, completion, "rm_score"), [completion])
    score = lambda side: F.max(F.when(F.col("side") == side, F.col("rm_score")))
    return scored.groupBy(*run, *key).agg(
        score("chosen").alias("score_chosen"), score("rejected").alias("score_rejected")
    )


def rm_pair_accuracy(scored_pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of pairs whose chosen answer scores higher.

    Ties are counted apart. A NaN on either side is no tie and no success. Pairs
    with a score missing are counted in `n_unscored` alone.
    """
    chosen, rejected = F.col("score_chosen"), F.col("score_rejected")
    unscored = chosen.isNull() | rejected.isNull()
    lost = F.isnan(chosen) | F.isnan(rejected)
    decided = (
        F.when(unscored, None)
        .when(lost, F.lit(0.0))
        .when(chosen != rejected, (chosen > rejected).cast("double"))
    )
    return scored_pairs.groupBy(*by).agg(
        F.avg(decided).alias("eval_accuracy"),
        F.count_if(~unscored).alias("n_pairs"),
        F.count_if(~lost & (chosen == rejected)).alias("n_ties"),
        F.count_if(unscored).alias("n_unscored"),
    )


def bt_loss(scored_pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bradley-Terry loss and centring term, before its coefficient."""
    scores = F.col("score_chosen"), F.col("score_rejected")
    return scored_pairs.groupBy(*by).agg(
        exact_mean(losses.bradley_terry_loss(*scores)).alias("loss"),
        exact_mean(losses.centring_penalty(*scores)).alias("centring"),
    )


def _gap() -> Column:
    return losses.log_ratio_gap(
        F.col("pi_chosen"), F.col("pi_rejected"), F.col("ref_chosen"), F.col("ref_rejected")
    )


def dpo_margins(logprobs: DataFrame, beta: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean implicit-reward margin, and the share of pairs ranked right; a NaN margin is not right."""
    margin = _gap() * F.lit(float(beta))
    return logprobs.groupBy(*by).agg(
        F.avg(margin).alias("reward_margin"),
        F.avg((~F.isnan(margin) & (margin > 0)).cast("double")).alias("reward_accuracy"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def preference_losses(
    logprobs: DataFrame,
    betas: Sequence[float] = BETAS,
    label_smoothing: float = 0.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean loss for every loss type and beta.

    All settings are averages of one aggregation over the pairs, so the rows are
    read once and never multiplied; only the finished averages are laid out as rows.
    """
    settings = [(kind, beta) for kind in losses.LOSS_TYPES for beta in betas]
    averages = logprobs.groupBy(*by).agg(
        *[
            F.avg(losses.preference_loss(_gap(), kind, beta, label_smoothing)).alias(f"_{i}")
            for i, (kind, beta) in enumerate(settings)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("loss_type"),
                F.lit(float(beta)).alias("beta"),
                F.col(f"_{i}").alias("loss"),
            )
            for i, (kind, beta) in enumerate(settings)
        ]
    )
    return averages.select(*by, F.inline(rows))


# --- scoring ------------------------------------------------------------------

Scorer = Callable[[Column, Column], Column]


def score_completions(
    completions: DataFrame, scorer: Scorer, prompt: str = "prompt", completion: str = "completion"
) -> DataFrame:
    """One score per completion; comparisons then work on the scores alone."""
    return completions.withColumn(
        "rm_score", scorer(F.col(prompt), F.col(completion)).cast("double")
    )


def model_scorer(load: Callable[[], Any], score: Callable[[Any, pd.Series], Any]) -> Scorer:
    """A scorer around a user's model.

    `load()` runs once per task; `score(model, texts)` gets Arrow batches of
    prompt and response joined the way reward models read them.
    """

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(score(model, texts), dtype="float64")

    return lambda prompt, response: apply(text.scorer_input(prompt, response))


# --- a linear reward model ----------------------------------------------------

WORD_FEATURES = 256


def _features(df: DataFrame, side: str) -> DataFrame:
    """Style and word features of one side of the pairs, as an array column."""
    answer = text.completion_text(df, side)
    words = df.withColumn("_words", text.word_tokens(answer))
    counted = HashingTF(numFeatures=WORD_FEATURES, inputCol="_words", outputCol="_counts").transform(words)
    share = F.transform(
        vector_to_array("_counts"), lambda c: c / F.greatest(F.size("_words"), F.lit(1))
    )
    style = F.array(
        F.log1p(F.length(answer).cast("double")),
        text.length_penalty(answer),
        text.distinct_of_tokens(F.col("_words")),
        text.has_header(answer).cast("double"),
        text.has_bullet(answer).cast("double"),
        text.has_enthusiasm(answer).cast("double"),
    )
    return counted.withColumn(f"_{side}", F.concat(style, share)).drop("_words", "_counts")


STYLE_FEATURES = ("log_chars", "length_penalty", "distinct_4", "has_header", "has_bullet", "has_enthusiasm")


def rm_feature_gaps(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, split, gap: features of the chosen answer less those of the rejected one, style features first."""
    both = _features(_features(pairs, "chosen"), "rejected")
    return both.select(key, "split", F.zip_with("_chosen", "_rejected", lambda a, b: a - b).alias("gap"))


def rm_training_rows(gaps: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, label, features: half of the gaps, picked by hash, negated and labelled 0."""
    flip = hash52("side", F.col(key)) % 2 == 0
    return gaps.select(
        key,
        F.when(flip, 0.0).otherwise(1.0).alias("label"),
        F.transform("gap", lambda v: F.when(flip, -v).otherwise(v)).alias("features"),
    )


def rm_design_sums(
    pairs: DataFrame,
    key: str = "pair_id",
    fractions: Sequence[float] = RM_FRACTIONS,
    seed: int = SEED,
    train_split: str = "train_prefs",
) -> DataFrame:
    """What the fits are made of: per share, pairs, flipped labels and sums of the style features."""
    train = rm_training_rows(rm_feature_gaps(pairs.where(F.col("split") == train_split), key), key)
    style = [F.col("features")[i].alias(name) for i, name in enumerate(STYLE_FEATURES)]
    train = train.select(key, "label", *style)
    rows = [
        nested_fraction(train, fraction, seed, key).agg(
            F.lit(float(fraction)).alias("rm_pair_fraction"),
            F.count(F.lit(1)).alias("n_train_pairs"),
            F.count_if(F.col("label") == 0).alias("n_flipped"),
            *[F.sum(name).alias(name) for name in STYLE_FEATURES],
        )
        for fraction in fractions
    ]
    return reduce(DataFrame.unionByName, rows)


# The penalty on the weights of a linear reward model.
RM_PENALTY = 0.01


def rm_fits(
    gaps: DataFrame,
    key: str = "pair_id",
    fractions: Sequence[float] = RM_FRACTIONS,
    seed: int = SEED,
    width: int = len(STYLE_FEATURES) + WORD_FEATURES,
    max_iter: int = 200,
) -> dict[float, Fit]:
    """Weights of a linear Bradley-Terry scorer for each nested share of the pairs' feature gaps.

    P(chosen beats rejected) = sigmoid(w . (features(chosen) - features(rejected))),
    a logistic regression without intercept. Half of the differences, picked by
    hash, are negated and labelled 0: the loss is the same, and both labels
    occur. All shares are fitted in the same passes over `gaps`, each pass being
    one aggregation, so `gaps` should be stored.
    """
    order = sorted(set(fractions))
    train = rm_training_rows(gaps, key)
    rows = train.select("label", "features", nested_share(train, order, seed, key).alias("share")).where("share is not null")
    # Written, so that a pass neither places the samples anew nor turns the gaps.
    return dict(zip(order, logistic_fits(materialise(rows), order, width, RM_PENALTY, max_iter)))


def rm_style_weights(
    pairs: DataFrame,
    features: Sequence[str] = STYLE_FEATURES,
    key: str = "pair_id",
    fractions: Sequence[float] = RM_FRACTIONS,
    seed: int = SEED,
    train_split: str = "train_prefs",
    max_iter: int = 200,
) -> DataFrame:
    """rm_pair_fraction, n_train_pairs, feature, weight: what style alone tells about the chosen answer."""
    gaps = rm_feature_gaps(pairs.where(F.col("split") == train_split), key)
    style = F.array(*[F.col("gap")[STYLE_FEATURES.index(name)] for name in features])
    fits = rm_fits(materialise(gaps.select(key, style.alias("gap"))), key, fractions, seed, len(features), max_iter)
    rows = [
        (float(fraction), fit.n, name, float(weight))
        for fraction, fit in fits.items()
        for name, weight in zip(features, fit.weights)
    ]
    return pairs.sparkSession.createDataFrame(
        rows, "rm_pair_fraction double, n_train_pairs bigint, feature string, weight double"
    )


def rm_linear_fit(
    pairs: DataFrame,
    key: str = "pair_id",
    fractions: Sequence[float] = RM_FRACTIONS,
    seed: int = SEED,
    train_split: str = "train_prefs",
    eval_split: str = "test_prefs",
    max_iter: int = 200,
) -> DataFrame:
    """How well linear scorers fitted on nested shares of the training pairs rank the held-out pairs.

    See `rm_fits`. Features are computed once and written out. One row per share;
    `converged` tells whether the fit ended before `max_iter` passes.
    """
    gaps = materialise(rm_feature_gaps(pairs, key))
    held_out = gaps.where(F.col("split") == eval_split)
    fits = rm_fits(gaps.where(F.col("split") == train_split), key, fractions, seed, max_iter=max_iter)

    def margin(fit: Fit) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in fit.weights])
        return F.aggregate(F.zip_with("gap", weights, lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)

    rows = []
    for fraction in fractions:
        fit = fits[fraction]
        scored = held_out.select(margin(fit).alias("score_chosen"), F.lit(0.0).alias("score_rejected"))
        rows.append(
            rm_pair_accuracy(scored, []).select(
                F.lit(float(fraction)).alias("rm_pair_fraction"),
                F.lit(fit.n).cast("bigint").alias("n_train_pairs"),
                F.col("n_pairs").alias("n_eval_pairs"),
                "n_ties",
                "eval_accuracy",
                F.lit(fit.steps).alias("iterations"),
                F.lit(fit.converged).alias("converged"),
            )
        )
    return reduce(DataFrame.unionByName, rows)
