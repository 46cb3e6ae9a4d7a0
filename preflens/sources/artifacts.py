"""Run directories: a resolved config plus whichever artifacts a run has written."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.verdicts import swap_consistent
from ..operators.diagnostics import STYLE_RATES, goodhart_gap, hacking_flags
from ..operators.report import ablation_grid, leaderboard, overoptimisation_curve
from ..operators.winrate import results_with_seeds

CONFIG = "stage string, method struct<beta: double, num_generations: bigint, reward_model_path: string>, data struct<rm_pair_fraction: double>, train struct<output_dir: string>"
RM_EVAL = "eval_accuracy double, rm_pair_fraction double, n_train_pairs bigint"
RECORDS = (
    "array<struct<prompt: string, verdict_ab: string, verdict_ba: string, score: double, "
    "len_policy: bigint, len_baseline: bigint>>"
)
PER_SEED = (
    "seed: bigint, win_rate: double, ci95: array<double>, n: bigint, wins: bigint, ties: bigint, losses: bigint, "
    "swap_consistency: double, mean_len_policy: double, mean_len_baseline: double"
)
RESULTS = (
    "policy string, baseline string, judge string, judge_model string, n_prompts bigint, seeds array<bigint>, "
    f"win_rate_mean double, win_rate_min double, win_rate_max double, per_seed array<struct<{PER_SEED}>>"
)
JUDGED = f"per_seed array<struct<seed: bigint, records: {RECORDS}>>"
TRAIN_LOG = "log_history array<map<string, string>>"
STYLE = "struct<header_rate: double, bullet_rate: double, enthusiasm_rate: double, mean_chars: double>"
DIAGNOSTICS = (
    "policy string, reference string, reward_model string, n_prompts bigint, mean_rm_score_policy double, "
    "mean_rm_score_reference double, rm_judged_win_rate double, length_reward_corr double, "
    "distinct_4_policy double, distinct_4_reference double, "
    f"style_policy {STYLE}, style_reference {STYLE}, kl_from_reference double"
)
DPO_EVAL = "beta double, loss_type string, eval_loss double, `eval_rewards/accuracies` double, `eval_rewards/margins` double"


def _literal(name: str) -> str:
    """A directory name as a path pattern that matches it alone."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def read_artifact(
    spark: SparkSession, runs_dir: str, name: str, schema: str | T.StructType, runs: Sequence[str] | None = None
) -> DataFrame:
    """One row per run directory that holds the file, with the directory as run_id.

    The files are found by name, so a kind no run has written gives no rows.
    Fields outside the schema (such as long lists of records) are not parsed.
    With `runs` only these directories are listed and read; each has to exist.
    """
    if runs is not None and not runs:
        return read_artifact(spark, runs_dir, name, schema).where(F.lit(False))
    roots = runs_dir if runs is None else [f"{runs_dir.rstrip('/')}/{_literal(run)}" for run in runs]
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # Directly below a run directory, not in a folder inside one.
    place = rf"\Q{runs_dir.rstrip('/')}\E/([^/]+)/\Q{name}\E$"
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(roots)
        .withColumn("run_id", F.regexp_extract(path, place, 1))
        .where(F.col("run_id") != "")
    )


def read_runs(spark: SparkSession, runs_dir: str) -> DataFrame:
    """The run registry: directories without a resolved config are skipped."""
    return read_artifact(spark, runs_dir, "config.resolved.json", CONFIG).select(
        "run_id",
        F.coalesce("stage", F.lit("")).alias("stage"),
        "method.beta",
        "method.num_generations",
        "method.reward_model_path",
        "data.rm_pair_fraction",
        "train.output_dir",
    )


def read_rm_eval(spark: SparkSession, runs_dir: str) -> DataFrame:
    return read_artifact(spark, runs_dir, "rm_eval.json", RM_EVAL)


def read_results(spark: SparkSession, runs_dir: str) -> DataFrame:
    """One row per run: its win-rates, and the interval and consistency over its seeds."""
    bound = lambda i: F.transform("per_seed", lambda s: s["ci95"][i])
    swaps = F.aggregate(
        "per_seed", F.lit(0.0), lambda total, s: total + s["swap_consistency"]
    ) / F.nullif(F.size("per_seed"), F.lit(0))
    return read_artifact(spark, runs_dir, "results.json", RESULTS).select(
        "run_id",
        "policy",
        "baseline",
        "judge",
        "judge_model",
        "n_prompts",
        "seeds",
        "win_rate_mean",
        "win_rate_min",
        "win_rate_max",
        F.array_min(bound(0)).alias("ci_lo"),
        F.array_max(bound(1)).alias("ci_hi"),
        swaps.alias("swap_consistency"),
    )


def read_results_by_seed(spark: SparkSession, runs_dir: str) -> DataFrame:
    """One row per run and generation seed, as win_rate_report and an interval give it."""
    seeds = read_artifact(spark, runs_dir, "results.json", RESULTS).select("run_id", F.inline("per_seed"))
    return seeds.withColumns({"ci_lo": F.col("ci95")[0], "ci_hi": F.col("ci95")[1]}).drop("ci95")


def read_records(spark: SparkSession, runs_dir: str) -> DataFrame:
    """The judged pairs of all runs, so that a stored run can be summarised again.

    `consistent` follows from the verdicts; a pair is told by its place in the seed's list.
    """
    seeds = read_artifact(spark, runs_dir, "results.json", JUDGED).select("run_id", F.inline("per_seed"))
    records = seeds.select("run_id", "seed", F.posexplode("records").alias("place", "r")).select(
        "run_id", "seed", "place", "r.*"
    )
    return records.withColumn("consistent", swap_consistent(F.col("verdict_ab"), F.col("verdict_ba")))


def flat_diagnostics(parsed: DataFrame) -> DataFrame:
    """Parsed diagnostics with the style rates as columns, as diagnostics_row names them."""
    style = [
        F.col(f"style_{side}")[rate].alias(f"{rate}_{side}")
        for side in ("policy", "reference")
        for rate in (*STYLE_RATES, "mean_chars")
    ]
    return parsed.select("*", *style).drop("style_policy", "style_reference")


def diagnostics_documents(rows: DataFrame) -> DataFrame:
    """(run_id, document): each row of diagnostics_row as the JSON a run writes."""
    nested = [
        F.struct(*[F.col(f"{rate}_{side}").alias(rate) for rate in (*STYLE_RATES, "mean_chars")]).alias(f"style_{side}")
        for side in ("policy", "reference")
    ]
    rates = {f"{rate}_{side}" for side in ("policy", "reference") for rate in (*STYLE_RATES, "mean_chars")}
    plain = [c for c in rows.columns if c not in rates and c != "run_id"]
    return rows.select("run_id", F.to_json(F.struct(*plain, *nested)).alias("document"))


def config_documents(runs: DataFrame) -> DataFrame:
    """(run_id, document): each row of the run registry as its resolved config."""
    group = lambda name, *columns: F.struct(*columns).alias(name)
    config = F.struct(
        "stage",
        group("method", "beta", "num_generations", "reward_model_path"),
        group("data", "rm_pair_fraction"),
        group("train", "output_dir"),
    )
    return runs.select("run_id", F.to_json(config).alias("document"))


def results_documents(by_seed: DataFrame) -> DataFrame:
    """(run_id, document): win-rates with their intervals per run and seed as the results a run writes."""
    rows = results_with_seeds(by_seed).withColumn("seeds", F.transform("per_seed", lambda s: s["seed"]))
    return rows.select("run_id", F.to_json(F.struct(*[c for c in rows.columns if c != "run_id"])).alias("document"))


def rm_eval_documents(accuracy: DataFrame) -> DataFrame:
    """(run_id, document): the rows of rm_pair_accuracy as a reward model's evaluation."""
    return accuracy.select("run_id", F.to_json(F.struct(*[c for c in accuracy.columns if c != "run_id"])).alias("document"))


def parse_diagnostics(documents: DataFrame) -> DataFrame:
    """The rows of diagnostics_documents again."""
    parsed = documents.select("run_id", F.from_json("document", DIAGNOSTICS, {"mode": "FAILFAST"}).alias("d"))
    return flat_diagnostics(parsed.select("run_id", "d.*"))


def read_diagnostics(spark: SparkSession, runs_dir: str) -> DataFrame:
    return flat_diagnostics(read_artifact(spark, runs_dir, "diagnostics.json", DIAGNOSTICS))


def read_dpo_eval(spark: SparkSession, runs_dir: str) -> DataFrame:
    """Beta, loss type and the trainer's evaluation metrics of each preference-optimised run."""
    return (
        read_artifact(spark, runs_dir, "dpo_eval.json", DPO_EVAL)
        .withColumnRenamed("eval_rewards/accuracies", "reward_accuracy")
        .withColumnRenamed("eval_rewards/margins", "reward_margin")
    )


def run_goodhart_gap(spark: SparkSession, runs_dir: str) -> DataFrame:
    judged = read_results(spark, runs_dir).select("run_id", F.col("win_rate_mean").alias("win_rate"))
    return goodhart_gap(read_diagnostics(spark, runs_dir), judged)


def run_hacking_flags(spark: SparkSession, runs_dir: str) -> DataFrame:
    return hacking_flags(read_diagnostics(spark, runs_dir))


def run_overoptimisation_curve(spark: SparkSession, runs_dir: str) -> DataFrame:
    """The curve over the grid's runs that have results and diagnostics below the directory."""
    points = read_diagnostics(spark, runs_dir).select(
        "run_id", F.col("mean_rm_score_policy").alias("reward"), F.col("kl_from_reference").alias("kl")
    )
    rates = read_results(spark, runs_dir).select("run_id", F.col("win_rate_mean").alias("win_rate"))
    return overoptimisation_curve(ablation_grid(spark).join(points, "run_id").join(rates, "run_id"))


def read_train_log(spark: SparkSession, runs_dir: str) -> DataFrame:
    """The kept log entries in long form: (run_id, entry, step, metric, value).

    `step` is the entry's own step where it names one, else its place.
    """
    entries = read_artifact(spark, runs_dir, "grpo_eval.json", TRAIN_LOG).select(
        "run_id", F.posexplode("log_history").alias("entry", "metrics")
    )
    step = F.coalesce(F.try_element_at("metrics", F.lit("step")).try_cast("bigint"), F.col("entry"))
    return (
        entries.withColumn("step", step)
        .select("run_id", "entry", "step", F.explode("metrics").alias("metric", "value"))
        .where(F.col("metric") != "step")
        .withColumn("value", F.col("value").try_cast("double"))
    )


def collect_runs(spark: SparkSession, runs_dir: str) -> DataFrame:
    """The leaderboard of all configured runs below a directory."""
    return leaderboard(
        read_runs(spark, runs_dir),
        read_rm_eval(spark, runs_dir),
        read_results(spark, runs_dir),
        read_diagnostics(spark, runs_dir),
    )
