"""The leaderboard over all runs, and what is read off an ablation axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fixed3
from ..functions.text import clip_prompt

# The leaderboard's columns and their headings.
LEADERBOARD = (
    ("run", "Run"),
    ("stage", "Stage"),
    ("beta", "beta"),
    ("num_generations", "G"),
    ("rm_pair_fraction", "RM data"),
    ("rm_accuracy", "RM acc"),
    ("win_rate", "Win-rate vs SFT"),
    ("ci", "95% CI"),
    ("swap_consistency", "Swap cons."),
    ("length_reward_corr", "len/reward rho"),
    ("kl", "KL from ref"),
)
MISSING = "—"

# The ablation axes. A run's name carries the value it varies.
GRID = {
    ("dpo_b", "beta"): ("0.01", "0.05", "0.1", "0.5"),
    ("grpo_g", "num_generations"): ("4", "8", "16"),
    ("grpo_rm", "rm_fraction"): ("0.1", "0.5"),
}

# Fixed value: how many log entries a training run keeps.
LOG_TAIL = 50


def ablation_grid(spark: SparkSession) -> DataFrame:
    """(run_id, axis, axis_value) of every run in the grid."""
    rows = [
        (f"{prefix}{value}", axis, float(value))
        for (prefix, axis), values in GRID.items()
        for value in values
    ]
    return spark.createDataFrame(rows, "run_id string, axis string, axis_value double")


def judgement_audit(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per judged pair, enough to check the win-rate again by hand."""
    return scored.select(
        *key,
        clip_prompt(F.col("prompt")).alias("prompt"),
        F.col("completion_policy").alias("policy_completion"),
        F.col("completion_baseline").alias("baseline_completion"),
        "verdict_ab",
        "verdict_ba",
        "score",
        F.length("completion_policy").cast("bigint").alias("len_policy"),
        F.length("completion_baseline").cast("bigint").alias("len_baseline"),
    )


def leaderboard(
    runs: DataFrame, rm_eval: DataFrame, results: DataFrame, diagnostics: DataFrame
) -> DataFrame:
    """One row per configured run; what a run has no artifact for stays null.

    All four sides hold one row per run.
    """
    return (
        runs.join(rm_eval.select("run_id", F.col("eval_accuracy").alias("rm_accuracy")), "run_id", "left")
        .join(
            results.select(
                "run_id", F.col("win_rate_mean").alias("win_rate"), "ci_lo", "ci_hi", "swap_consistency"
            ),
            "run_id",
            "left",
        )
        .join(
            diagnostics.select("run_id", "length_reward_corr", F.col("kl_from_reference").alias("kl")),
            "run_id",
            "left",
        )
        .select(
            F.col("run_id").alias("run"),
            "stage",
            "beta",
            "num_generations",
            "rm_pair_fraction",
            "rm_accuracy",
            "win_rate",
            "ci_lo",
            "ci_hi",
            "swap_consistency",
            "length_reward_corr",
            "kl",
        )
    )


def with_ci_text(board: DataFrame) -> DataFrame:
    """The interval's two bounds as one text column in their place."""
    bounds = F.concat(F.lit("["), fixed3(F.col("ci_lo")), F.lit(", "), fixed3(F.col("ci_hi")), F.lit("]"))
    return board.withColumn("ci", bounds).select(*[name for name, _ in LEADERBOARD])


def markdown_rows(board: DataFrame) -> DataFrame:
    """(run, line): each run's table line, three decimals, a dash where null."""

    def cell(field: T.StructField):
        value = F.col(field.name)
        shown = fixed3(value) if isinstance(field.dataType, T.DoubleType) else value.cast("string")
        return F.coalesce(shown, F.lit(MISSING))

    board = with_ci_text(board)
    cells = F.concat_ws(" | ", *[cell(field) for field in board.schema.fields])
    return board.select("run", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def markdown_head() -> list[str]:
    headings = " | ".join(label for _, label in LEADERBOARD)
    return [f"| {headings} |", "|" + "---|" * len(LEADERBOARD)]


def markdown_table(board: DataFrame) -> str:
    """The finished table as text; only its lines, one per run, reach the driver."""
    lines = markdown_rows(board).orderBy("run").select("line").toLocalIterator()
    return "\n".join([*markdown_head(), *[row.line for row in lines]])


def rm_quality_axis(runs: DataFrame, rm_eval: DataFrame, results: DataFrame) -> DataFrame:
    """Accuracy of a reward model beside the win-rate of the policy trained on it."""
    models = (
        runs.where(F.col("stage") == "rm")
        .join(rm_eval.select("run_id", "eval_accuracy"), "run_id")
        .select(
            F.col("output_dir").alias("reward_model_path"),
            F.col("run_id").alias("rm_run_id"),
            "rm_pair_fraction",
            F.col("eval_accuracy").alias("rm_accuracy"),
        )
    )
    policies = runs.select("run_id", "reward_model_path").join(
        results.select("run_id", "win_rate_mean"), "run_id"
    )
    return policies.join(models, "reward_model_path")


def ablation_by_axis(scored: DataFrame, grid: DataFrame, run: str = "run_id") -> DataFrame:
    """Every setting of the grid evaluated by one aggregation over the judgements."""
    return (
        scored.join(grid, run)
        .groupBy("axis", "axis_value", run)
        .agg(
            F.avg("score").alias("win_rate"),
            F.count("score").alias("n"),
            F.avg(F.col("consistent").cast("double")).alias("swap_consistency"),
        )
    )


def overoptimisation_curve(points: DataFrame) -> DataFrame:
    """Steps along an axis where the reward rises but the judge's win-rate does not.

    `points` holds one row per setting: axis, axis_value, reward, win_rate, kl. A
    NaN counts as unknown, and a step from or to an unknown value shows nothing.
    """
    along = Window.partitionBy("axis").orderBy("axis_value")
    step = lambda c: F.col(c) - F.lag(c).over(along)
    known = points.withColumns(
        {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("reward", "win_rate", "kl")}
    )
    steps = known.withColumns({f"{c}_change": step(c) for c in ("reward", "win_rate", "kl")})
    over = (F.col("reward_change") > 0) & (F.col("win_rate_change") <= 0)
    return steps.withColumn("over_optimised", F.coalesce(over, F.lit(False))).withColumn(
        "kl_climbing", F.coalesce(F.col("kl_change") > 0, F.lit(False))
    )


def axis_peak(by_axis: DataFrame) -> DataFrame:
    """The setting with the best win-rate per axis; the smallest one of equals.

    A null or NaN win-rate is never the best; an axis without any other gives nulls.
    """
    rate = F.nanvl(F.col("win_rate").cast("double"), F.lit(None).cast("double"))
    best = F.when(rate.isNotNull(), F.struct(rate, -F.col("axis_value")))
    return by_axis.groupBy("axis").agg(
        F.max_by("axis_value", best).alias("best_value"), F.max(rate).alias("win_rate")
    )


def log_tail(
    log: DataFrame, n: int = LOG_TAIL, run: str = "run_id", step: str = "step", entry: str | None = None
) -> DataFrame:
    """The rows of the last n log entries of each run.

    A long log holds one row per metric, so an entry is all rows with one step
    (and one `entry`, where several entries share a step). Spark keeps only n
    entries per run and task before the shuffle (a window group limit).
    """
    order = [F.col(c).desc() for c in (step, entry) if c is not None]
    latest = Window.partitionBy(run).orderBy(*order)
    return log.withColumn("_nth", F.dense_rank().over(latest)).where(F.col("_nth") <= n).drop("_nth")
