"""Queries over the leaderboard and the ablation axes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..operators.lineage import ensure_checkpoint_dir
from ..sources import artifacts, sinks
from . import tables
from .comparison import judged, judged_by_seed, results
from .diagnosing import diagnostics_of, run_win_rate
from .registry import ORACLE, query, rounded
from .rewarding import rm_eval
from .tables import sql_r6, with_tables

tables.CTES["v_leaderboard"] = (
    ("v_runs", "v_rm_eval", "v_results", "v_diagnostics"),
    """select r.run_id as run, stage, beta, num_generations, rm_pair_fraction,
        e.eval_accuracy as rm_accuracy, s.win_rate_mean as win_rate, s.ci_lo, s.ci_hi,
        s.swap_consistency, d.length_reward_corr, d.kl_from_reference as kl
      from v_runs r left join v_rm_eval e on e.run_id = r.run_id
        left join v_results s on s.run_id = r.run_id
        left join v_diagnostics d on d.run_id = r.run_id""",
)
# One setting whose win-rate is unknown, for what is read off the axes.
UNKNOWN = "grpo_g8"
tables.CTES["v_axis_points"] = (
    ("v_by_axis",),
    f"select * replace (case when run_id = '{UNKNOWN}' then 'nan'::double else win_rate end as win_rate) from v_by_axis",
)
tables.CTES["v_by_axis"] = (
    ("v_judged", "v_grid"),
    """select axis, axis_value, run_id, avg(score) as win_rate, count(score) as n,
        avg(consistent::int::double) as swap_consistency
      from v_judged join v_grid using (run_id) group by axis, axis_value, run_id""",
)

FLOATS = ("rm_accuracy", "win_rate", "ci_lo", "ci_hi", "swap_consistency", "length_reward_corr", "kl")


def board(spark, sf_dir) -> DataFrame:
    return report.leaderboard(
        tables.runs(spark), rm_eval(spark, sf_dir), results(spark, sf_dir), diagnostics_of(spark, sf_dir)
    )


def by_axis(spark, sf_dir) -> DataFrame:
    return report.ablation_by_axis(judged(spark, sf_dir), report.ablation_grid(spark))


def axis_points(spark, sf_dir) -> DataFrame:
    unknown = F.when(F.col("run_id") == UNKNOWN, float("nan")).otherwise(F.col("win_rate"))
    return by_axis(spark, sf_dir).withColumn("win_rate", unknown)


@query(
    "leaderboard",
    with_tables(
        "v_leaderboard",
        "select run, stage, beta, num_generations, rm_pair_fraction, "
        + ", ".join(f"{sql_r6(c)} as {c}" for c in FLOATS)
        + " from v_leaderboard order by run",
    ),
)
def leaderboard(spark, sf_dir) -> DataFrame:
    return rounded(board(spark, sf_dir), *FLOATS).orderBy("run")


@query("leaderboard_of_artifacts", ORACLE["leaderboard"])
def leaderboard_of_artifacts(spark, sf_dir) -> DataFrame:
    """Every run's artifacts written to the shared folder, and the leaderboard read from them."""
    runs_dir = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    write = lambda documents, name: sinks.write_artifacts(documents, runs_dir, name)
    write(artifacts.config_documents(tables.runs(spark)), "config.resolved.json")
    write(artifacts.rm_eval_documents(rm_eval(spark, sf_dir)), "rm_eval.json")
    write(artifacts.results_documents(judged_by_seed(spark, sf_dir)), "results.json")
    write(artifacts.diagnostics_documents(diagnostics_of(spark, sf_dir)), "diagnostics.json")
    return rounded(artifacts.collect_runs(spark, runs_dir), *FLOATS).orderBy("run")


def _cell(column: str) -> str:
    return f"coalesce(printf('%.3f', {column}), '—')"


@query(
    "leaderboard_markdown_rows",
    with_tables(
        "v_leaderboard",
        f"""select run, '| ' || concat_ws(' | ', run, stage, {_cell('beta')},
            coalesce(num_generations::varchar, '—'), {_cell('rm_pair_fraction')},
            {_cell('rm_accuracy')}, {_cell('win_rate')},
            coalesce('[' || printf('%.3f', ci_lo) || ', ' || printf('%.3f', ci_hi) || ']', '—'),
            {_cell('swap_consistency')}, {_cell('length_reward_corr')}, {_cell('kl')}) || ' |' as line
        from v_leaderboard""",
    ),
)
def leaderboard_markdown_rows(spark, sf_dir) -> DataFrame:
    return report.markdown_rows(board(spark, sf_dir))


@query(
    "rm_quality_axis",
    with_tables(
        "v_runs v_rm_eval v_by_seed",
        f"""select p.reward_model_path, p.run_id, {sql_r6('w.win_rate')} as win_rate_mean,
          m.run_id as rm_run_id, m.rm_pair_fraction, {sql_r6('e.eval_accuracy')} as rm_accuracy
        from v_runs p join v_runs m on p.reward_model_path = m.output_dir and m.stage = 'rm'
          join v_rm_eval e on e.run_id = m.run_id
          join (select run_id, avg(win_rate) as win_rate from v_by_seed group by run_id) w
            on w.run_id = p.run_id""",
    ),
)
def rm_quality_axis(spark, sf_dir) -> DataFrame:
    win_rates = run_win_rate(spark, sf_dir).withColumnRenamed("win_rate", "win_rate_mean")
    axis = report.rm_quality_axis(tables.runs(spark), rm_eval(spark, sf_dir), win_rates)
    return rounded(axis, "win_rate_mean", "rm_accuracy")


@query(
    "ablation_by_axis",
    with_tables(
        "v_by_axis",
        f"""select axis, axis_value, run_id, {sql_r6('win_rate')} as win_rate, n,
          {sql_r6('swap_consistency')} as swap_consistency from v_by_axis""",
    ),
)
def ablation_by_axis(spark, sf_dir) -> DataFrame:
    return rounded(by_axis(spark, sf_dir), "win_rate", "swap_consistency")


CURVE = ("reward", "win_rate", "kl", "reward_change", "win_rate_change", "kl_change")


@query(
    "overoptimisation_curve",
    with_tables(
        "v_axis_points v_diagnostics",
        f"""select axis, axis_value, run_id, {", ".join(f"{sql_r6(c)} as {c}" for c in CURVE)},
          coalesce(reward_change > 0 and win_rate_change <= 0, false) as over_optimised,
          coalesce(kl_change > 0, false) as kl_climbing
        from (select *, reward - lag(reward) over w as reward_change,
            win_rate - lag(win_rate) over w as win_rate_change, kl - lag(kl) over w as kl_change
          from (select axis, axis_value, run_id, mean_rm_score_policy as reward,
              case when not isnan(win_rate) then win_rate end as win_rate,
              kl_from_reference as kl from v_axis_points join v_diagnostics using (run_id))
          window w as (partition by axis order by axis_value))""",
    ),
)
def overoptimisation_curve(spark, sf_dir) -> DataFrame:
    diagnostics = diagnostics_of(spark, sf_dir).select(
        "run_id", F.col("mean_rm_score_policy").alias("reward"), F.col("kl_from_reference").alias("kl")
    )
    points = axis_points(spark, sf_dir).join(diagnostics, "run_id")
    points = points.select("axis", "axis_value", "run_id", "reward", "win_rate", "kl")
    return rounded(report.overoptimisation_curve(points), *CURVE)


@query(
    "axis_peak",
    with_tables(
        "v_axis_points",
        f"""select axis, axis_value as best_value, {sql_r6('win_rate')} as win_rate from v_axis_points
        where not isnan(win_rate)
        qualify row_number() over (partition by axis order by win_rate desc, axis_value) = 1""",
    ),
)
def axis_peak(spark, sf_dir) -> DataFrame:
    return rounded(report.axis_peak(axis_points(spark, sf_dir)), "win_rate")


@query(
    "log_tail",
    """select event_type as run_id, event_id // 3 as step, 'metric' || (event_id % 3) as metric, value from events
    qualify dense_rank() over (partition by event_type order by event_id // 3 desc) <= 50""",
)
def log_tail(spark, sf_dir) -> DataFrame:
    return report.log_tail(tables.training_log(spark, sf_dir))
