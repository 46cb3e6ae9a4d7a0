"""Queries over judged pairs and win-rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pairing, report, resampling, winrate
from . import tables
from .registry import query, rounded
from .tables import KEY, sql_hash, sql_r6, with_tables

BY_SEED = ["run_id", "seed"]

SUMMARY = """avg(score) as win_rate, count(score) as n, count(*) filter (score = 1) as wins,
  count(*) filter (score = 0.5) as ties, count(*) filter (score = 0) as losses,
  avg(consistent::int::double) as swap_consistency, count(*) filter (score is null) as n_unjudged"""

tables.CTES["v_by_seed"] = (
    ("v_judged",),
    f"select run_id, seed, {SUMMARY} from v_judged group by run_id, seed",
)


def sql_bootstrap(source: str, value: str, order: str) -> str:
    """Row by row: number the rows, draw positions, join the rows drawn."""
    placed = f"""select run_id, seed, {value} as value,
        row_number() over (partition by run_id, seed order by {order}) - 1 as position,
        count(*) over (partition by run_id, seed) as n from {source} where {value} is not null"""
    return f"""select run_id, seed, quantile_cont(mean, 0.025) as ci_lo, quantile_cont(mean, 0.975) as ci_hi
      from (select run_id, seed, replicate, avg(value) as mean
        from (select run_id, seed, replicate, {sql_hash('0', 'replicate', 'position')} % n as position
          from ({placed}) cross join range({winrate.REPLICATES}) as r(replicate))
          join (select run_id, seed, position, value from ({placed})) using (run_id, seed, position)
        group by run_id, seed, replicate)
      group by run_id, seed"""


def sql_counter_hash(source: str, columns: str) -> str:
    """`columns` and `z`, the counter hash of `resampling.poisson_weights`, from `draw` and `replicate`."""
    word = lambda x: f"(({x}) & 4294967295::ubigint)"

    def mixed(rows: str, kept: str) -> str:
        for shift, factor in zip(resampling.MIX_SHIFTS, resampling.MIX_FACTORS):
            rows = f"select {kept}, {word(f'xor(z, z >> {shift}) * {factor}::ubigint')} as z from ({rows})"
        return f"select {kept}, xor(z, z >> {resampling.MIX_SHIFTS[-1]}) as z from ({rows})"

    start = f"xor({word('draw::ubigint')}, {word(f'replicate::ubigint * {resampling.COUNTER_STEP}::ubigint')})"
    once = mixed(f"select {columns}, draw, {start} as z from {source}", f"{columns}, draw")
    return mixed(f"select {columns}, {word('z + (draw::ubigint >> 32)')} as z from ({once})", columns)


def sql_poisson(source: str, value: str, key: str) -> str:
    """Row by row: weights from the key's hash and the replicate, then weighted means per replicate."""
    weight = " ".join(
        f"when z >= {below} then {count + 1}" for count, below in reversed([*enumerate(resampling.POISSON_STEPS)])
    )
    draws = f"""((select run_id, seed, {value} as value, {sql_hash('0', key)} as draw from {source})
        cross join range(1, {winrate.REPLICATES + 1}) as r(replicate))"""
    return f"""select run_id, seed, quantile_cont(mean, 0.025) as ci_lo, quantile_cont(mean, 0.975) as ci_hi
      from (select run_id, seed, replicate, sum(weight * value) / sum(weight) as mean
        from (select run_id, seed, value, replicate, case {weight} else 0 end as weight
          from ({sql_counter_hash(draws, 'run_id, seed, value, replicate')}))
        where weight > 0 group by run_id, seed, replicate)
      group by run_id, seed"""


def sql_exact_bounds(summary: str) -> str:
    """The distribution of a resampled win-rate, term by term: all ways to draw wins and ties."""
    power = lambda k, base: f"case when {k} = 0 then 0 else {k} * ln({base} / n) end"
    left = "n - w - t"
    chance = f"""exp(lgamma(n + 1) - lgamma(w + 1) - lgamma(t + 1) - lgamma({left} + 1)
        + {power('w', 'wins')} + {power('t', 'ties')} + {power(f'({left})', 'losses')})"""
    return f"""select run_id, seed, min(s) filter (upto >= 0.025 - 1e-9) / (2.0e0 * n) as ci_lo,
        min(s) filter (upto >= 0.975 - 1e-9) / (2.0e0 * n) as ci_hi
      from (select run_id, seed, n, s, sum(p) over (partition by run_id, seed order by s) as upto
        from (select run_id, seed, n, 2 * w + t as s, sum({chance}) as p
          from (select *, unnest(range(0, n - w + 1)) as t
            from (select *, unnest(range(0, n + 1)) as w from {summary} where n > 0))
          where (wins > 0 or w = 0) and (ties > 0 or t = 0) and (losses > 0 or {left} = 0)
          group by run_id, seed, n, 2 * w + t))
      group by run_id, seed, n"""


tables.CTES["v_draws_ci"] = (("v_judged",), sql_bootstrap("v_judged", "score", "score, prompt_id"))
tables.CTES["v_ci"] = (("v_by_seed",), sql_exact_bounds("v_by_seed"))
tables.CTES["v_gap_ci"] = (
    ("v_pairs",),
    sql_poisson("v_pairs", "(length(completion_policy) - length(completion_baseline))::double", "prompt_id"),
)
tables.CTES["v_results"] = (
    ("v_by_seed", "v_ci"),
    """select run_id, avg(win_rate) as win_rate_mean, min(ci_lo) as ci_lo, max(ci_hi) as ci_hi,
        avg(swap_consistency) as swap_consistency
      from v_by_seed join v_ci using (run_id, seed) group by run_id""",
)


def judged(spark, sf_dir) -> DataFrame:
    return pairing.judged_pairs(tables.raw_verdicts(spark, sf_dir), KEY)


def judged_by_seed(spark, sf_dir) -> DataFrame:
    """Win-rate and bootstrap interval per run and seed."""
    return winrate.bootstrap_ci_counts(winrate.win_rate_summary(judged(spark, sf_dir), BY_SEED))


def results(spark, sf_dir) -> DataFrame:
    """One row per run: mean win-rate, interval over the seeds, swap consistency."""
    by_seed = judged_by_seed(spark, sf_dir)
    return winrate.seed_rollup(by_seed).join(winrate.seed_ci_envelope(by_seed), "run_id")


@query(
    "pair_policy_baseline",
    with_tables(
        "v_pairs",
        """select run_id, seed, prompt_id, completion_policy, completion_baseline,
          rm_score_policy, rm_score_baseline from v_pairs""",
    ),
)
def pair_policy_baseline(spark, sf_dir) -> DataFrame:
    rows = tables.scores(spark, sf_dir).drop("doc_id")
    return pairing.pair_policy_baseline(*pairing.sides(rows), on=KEY, values=["completion", "rm_score"])


@query(
    "pairing_coverage",
    with_tables(
        "v_completions",
        """select run_id, seed, sum(p * b)::bigint as matched, sum(p * (1 - b))::bigint as policy_only,
          sum(b * (1 - p))::bigint as baseline_only
        from (select run_id, seed, prompt_id, max((model_role = 'policy')::int) as p,
            max((model_role = 'baseline')::int) as b
          from v_completions join labels using (doc_id) group by run_id, seed, prompt_id)
        group by run_id, seed""",
    ),
)
def pairing_coverage(spark, sf_dir) -> DataFrame:
    """Pairs of which both answers, or one only, were labelled."""
    labelled = tables.table(spark, sf_dir, "labels").select("doc_id")
    answered = tables.completions(spark, sf_dir).join(labelled, "doc_id")
    return pairing.pairing_coverage(answered, KEY, BY_SEED)


@query(
    "score_verdict",
    with_tables(
        "v_rm_judged",
        """select run_id, seed, prompt_id, rm_score_policy, rm_score_baseline, verdict_ab, verdict_ba
        from v_rm_judged""",
    ),
)
def score_verdict(spark, sf_dir) -> DataFrame:
    return pairing.scored_pairs(tables.score_pairs(spark, sf_dir)).drop("score", "consistent")


@query(
    "swap_expand",
    with_tables(
        "v_rm_judged",
        """select run_id, seed, prompt_id, 'ab' as ord, verdict_ab as verdict from v_rm_judged
        union all select run_id, seed, prompt_id, 'ba', verdict_ba from v_rm_judged""",
    ),
)
def swap_expand(spark, sf_dir) -> DataFrame:
    pairs = tables.score_pairs(spark, sf_dir)
    return pairing.both_orders(pairs).select(*KEY, "ord", "verdict")


@query(
    "swap_scores",
    with_tables(
        "v_judged",
        "select run_id, seed, prompt_id, verdict_ab, verdict_ba, score, consistent from v_judged",
    ),
)
def swap_scores(spark, sf_dir) -> DataFrame:
    return judged(spark, sf_dir)


RATES = ("win_rate", "swap_consistency", "mean_len_policy", "mean_len_baseline")

REPORT_SQL = f"""select run_id, seed, {sql_r6('win_rate')} as win_rate, n, wins, ties, losses, n_unjudged,
  {sql_r6('swap_consistency')} as swap_consistency, {sql_r6('mean_len_policy')} as mean_len_policy,
  {sql_r6('mean_len_baseline')} as mean_len_baseline
from (select run_id, seed, {SUMMARY} from {{judged}} group by run_id, seed)
  join (select run_id, seed,
      avg(length(completion)) filter (model_role = 'policy') as mean_len_policy,
      avg(length(completion)) filter (model_role = 'baseline') as mean_len_baseline
    from v_completions group by run_id, seed) using (run_id, seed)"""


@query("win_rate_summary", with_tables("v_judged v_completions", REPORT_SQL.format(judged="v_judged")))
def win_rate_summary(spark, sf_dir) -> DataFrame:
    """The judge's win-rate of every run and seed: the flagship query."""
    report_ = winrate.win_rate_report(judged(spark, sf_dir), tables.completions(spark, sf_dir), BY_SEED)
    return rounded(report_, *RATES)


@query(
    "win_rate_summary_rm",
    with_tables("v_rm_judged v_completions", REPORT_SQL.format(judged="v_rm_judged")),
)
def win_rate_summary_rm(spark, sf_dir) -> DataFrame:
    """The same with the reward model as judge."""
    scored = pairing.scored_pairs(tables.score_pairs(spark, sf_dir))
    return rounded(
        winrate.win_rate_report(scored, tables.completions(spark, sf_dir), BY_SEED), *RATES
    )


@query(
    "bootstrap_ci",
    with_tables(
        "v_by_seed v_draws_ci",
        f"""select run_id, seed, {sql_r6('win_rate')} as mean, n, {sql_r6('ci_lo')} as ci_lo,
          {sql_r6('ci_hi')} as ci_hi from v_by_seed join v_draws_ci using (run_id, seed)""",
    ),
)
def bootstrap_ci(spark, sf_dir) -> DataFrame:
    """The draw-by-draw form; it checks bootstrap_ci_counts."""
    intervals = winrate.bootstrap_ci(winrate.win_rate_summary(judged(spark, sf_dir), BY_SEED))
    mean = F.col("win_rate").alias("mean")
    return rounded(intervals.select(*BY_SEED, mean, "n", "ci_lo", "ci_hi"), "mean", "ci_lo", "ci_hi")


@query(
    "bootstrap_ci_values",
    with_tables(
        "v_pairs v_gap_ci",
        f"""select run_id, seed, {sql_r6('mean')} as mean, n, {sql_r6('ci_lo')} as ci_lo,
          {sql_r6('ci_hi')} as ci_hi
        from v_gap_ci join (select run_id, seed, count(*) as n,
            avg(length(completion_policy) - length(completion_baseline)) as mean
          from v_pairs group by run_id, seed) using (run_id, seed)""",
    ),
)
def bootstrap_ci_values(spark, sf_dir) -> DataFrame:
    """How much longer the policy's answers are, with an interval."""
    lengths = tables.completions(spark, sf_dir).withColumn("chars", F.length("completion"))
    pairs = pairing.pair_policy_baseline(
        *pairing.sides(lengths.select(*KEY, "model_role", "chars")), on=KEY, values=["chars"]
    )
    gaps = pairs.select(*KEY, (F.col("chars_policy") - F.col("chars_baseline")).alias("gap"))
    intervals = winrate.bootstrap_ci_values(gaps, BY_SEED, "gap", ["prompt_id"])
    return rounded(intervals, "mean", "ci_lo", "ci_hi")


@query(
    "bootstrap_ci_counts",
    with_tables(
        "v_by_seed v_ci",
        f"""select run_id, seed, {sql_r6('win_rate')} as win_rate, n, {sql_r6('ci_lo')} as ci_lo,
          {sql_r6('ci_hi')} as ci_hi from v_by_seed join v_ci using (run_id, seed)""",
    ),
)
def bootstrap_ci_counts(spark, sf_dir) -> DataFrame:
    intervals = judged_by_seed(spark, sf_dir).select(*BY_SEED, "win_rate", "n", "ci_lo", "ci_hi")
    return rounded(intervals, "win_rate", "ci_lo", "ci_hi")


@query(
    "seed_rollup",
    with_tables(
        "v_by_seed",
        f"""select run_id, count(*) as seeds, {sql_r6('avg(win_rate)')} as win_rate_mean,
          {sql_r6('min(win_rate)')} as win_rate_min, {sql_r6('max(win_rate)')} as win_rate_max
        from v_by_seed group by run_id""",
    ),
)
def seed_rollup(spark, sf_dir) -> DataFrame:
    by_seed = winrate.win_rate_summary(judged(spark, sf_dir), BY_SEED)
    return rounded(winrate.seed_rollup(by_seed), "win_rate_mean", "win_rate_min", "win_rate_max")


@query(
    "seed_ci_envelope",
    with_tables(
        "v_results",
        f"""select run_id, {sql_r6('ci_lo')} as ci_lo, {sql_r6('ci_hi')} as ci_hi,
          {sql_r6('swap_consistency')} as swap_consistency from v_results""",
    ),
)
def seed_ci_envelope(spark, sf_dir) -> DataFrame:
    envelope = winrate.seed_ci_envelope(judged_by_seed(spark, sf_dir))
    return rounded(envelope, "ci_lo", "ci_hi", "swap_consistency")


@query(
    "judgement_audit",
    with_tables(
        "v_judged v_pairs v_prompts",
        """select run_id, seed, prompt_id, substr(prompt, 1, 200) as prompt,
          completion_policy as policy_completion, completion_baseline as baseline_completion,
          verdict_ab, verdict_ba, score, length(completion_policy)::bigint as len_policy,
          length(completion_baseline)::bigint as len_baseline
        from v_judged join v_pairs using (run_id, seed, prompt_id) join v_prompts using (prompt_id)""",
    ),
)
def judgement_audit(spark, sf_dir) -> DataFrame:
    answers = tables.completions(spark, sf_dir).drop("doc_id")
    pairs = pairing.pair_policy_baseline(*pairing.sides(answers), on=KEY, values=["completion"])
    # Prompts join the narrow verdicts, so that the answers are shuffled once only.
    verdicts = judged(spark, sf_dir).join(tables.prompts(spark, sf_dir), "prompt_id")
    return report.judgement_audit(pairs.join(verdicts, KEY), KEY)
