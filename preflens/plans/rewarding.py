"""Queries over rewards and reward models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash52
from ..functions.text import scorer_input
from ..operators import rewards
from ..operators.skew import deal_out
from ..sources.tables import select_split
from . import tables
from .features import STYLE_SQL
from .registry import query, r6, rounded
from .tables import sql_hash, sql_mean, sql_r6, with_tables

GROUP = ["run_id", "prompt_id"]
LENGTH_WEIGHT = 0.5


def rewarded(spark, sf_dir) -> DataFrame:
    reward = rewards.composite_reward(F.col("rm_score"), F.col("completion"), LENGTH_WEIGHT)
    return tables.rollouts(spark, sf_dir).select(*GROUP, "sample_id", reward.alias("reward"))


def rm_pairs(spark, sf_dir) -> DataFrame:
    return rewards.pair_scores(
        tables.preference_ids(spark, sf_dir), tables.rm_scores(spark, sf_dir), ["run_id"], "doc_id"
    )


def rm_eval(spark, sf_dir) -> DataFrame:
    return rewards.rm_pair_accuracy(select_split(rm_pairs(spark, sf_dir), "test_prefs"), ["run_id"])


@query(
    "composite_reward",
    with_tables(
        "v_rewards", f"select run_id, prompt_id, sample_id, {sql_r6('reward')} as reward from v_rewards"
    ),
)
def composite_reward(spark, sf_dir) -> DataFrame:
    return rounded(rewarded(spark, sf_dir), "reward")


@query(
    "group_advantage",
    with_tables(
        "v_rewards",
        f"""select run_id, prompt_id, sample_id, {sql_r6('reward')} as reward, {sql_r6('''
          case when n = 1 then 0.0e0 else (reward - m) / (s + 1e-4) end''')} as advantage
        from v_rewards join (select run_id, prompt_id, avg(reward) as m, stddev_samp(reward) as s,
            count(*) as n from v_rewards group by run_id, prompt_id) using (run_id, prompt_id)""",
    ),
)
def group_advantage(spark, sf_dir) -> DataFrame:
    return rounded(
        rewards.group_advantage(rewarded(spark, sf_dir), GROUP), "reward", "advantage"
    )


@query(
    "incomplete_groups",
    with_tables(
        "v_rollouts",
        """select run_id, prompt_id, count(*) as samples,
          split_part(run_id, '_g', 2)::bigint as group_size
        from v_rollouts group by run_id, prompt_id
        having count(*) % split_part(run_id, '_g', 2)::bigint <> 0""",
    ),
)
def incomplete_groups(spark, sf_dir) -> DataFrame:
    size = F.regexp_extract("run_id", "_g([0-9]+)$", 1).cast("bigint")
    return rewards.incomplete_groups(tables.rollouts(spark, sf_dir), GROUP, size)


@query(
    "rm_pair_accuracy",
    with_tables(
        "v_rm_eval",
        f"select run_id, {sql_r6('eval_accuracy')} as eval_accuracy, n_pairs, n_ties, n_unscored from v_rm_eval",
    ),
)
def rm_pair_accuracy(spark, sf_dir) -> DataFrame:
    return rounded(rm_eval(spark, sf_dir), "eval_accuracy")


SOFT = "greatest(-d, 0) + ln(1 + exp(-abs(d)))"


@query(
    "bt_loss",
    with_tables(
        "v_rm_pairs",
        f"""select run_id, split, {sql_r6(sql_mean(SOFT))} as loss, {sql_r6(sql_mean('s * s'))} as centring
        from (select run_id, split, score_chosen - score_rejected as d,
            score_chosen + score_rejected as s from v_rm_pairs)
        group by run_id, split""",
    ),
)
def bt_loss(spark, sf_dir) -> DataFrame:
    return rounded(rewards.bt_loss(rm_pairs(spark, sf_dir), ["run_id", "split"]), "loss", "centring")


GAP = "(pi_chosen - ref_chosen) - (pi_rejected - ref_rejected)"


@query(
    "dpo_margins",
    with_tables(
        "v_logprobs",
        f"""select split, {sql_r6(f'avg(0.1e0 * ({GAP}))')} as reward_margin,
          {sql_r6(f'avg((not isnan({GAP}) and 0.1e0 * ({GAP}) > 0)::int::double)')} as reward_accuracy,
          count(*) as n_pairs
        from (select * replace (case when split = 'test_prefs' and pair_id % 31 = 4 then 'nan'::double
          else pi_chosen end as pi_chosen) from v_logprobs) group by split""",
    ),
)
def dpo_margins(spark, sf_dir) -> DataFrame:
    """Margins of both splits; a few of one are NaN."""
    lost = (F.col("split") == "test_prefs") & (F.col("pair_id") % 31 == 4)
    logprobs = tables.sequence_logprobs(spark, sf_dir)
    logprobs = logprobs.withColumn("pi_chosen", F.when(lost, float("nan")).otherwise(F.col("pi_chosen")))
    margins = rewards.dpo_margins(logprobs, 0.1, ["split"])
    return rounded(margins, "reward_margin", "reward_accuracy")


def _soft(x: str) -> str:
    """-log sigmoid(x)."""
    return f"(greatest(-({x}), 0) + ln(1 + exp(-abs({x}))))"


@query(
    "preference_losses",
    with_tables(
        "v_logprobs",
        f"""select loss_type, beta, {sql_r6(f'''avg(case loss_type
            when 'sigmoid' then 0.9e0 * {_soft('beta * h')} + 0.1e0 * {_soft('-beta * h')}
            when 'ipo' then (h - 1 / (2 * beta)) * (h - 1 / (2 * beta))
            when 'hinge' then greatest(0, 1 - beta * h)
            else (0.9e0 * {_soft('beta * h')} - 0.1e0 * {_soft('-beta * h')}) / 0.8e0 end)''')} as loss
        from (select {GAP} as h from v_logprobs),
          (values ('sigmoid'), ('ipo'), ('hinge'), ('robust')) as l(loss_type),
          (values (0.01e0), (0.05e0), (0.1e0), (0.5e0)) as b(beta)
        group by loss_type, beta""",
    ),
)
def preference_losses(spark, sf_dir) -> DataFrame:
    losses = rewards.preference_losses(tables.sequence_logprobs(spark, sf_dir), label_smoothing=0.1)
    return rounded(losses, "loss")


def _side_sql(expression: str, side: str) -> str:
    return expression.replace("completion", side)


def _gap_sql(expression: str) -> str:
    return f"{_side_sql(expression, 'chosen')} - {_side_sql(expression, 'rejected')}"


_FLIP = f"{sql_hash(repr('side'), 'pair_id')} % 2 = 0"
_DESIGN = {
    "log_chars": _gap_sql("ln(1 + length(completion))"),
    "length_penalty": _gap_sql("greatest(-1.0e0, -abs(length(completion) - 1200) / 1200.0e0)"),
    **{
        f"has_{name}": _gap_sql(f"({STYLE_SQL[f'{name}_rate']})")
        for name in ("header", "bullet", "enthusiasm")
    },
}


@query(
    "rm_design_sums",
    with_tables(
        "v_pref_texts",
        f"""select rm_pair_fraction, count(*) as n_train_pairs, count(*) filter (flip) as n_flipped,
          {", ".join(f"{sql_r6(f'sum(case when flip then -g_{n} else g_{n} end)')} as {n}" for n in _DESIGN)}
        from (select *, {_FLIP} as flip, {", ".join(f"{e} as g_{n}" for n, e in _DESIGN.items())}
          from (select * from v_pref_texts, (values {", ".join(f"({f}e0)" for f in rewards.RM_FRACTIONS)}) as t(rm_pair_fraction)
            where split = 'train_prefs'
            qualify row_number() over (partition by rm_pair_fraction order by {sql_hash('17', 'pair_id')}, pair_id)
              <= greatest(1, floor((select count(*) from v_pref_texts where split = 'train_prefs') * rm_pair_fraction))))
        group by rm_pair_fraction""",
    ),
)
def rm_design_sums(spark, sf_dir) -> DataFrame:
    sums = rewards.rm_design_sums(tables.preference_pairs(spark, sf_dir))
    return rounded(sums.drop("distinct_4"), *_DESIGN)


# The style features that SQL repeats, and Newton steps enough to converge from zero weights.
_STYLE = tuple(_DESIGN)
_NEWTON_STEPS = 9


def _style_fit_sql() -> str:
    """The same minimum by Newton steps written out: sums, elimination and substitution as nested selects."""
    k = len(_STYLE)
    x = [f"x{i}" for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    penalty = f"{rewards.RM_PENALTY}e0"

    def step(before: str) -> str:
        margin = " + ".join(f"w{i} * x{i}" for i in range(k))
        sums = ", ".join(
            [f"any_value(w{i}) as w{i}" for i in range(k)]
            + [
                f"case when any_value(v{i}) > 0 then avg((y - p) * x{i}) - {penalty} * any_value(v{i} * w{i}) else 0.0e0 end as b{i}"
                for i in range(k)
            ]
            + [
                f"case when any_value(v{i}) > 0 and any_value(v{j}) > 0 then avg(p * (1 - p) * x{i} * x{j}) else 0.0e0 end"
                + (f" + case when any_value(v{i}) > 0 then {penalty} * any_value(v{i}) else 1.0e0 end" if i == j else "")
                + f" as a{i}_{j}"
                for i, j in upper
            ]
            + [f"0.0e0 as d{i}" for i in range(k)]
        )
        select = f"""select rm_pair_fraction, {sums} from (
            select *, 1.0e0 / (1.0e0 + exp(-({margin}))) as p
            from v_style_rows join v_style_spread using (rm_pair_fraction) join {before} using (rm_pair_fraction))
          group by rm_pair_fraction"""
        for c in range(k - 1):
            ratio = lambda r: f"a{c}_{r} / a{c}_{c}"
            less = [f"a{i}_{j} - {ratio(i)} * a{c}_{j} as a{i}_{j}" for i, j in upper if i > c]
            less += [f"b{i} - {ratio(i)} * b{c} as b{i}" for i in range(c + 1, k)]
            select = f"select * replace ({', '.join(less)}) from ({select})"
        for c in reversed(range(k)):
            known = "".join(f" - a{c}_{j} * d{j}" for j in range(c + 1, k))
            select = f"select * replace ((b{c}{known}) / a{c}_{c} as d{c}) from ({select})"
        return f"select rm_pair_fraction, {', '.join(f'w{i} + d{i} as w{i}' for i in range(k))} from ({select})"

    rows = f"""select rm_pair_fraction, case when {_FLIP} then 0.0e0 else 1.0e0 end as y,
          {", ".join(f"case when {_FLIP} then -({e}) else {e} end as {n}" for n, e in zip(x, _DESIGN.values()))}
        from (select * from v_pref_texts, (values {", ".join(f"({f}e0)" for f in rewards.RM_FRACTIONS)}) as t(rm_pair_fraction)
          where split = 'train_prefs'
          qualify row_number() over (partition by rm_pair_fraction order by {sql_hash('17', 'pair_id')}, pair_id)
            <= greatest(1, floor((select count(*) from v_pref_texts where split = 'train_prefs') * rm_pair_fraction)))"""
    spread = ", ".join(f"coalesce(var_samp({n}), 0.0e0) as v{i}" for i, n in enumerate(x))
    views = [
        f"v_style_rows as materialized ({rows})",
        f"v_style_spread as materialized (select rm_pair_fraction, count(*) as n, {spread} from v_style_rows group by rm_pair_fraction)",
        f"v_fit0 as (select rm_pair_fraction, {', '.join(f'0.0e0 as w{i}' for i in range(k))} from v_style_spread)",
        *[f"v_fit{s} as materialized ({step(f'v_fit{s - 1}')})" for s in range(1, _NEWTON_STEPS + 1)],
    ]
    last = f"select * from v_fit{_NEWTON_STEPS} join v_style_spread using (rm_pair_fraction)"
    weights = " union all ".join(
        f"select rm_pair_fraction, n as n_train_pairs, '{name}' as feature, round(w{i}, 4) as weight from ({last})"
        for i, name in enumerate(_STYLE)
    )
    return ", ".join(views) + "\n" + weights


@query("rm_style_weights", with_tables("v_pref_texts", "").rstrip() + ", " + _style_fit_sql())
def rm_style_weights(spark, sf_dir) -> DataFrame:
    """Weights to four decimals; both sides run to convergence."""
    pairs = deal_out(tables.preference_pairs(spark, sf_dir))
    weights = rewards.rm_style_weights(pairs, _STYLE)
    return weights.withColumn("weight", F.round("weight", 4) + F.lit(0.0))


@query("rm_linear_fit")
def rm_linear_fit(spark, sf_dir) -> DataFrame:
    """An iterative fit over 262 features; SQL repeats it for the style features in `rm_style_weights`."""
    # The derived pairs come out of joins planned for narrow ids; their texts are long.
    pairs = deal_out(tables.preference_pairs(spark, sf_dir))
    return rounded(rewards.rm_linear_fit(pairs), "eval_accuracy")


@query(
    "score_completions",
    with_tables(
        "v_completions v_prompts",
        f"""select doc_id, run_id, model_role, {sql_r6(f'''
            {sql_hash("prompt || chr(10) || chr(10) || completion")} / 4503599627370496.0e0
            + length(completion) / 4000.0e0''')} as rm_score
        from v_completions join v_prompts using (prompt_id)""",
    ),
)
def score_completions(spark, sf_dir) -> DataFrame:
    answers = tables.completions(spark, sf_dir).join(tables.prompts(spark, sf_dir), "prompt_id")

    def scorer(prompt, response):
        text = scorer_input(prompt, response)
        return hash52(text) / F.lit(2.0**52) + F.length(response) / F.lit(4000.0)

    scored = rewards.score_completions(answers, scorer)
    return scored.select("doc_id", "run_id", "model_role", r6("rm_score").alias("rm_score"))
