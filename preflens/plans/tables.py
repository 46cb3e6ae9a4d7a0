"""Preference tables derived from the driver's tables, in Spark and in SQL.

The driver's data holds documents, labels, conversations, embeddings and events.
Each function below derives one input table from them; CTES holds the same
derivation for the SQL side. Documents 2k and 2k+1 act as the policy's and the
baseline's answer to prompt k; prompt k belongs to run k mod 9 and to
generation seed (k div 9) mod 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import HASH_SPACE, hash52
from ..operators.pairing import pair_policy_baseline, sides
from ..operators.report import GRID

POLICY_RUNS = [f"{prefix}{value}" for (prefix, _), values in GRID.items() for value in values]
RM_RUNS = {"rm_full": 1.0, "rm_f0.1": 0.1, "rm_f0.5": 0.5}

KEY = ["run_id", "seed", "prompt_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) decided by the parts."""
    return hash52(*parts) / F.lit(HASH_SPACE)


def quotient(column: Column, divisor: int) -> Column:
    return F.call_function("div", column, F.lit(divisor))


def run_of(prompt_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in POLICY_RUNS]), (prompt_id % 9 + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def completions(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """Policy and baseline answers; some get a style marker put in front."""
    doc = F.col("doc_id")
    prompt_id = quotient(doc, 2)
    marker = F.element_at(
        F.array(F.lit("## "), F.lit("- "), F.lit("Certainly! ")), (doc % 7 + 1).cast("int")
    )
    texts = table(spark, sf_dir, "documents") if texts is None else texts
    return texts.select(
        prompt_id.alias("prompt_id"),
        run_of(prompt_id).alias("run_id"),
        (quotient(doc, 18) % 3).alias("seed"),
        F.when(doc % 2 == 0, "policy").otherwise("baseline").alias("model_role"),
        "doc_id",
        F.when(doc % 7 < 3, F.concat(marker, "text")).otherwise(F.col("text")).alias("completion"),
    )


def rm_score(doc_id: Column, completion: Column) -> Column:
    """Stands in for a reward model; one decimal, so that exact ties occur."""
    raw = unit("rm", doc_id) * 4 - 2 + F.length(completion) / F.lit(4000.0)
    return F.floor(raw * 10) / 10


def scores(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    return completions(spark, sf_dir, texts).withColumn(
        "rm_score", rm_score(F.col("doc_id"), F.col("completion"))
    )


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired scores without their texts."""
    narrow = scores(spark, sf_dir).select(*KEY, "model_role", "rm_score")
    return pair_policy_baseline(*sides(narrow), on=KEY, values=["rm_score"])


def raw_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge output as it comes, in both orders; some is null, some pairs were judged once only."""
    answers = F.array(
        *[F.lit(a) for a in ("A", "A", "A", "B", "B", "B", "TIE", " b.", "answer: b", "")]
    )
    shown = completions(spark, sf_dir).where(F.col("model_role") == "policy")
    picked = (hash52(F.col("ord"), F.col("prompt_id")) % 10 + 1).cast("int")
    return (
        shown.select(*KEY)
        .withColumn("ord", F.explode(F.array(F.lit("ab"), F.lit("ba"))))
        .withColumn("raw", F.when(hash52("lost", F.col("ord"), F.col("prompt_id")) % 23 > 0, F.element_at(answers, picked)))
        .where((F.col("ord") == "ab") | (F.col("prompt_id") % 29 != 7))
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, prompt): the benchmark's items dealt over the prompts in turn."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    n_items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1))).scalar()
    policy, _ = sides(completions(spark, sf_dir))
    return (
        policy.select("prompt_id").withColumn("item_id", F.pmod("prompt_id", n_items)).join(items, "item_id").drop("item_id")
    )


def preference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a prompt's two documents is the chosen one, without texts.

    The better labelled one wins, a missing label lying between good and bad;
    equal ones are decided by hash.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc, pair = F.col("doc_id"), F.col("pair_id")
    quality = F.coalesce(F.col("quality").cast("double"), F.lit(0.5))
    both = (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .join(labels, "doc_id", "left")
        .groupBy(quotient(doc, 2).alias("pair_id"))
        .agg(
            F.max(F.when(doc % 2 == 0, quality)).alias("first"),
            F.max(F.when(doc % 2 == 1, quality)).alias("second"),
        )
        .where(F.col("first").isNotNull() & F.col("second").isNotNull())
    )
    place = lambda side, odd: F.struct(F.col(side), hash52("pref", pair * 2 + odd))
    first_wins = place("first", 0) > place("second", 1)
    return both.select(
        "pair_id",
        (pair * 2 + F.when(first_wins, 0).otherwise(1)).alias("chosen_id"),
        (pair * 2 + F.when(first_wins, 1).otherwise(0)).alias("rejected_id"),
        F.when(hash52("split", pair) % 10 < 3, "test_prefs").otherwise("train_prefs").alias("split"),
    )


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, chosen and rejected message lists, with a split column."""
    answer = lambda side: completions(spark, sf_dir).select(
        F.col("doc_id").alias(f"{side}_id"), F.col("completion").alias(side)
    )
    message = lambda role, text: F.struct(
        F.lit(role).alias("role"), F.col(text).alias("content")
    )
    return (
        preference_ids(spark, sf_dir)
        .join(prompts(spark, sf_dir).withColumnRenamed("prompt_id", "pair_id"), "pair_id")
        .join(answer("chosen"), "chosen_id")
        .join(answer("rejected"), "rejected_id")
        .select(
            "pair_id",
            "prompt",
            *[
                F.array(message("user", "prompt"), message("assistant", side)).alias(side)
                for side in ("chosen", "rejected")
            ],
            "chosen_id",
            "rejected_id",
            "split",
        )
    )


def rm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three reward models; more training data, better sight of quality. One misses some, one gives NaN."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    share = F.create_map(*[F.lit(v) for pair in RM_RUNS.items() for v in pair])
    quality = F.coalesce(F.col("quality").cast("double"), F.lit(0.5))
    score = unit(F.col("run_id"), F.col("doc_id")) + quality * share[F.col("run_id")]
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .join(labels, "doc_id", "left")
        .withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in RM_RUNS])))
        .where((F.col("run_id") != "rm_f0.5") | (F.col("doc_id") % 53 != 10))
        .select(
            "run_id",
            "doc_id",
            F.when((F.col("run_id") == "rm_f0.1") & (F.col("doc_id") % 41 == 3), float("nan"))
            .otherwise(F.floor(score * 50) / 50)
            .alias("rm_score"),
        )
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as the samples of one prompt, with the run's group size."""
    run = F.concat(F.lit("grpo_g"), F.element_at(F.array(F.lit(4), F.lit(8), F.lit(16)), F.col("slot")))
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "assistant")
        .withColumn("slot", (F.col("conv_id") % 3 + 1).cast("int"))
        .select(
            run.alias("run_id"),
            F.col("conv_id").alias("prompt_id"),
            F.col("turn").alias("sample_id"),
            F.col("text").alias("completion"),
            (unit("rollout", F.col("conv_id"), F.col("turn")) * 4 - 2).alias("rm_score"),
        )
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors as policy and reference logits of one position."""
    vectors = table(spark, sf_dir, "embeddings")
    policy = vectors.where(F.col("vec_id") % 2 == 0)
    reference = vectors.where(F.col("vec_id") % 2 == 1).select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("reference")
    )
    prompt_id = quotient(F.col("vec_id"), 8)
    prompt_tokens = hash52("prompt_tokens", prompt_id) % 1700
    return policy.join(reference, "vec_id").select(
        run_of(prompt_id).alias("run_id"),
        prompt_id.alias("prompt_id"),
        (quotient(F.col("vec_id"), 2) % 4).alias("pos"),
        prompt_tokens.alias("prompt_tokens"),
        F.least(F.lit(1536), prompt_tokens + 4).alias("total_tokens"),
        F.col("embedding").alias("policy"),
        "reference",
    )


def logits_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logits with the vocabulary's 64 entries in parts of 10, 20, 30 and 4."""
    bounds = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(a).alias("a"), F.lit(n).alias("n"))
                       for i, (a, n) in enumerate([(1, 10), (11, 20), (31, 30), (61, 4)])])
    cut = lambda side: F.slice(side, F.col("_p.a"), F.col("_p.n")).alias(side)
    rows = logits(spark, sf_dir).withColumn("_p", F.explode(bounds))
    return rows.select(
        "run_id", "prompt_id", "pos", "prompt_tokens", "total_tokens", "_p.shard", cut("policy"), cut("reference")
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long log with up to three metrics per step."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        quotient(F.col("event_id"), 3).alias("step"),
        F.concat(F.lit("metric"), (F.col("event_id") % 3).cast("string")).alias("metric"),
        "value",
    )


def sequence_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of whole answers under policy and reference."""
    name = {"pc": "pi_chosen", "pr": "pi_rejected", "rc": "ref_chosen", "rr": "ref_rejected"}
    ids = F.col("chosen_id"), F.col("rejected_id")
    return preference_ids(spark, sf_dir).select(
        "pair_id",
        "split",
        *[(unit(code, *ids) * F.lit(-50.0)).alias(column) for code, column in name.items()],
    )


def runs(spark: SparkSession) -> DataFrame:
    """The run registry: nine policies and three reward models."""
    rows = []
    for (prefix, axis), values in GRID.items():
        for value in values:
            run = f"{prefix}{value}"
            stage = run.split("_")[0]
            beta = float(value) if axis == "beta" else 0.04
            group = None if stage == "dpo" else int(value) if axis == "num_generations" else 8
            path = None
            if stage == "grpo":
                path = f"runs/rm_f{value}" if axis == "rm_fraction" else "runs/rm_full"
            rows.append((run, stage, beta, group, None, path, f"runs/{run}"))
    for run, share in RM_RUNS.items():
        rows.append((run, "rm", None, None, share, None, f"runs/{run}"))
    return spark.createDataFrame(
        rows,
        "run_id string, stage string, beta double, num_generations bigint, "
        "rm_pair_fraction double, reward_model_path string, output_dir string",
    )


# --- the same tables in SQL -----------------------------------------------------


def _hash(*parts: str) -> str:
    text = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 13))::bigint"


def _unit(*parts: str) -> str:
    return f"({_hash(*parts)} / 4503599627370496.0e0)"


sql_hash = _hash
sql_unit = _unit


def sql_r6(expression: str) -> str:
    return f"(round({expression}, 6) + 0.0e0)"


def sql_mean(value: str, where: str = "true") -> str:
    """`exact_mean`: added as decimals, unless some term is none."""
    return f"""case when bool_or(not coalesce(abs({value}) < 1e15, true)) filter ({where}) then avg({value}) filter ({where})
      else avg(case when abs({value}) < 1e15 then ({value})::decimal(38, 12) end) filter ({where}) end"""


def sql_run(prompt_id: str) -> str:
    names = ", ".join(f"'{r}'" for r in POLICY_RUNS)
    return f"([{names}])[({prompt_id}) % 9 + 1]"


_RM_SHARE = " ".join(f"when '{r}' then {share}e0" for r, share in RM_RUNS.items())

# name -> (tables it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "v_completions": (
        (),
        f"""select doc_id // 2 as prompt_id, {sql_run('doc_id // 2')} as run_id,
            (doc_id // 18) % 3 as seed,
            case when doc_id % 2 = 0 then 'policy' else 'baseline' end as model_role, doc_id,
            case doc_id % 7 when 0 then '## ' when 1 then '- ' when 2 then 'Certainly! ' else '' end
              || text as completion
          from documents""",
    ),
    "v_scores": (
        ("v_completions",),
        f"""select *, floor(({_unit("'rm'", 'doc_id')} * 4 - 2 + length(completion) / 4000.0e0) * 10) / 10
              as rm_score
          from v_completions""",
    ),
    "v_pairs": (
        ("v_scores",),
        """select p.run_id, p.seed, p.prompt_id, p.completion as completion_policy,
            b.completion as completion_baseline, p.rm_score as rm_score_policy,
            b.rm_score as rm_score_baseline
          from v_scores p join v_scores b on p.run_id = b.run_id and p.seed = b.seed
            and p.prompt_id = b.prompt_id and p.model_role = 'policy' and b.model_role = 'baseline'""",
    ),
    "v_verdicts": (
        ("v_completions",),
        f"""select run_id, seed, prompt_id, ord,
            case when {_hash("'lost'", 'ord', 'prompt_id')} % 23 > 0 then
              (['A', 'A', 'A', 'B', 'B', 'B', 'TIE', ' b.', 'answer: b', ''])
                [{_hash('ord', 'prompt_id')} % 10 + 1] end as raw
          from v_completions, (values ('ab'), ('ba')) as o(ord)
          where model_role = 'policy' and (ord = 'ab' or prompt_id % 29 <> 7)""",
    ),
    "v_parsed": (
        ("v_verdicts",),
        """select *, case when raw is null then null
            when regexp_replace(upper(raw), '[^A-Za-z]', '', 'g') like 'A%' then 'A'
            when regexp_replace(upper(raw), '[^A-Za-z]', '', 'g') like 'B%' then 'B'
            else 'TIE' end as verdict
          from v_verdicts""",
    ),
    "v_judged": (
        ("v_parsed",),
        """select *, case when verdict_ab is null or verdict_ba is null then null
              when verdict_ab = 'A' and verdict_ba = 'B' then 1.0e0
              when verdict_ab = 'B' and verdict_ba = 'A' then 0.0e0 else 0.5e0 end as score,
            verdict_ab || verdict_ba in ('AB', 'BA', 'TIETIE') as consistent
          from (select run_id, seed, prompt_id, max(verdict) filter (ord = 'ab') as verdict_ab,
              max(verdict) filter (ord = 'ba') as verdict_ba
            from v_parsed group by run_id, seed, prompt_id)""",
    ),
    "v_rm_judged": (
        ("v_pairs",),
        """select *, case when verdict_ab = 'A' and verdict_ba = 'B' then 1.0e0
              when verdict_ab = 'B' and verdict_ba = 'A' then 0.0e0 else 0.5e0 end as score,
            verdict_ab || verdict_ba in ('AB', 'BA', 'TIETIE') as consistent
          from (select *,
            case when isnan(rm_score_policy - rm_score_baseline) then 'B'
              when abs(rm_score_policy - rm_score_baseline) < 1e-3 then 'TIE'
              when rm_score_policy > rm_score_baseline then 'A' else 'B' end as verdict_ab,
            case when isnan(rm_score_baseline - rm_score_policy) then 'B'
              when abs(rm_score_baseline - rm_score_policy) < 1e-3 then 'TIE'
              when rm_score_baseline > rm_score_policy then 'A' else 'B' end as verdict_ba
            from v_pairs)""",
    ),
    "v_prompts": (
        ("v_completions",),
        """select prompt_id, b.text as prompt
          from v_completions join benchmark b
            on b.item_id = prompt_id % (select count(*) from benchmark)
          where model_role = 'policy'""",
    ),
    "v_pref": (
        (),
        f"""select l.doc_id // 2 as pair_id,
            case when (l.q, l.h) > (r.q, r.h) then l.doc_id else r.doc_id end as chosen_id,
            case when (l.q, l.h) > (r.q, r.h) then r.doc_id else l.doc_id end as rejected_id,
            case when {_hash("'split'", 'l.doc_id // 2')} % 10 < 3 then 'test_prefs'
              else 'train_prefs' end as split
          from (select doc_id, coalesce(quality::double, 0.5e0) as q, {_hash("'pref'", 'doc_id')} as h
              from documents left join labels using (doc_id)) l
          join (select doc_id, coalesce(quality::double, 0.5e0) as q, {_hash("'pref'", 'doc_id')} as h
              from documents left join labels using (doc_id)) r
            on r.doc_id = l.doc_id + 1 and l.doc_id % 2 = 0""",
    ),
    "v_pref_texts": (
        ("v_pref", "v_prompts", "v_completions"),
        """select v.*, prompt, c.completion as chosen, r.completion as rejected
          from v_pref v join v_prompts p on p.prompt_id = v.pair_id
            join v_completions c on c.doc_id = v.chosen_id
            join v_completions r on r.doc_id = v.rejected_id""",
    ),
    "v_rm_scores": (
        (),
        f"""select run_id, doc_id, case when run_id = 'rm_f0.1' and doc_id % 41 = 3 then 'nan'::double
              else floor(({_unit('run_id', 'doc_id')}
              + coalesce(quality::double, 0.5e0) * case run_id {_RM_SHARE} end) * 50) / 50 end as rm_score
          from documents left join labels using (doc_id),
            (values {', '.join(f"('{r}')" for r in RM_RUNS)}) as m(run_id)
          where run_id <> 'rm_f0.5' or doc_id % 53 <> 10""",
    ),
    "v_rm_pairs": (
        ("v_pref", "v_rm_scores"),
        """select s.run_id, v.pair_id, v.split, max(rm_score) filter (doc_id = chosen_id) as score_chosen,
            max(rm_score) filter (doc_id = rejected_id) as score_rejected
          from v_pref v join v_rm_scores s on s.doc_id in (v.chosen_id, v.rejected_id)
          group by s.run_id, v.pair_id, v.split""",
    ),
    "v_rm_eval": (
        ("v_rm_pairs",),
        """select run_id,
            avg(case when score_chosen is null or score_rejected is null then null
              when isnan(score_chosen) or isnan(score_rejected) then 0.0e0
              when score_chosen <> score_rejected
              then (score_chosen > score_rejected)::int::double end) as eval_accuracy,
            count(*) filter (score_chosen is not null and score_rejected is not null) as n_pairs,
            count(*) filter (score_chosen = score_rejected and not isnan(score_chosen)) as n_ties,
            count(*) filter (score_chosen is null or score_rejected is null) as n_unscored
          from v_rm_pairs where split = 'test_prefs' group by run_id""",
    ),
    "v_rollouts": (
        (),
        f"""select 'grpo_g' || ([4, 8, 16])[conv_id % 3 + 1] as run_id, conv_id as prompt_id,
            turn as sample_id, text as completion,
            {_unit("'rollout'", 'conv_id', 'turn')} * 4 - 2 as rm_score
          from conversations where role = 'assistant'""",
    ),
    "v_rewards": (
        ("v_rollouts",),
        """select *, rm_score + 0.5e0
              * greatest(-1.0e0, -abs(length(completion) - 1200) / 1200.0e0) as reward
          from v_rollouts""",
    ),
    "v_logits": (
        (),
        f"""select {sql_run('p.vec_id // 8')} as run_id, p.vec_id // 8 as prompt_id,
            (p.vec_id // 2) % 4 as pos,
            {_hash("'prompt_tokens'", 'p.vec_id // 8')} % 1700 as prompt_tokens,
            least(1536, {_hash("'prompt_tokens'", 'p.vec_id // 8')} % 1700 + 4) as total_tokens,
            p.vec_id, p.embedding as policy, r.embedding as reference
          from embeddings p join embeddings r on r.vec_id = p.vec_id + 1 and p.vec_id % 2 = 0""",
    ),
    "v_token_kl": (
        ("v_logits",),
        """select run_id, vec_id, sum(exp(lp) * (lp - lq)) as kl
          from (select run_id, vec_id,
              x - ln(sum(exp(x)) over (partition by vec_id)) as lp,
              y - ln(sum(exp(y)) over (partition by vec_id)) as lq
            from (select run_id, vec_id, unnest(policy)::double as x, unnest(reference)::double as y
              from v_logits where prompt_tokens + pos < total_tokens))
          group by run_id, vec_id""",
    ),
    "v_kl": (
        ("v_token_kl",),
        """select run_id, avg(kl) as kl_from_reference, count(*) as tokens
          from v_token_kl group by run_id""",
    ),
    "v_logprobs": (
        ("v_pref",),
        "select pair_id, split, "
        + ", ".join(
            f"-50.0e0 * {_unit(repr(code), 'chosen_id', 'rejected_id')} as {column}"
            for code, column in (
                ("pc", "pi_chosen"),
                ("pr", "pi_rejected"),
                ("rc", "ref_chosen"),
                ("rr", "ref_rejected"),
            )
        )
        + " from v_pref",
    ),
    "v_grid": (
        (),
        "select * from (values "
        + ", ".join(
            f"('{prefix}{value}', '{axis}', {value}e0)"
            for (prefix, axis), values in GRID.items()
            for value in values
        )
        + ") as t(run_id, axis, axis_value)",
    ),
    "v_runs": (
        ("v_grid",),
        f"""select run_id, split_part(run_id, '_', 1) as stage,
            case when axis = 'beta' then axis_value else 0.04e0 end as beta,
            case when run_id like 'dpo%' then null when axis = 'num_generations'
              then axis_value::bigint else 8 end as num_generations,
            null::double as rm_pair_fraction,
            case when run_id like 'dpo%' then null when axis = 'rm_fraction'
              then 'runs/rm_f' || axis_value else 'runs/rm_full' end as reward_model_path,
            'runs/' || run_id as output_dir
          from v_grid
          union all
          select run_id, 'rm', null, null, share, null, 'runs/' || run_id
          from (values {', '.join(f"('{r}', {share}e0)" for r, share in RM_RUNS.items())}) as m(run_id, share)""",
    ),
}


def with_tables(names: str, select: str) -> str:
    """`select` preceded by the derived tables it reads and those they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    return "with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in ordered) + "\n" + select
