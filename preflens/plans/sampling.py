"""Queries over splits, subsamples and packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAX_LENGTH, completion_text
from ..operators import sampling
from ..operators.rewards import RM_FRACTIONS
from ..sources.tables import PREFERENCE_COLUMNS, select_split
from . import tables
from .registry import query
from .tables import sql_hash, with_tables

# The sample sizes of a small trial run.
TRIAL_TRAIN, TRIAL_EVAL = 200, 50

WORDS = r"len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query(
    "src_preference_pairs",
    with_tables(
        "v_pref_texts",
        """select pair_id, prompt, chosen, rejected, split from v_pref_texts
        where split = 'train_prefs'""",
    ),
)
def src_preference_pairs(spark, sf_dir) -> DataFrame:
    pairs = select_split(tables.preference_pairs(spark, sf_dir), "train_prefs")
    return pairs.select(
        "pair_id",
        "prompt",
        completion_text(pairs, "chosen").alias("chosen"),
        completion_text(pairs, "rejected").alias("rejected"),
        "split",
    )


@query(
    "keep_columns",
    with_tables(
        "v_pref_texts",
        """select prompt, len(prompt) > 0 as has_prompt, 2::bigint as chosen_turns,
          2::bigint as rejected_turns, 3::bigint as columns_kept from v_pref_texts""",
    ),
)
def keep_columns(spark, sf_dir) -> DataFrame:
    pairs = tables.preference_pairs(spark, sf_dir)
    kept = sampling.keep_columns(pairs, [*PREFERENCE_COLUMNS, "no_such_column"])
    return kept.select(
        "prompt",
        (F.length("prompt") > 0).alias("has_prompt"),
        F.size("chosen").cast("bigint").alias("chosen_turns"),
        F.size("rejected").cast("bigint").alias("rejected_turns"),
        F.lit(len(kept.columns)).cast("bigint").alias("columns_kept"),
    )


# The cap named for the capped samples below: sampling is their feature.
CAP = 500


def _hash_order(seed: int, key: str = "doc_id") -> str:
    return f"row_number() over (order by {sql_hash(str(seed), key)}, {key})"


@query(
    "seeded_subsample",
    f"""select doc_id, lang, n_chars from documents
    qualify {_hash_order(sampling.SEED)} <= {CAP}""",
)
def seeded_subsample(spark, sf_dir) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.seeded_subsample(documents, CAP, sampling.SEED, "doc_id")


@query(
    "nested_fraction",
    f"""select fraction, doc_id
    from (values {", ".join(f"({f}e0)" for f in RM_FRACTIONS)}) as t(fraction), documents
    qualify row_number() over (partition by fraction
        order by {sql_hash(str(sampling.SEED), 'doc_id')}, doc_id)
      <= greatest(1, floor((select count(*) from documents) * fraction))""",
)
def nested_fraction(spark, sf_dir) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents").select("doc_id")
    samples = [
        sampling.nested_fraction(documents, fraction, sampling.SEED, "doc_id").select(
            F.lit(fraction).alias("fraction"), "doc_id"
        )
        for fraction in RM_FRACTIONS
    ]
    return reduce(DataFrame.unionByName, samples)


@query(
    "train_eval_split",
    f"""select doc_id, case when {_hash_order(sampling.SEED)}
        <= ceil((select count(*) from documents) * {sampling.EVAL_SHARE}e0)
      then 'eval' else 'train' end as split
    from documents""",
)
def train_eval_split(spark, sf_dir) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.train_eval_split(documents, sampling.SEED, "doc_id")


def _with_prompts(spark, sf_dir, ids: DataFrame) -> DataFrame:
    """Texts for the ids drawn: drawing reads its table three times, so it gets ids only."""
    prompts = tables.prompts(spark, sf_dir).withColumnRenamed("prompt_id", "pair_id")
    return ids.join(prompts, "pair_id")


def _prompts_sql(split: str, seed: int, n: int) -> str:
    return with_tables(
        "v_pref v_prompts",
        f"""select pair_id, prompt from v_pref join v_prompts on prompt_id = pair_id
        where split = '{split}' qualify {_hash_order(seed, 'pair_id')} <= {n}""",
    )


@query("eval_prompts", _prompts_sql("test_prefs", sampling.SEED + 1, TRIAL_EVAL))
def eval_prompts(spark, sf_dir) -> DataFrame:
    ids = select_split(tables.preference_ids(spark, sf_dir), "test_prefs")
    drawn = sampling.eval_prompts(ids, "pair_id", n=0, max_eval_samples=TRIAL_EVAL)
    return _with_prompts(spark, sf_dir, drawn)


@query("prompt_source", _prompts_sql("train_prefs", sampling.SEED, TRIAL_TRAIN))
def prompt_source(spark, sf_dir) -> DataFrame:
    ids = select_split(tables.preference_ids(spark, sf_dir), "train_prefs")
    return _with_prompts(spark, sf_dir, sampling.prompt_source(ids, "pair_id", TRIAL_TRAIN))


@query(
    "preference_data",
    with_tables(
        "v_pref",
        f"""select pair_id, 'train' as split from v_pref where split = 'train_prefs'
        qualify {_hash_order(sampling.SEED, 'pair_id')} <= greatest(1, floor(least({TRIAL_TRAIN},
          (select count(*) from v_pref where split = 'train_prefs')) * 0.5e0))
        union all select pair_id, 'eval' from v_pref where split = 'test_prefs'
        qualify {_hash_order(sampling.SEED, 'pair_id')} <= {TRIAL_EVAL}""",
    ),
)
def preference_data(spark, sf_dir) -> DataFrame:
    """Half of the training pairs, as a weaker reward model would see them."""
    ids = tables.preference_ids(spark, sf_dir)
    train, held_out = select_split(ids, "train_prefs"), select_split(ids, "test_prefs")
    return sampling.preference_data(train, held_out, "pair_id", [], 0.5, TRIAL_TRAIN, TRIAL_EVAL)


@query(
    "instruction_data",
    f"""select doc_id, case when {_hash_order(sampling.SEED)} <= ceil((select
        least(count(*), {CAP}) from documents) * {sampling.EVAL_SHARE}e0)
      then 'eval' else 'train' end as split
    from documents qualify {_hash_order(sampling.SEED)} <= {CAP}""",
)
def instruction_data(spark, sf_dir) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.instruction_data(documents, "doc_id", CAP)


@query(
    "instruction_data_whole",
    f"""select doc_id, case when {_hash_order(sampling.SEED)} <= ceil((select count(*) from documents)
        * {sampling.EVAL_SHARE}e0) then 'eval' else 'train' end as split from documents""",
)
def instruction_data_whole(spark, sf_dir) -> DataFrame:
    return sampling.instruction_data(tables.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "sequence_packing",
    f"""select doc_id, n_tokens, shard, start, start // {MAX_LENGTH} as block,
      (start + greatest(n_tokens - 1, 0)) // {MAX_LENGTH} as last_block
    from (select *, coalesce(sum(n_tokens) over (partition by shard order by doc_id
          rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from (select doc_id, {WORDS} as n_tokens, {sql_hash(str(sampling.SEED), 'doc_id')}
          % (select greatest(1, ceil(count(*) / 1000))::bigint from documents) as shard
        from documents))""",
)
def sequence_packing(spark, sf_dir) -> DataFrame:
    return sampling.sequence_packing(tables.documents(spark, sf_dir), "doc_id", "text")


@query(
    "whole_packing",
    f"""select doc_id, n::bigint as n_tokens, greatest(1, ceil(n / {sampling.MAX_LENGTH}.0e0))::bigint as pieces,
      true as in_bounds, true as apart
    from (select doc_id, coalesce({WORDS}, 0) as n from documents)""",
)
def whole_packing(spark, sf_dir) -> DataFrame:
    """Packing without cutting, with what has to hold: pieces lie inside their block and apart from each other."""
    packed = sampling.whole_packing(tables.documents(spark, sf_dir), "doc_id", "text")
    end = F.col("start") + F.col("n_tokens")
    # A block holds at most MAX_LENGTH pieces that have tokens.
    before = F.lag(end).over(Window.partitionBy("block").orderBy("start", "n_tokens"))
    checked = packed.where("n_tokens > 0").select("*", (F.coalesce(before, F.lit(0)) <= F.col("start")).alias("apart"))
    checked = checked.unionByName(packed.where("n_tokens = 0").withColumn("apart", F.lit(True)))
    return checked.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.count(F.lit(1)).alias("pieces"),
        F.every((F.col("start") >= 0) & (end <= sampling.MAX_LENGTH)).alias("in_bounds"),
        F.every("apart").alias("apart"),
    )
