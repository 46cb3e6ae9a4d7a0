"""Queries over text features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.verdicts import parse_verdict
from ..operators import diagnostics
from . import tables
from .registry import query, r6, rounded
from .tables import sql_r6, with_tables

# The patterns in RE2 syntax.
WORD = r"[\p{L}\p{N}_]+"
EDGE = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"


def sql_words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}')"


def sql_grams(words: str, n: int = 4) -> str:
    """Neighbouring words zipped together; slicing at each place would be quadratic."""
    shifted = ", ".join([words, *[f"{words}[{k + 1}:]" for k in range(1, n)]])
    joined = " || ' ' || ".join(f"x[{k + 1}]" for k in range(n))
    whole = f"list_zip({shifted})[1:greatest(len({words}) - {n - 1}, 0)]"
    return f"list_transform({whole}, lambda x: {joined})"


def sql_distinct(grams: str) -> str:
    return f"case when len({grams}) = 0 then 1.0e0 else len(list_distinct({grams})) / len({grams})::double end"


def sql_distinct_of(column: str, source: str, columns: str) -> str:
    """A table of `columns` and distinct_4 of a text column."""
    return (
        f"select {columns}, {sql_distinct('grams')} as distinct_4 from (select {columns}, "
        f"{sql_grams('words')} as grams from (select {columns}, {sql_words(column)} as words from {source}))"
    )


def sql_flag(pattern: str, column: str = "completion") -> str:
    return f"regexp_matches({column}, '{pattern}')::int::double"


STYLE_SQL = {
    "header_rate": sql_flag(rf"(?m)^{SPACE}{{0,3}}#{{1,6}}{SPACE}"),
    "bullet_rate": sql_flag(rf"(?m)^{SPACE}*[-*+]{SPACE}"),
    "enthusiasm_rate": sql_flag(rf"(?i)(^|{EDGE})({text.ENTHUSIASM_PHRASES})($|{EDGE})"),
    "mean_chars": "length(completion)",
}


def _texts(spark, sf_dir) -> DataFrame:
    return tables.completions(spark, sf_dir, tables.documents(spark, sf_dir))


@query(
    "word_tokens",
    f"""select doc_id, len(words)::bigint as n_tokens, array_to_string(words, ' ') as tokens
    from (select doc_id, {sql_words('text')} as words from documents)""",
)
def word_tokens(spark, sf_dir) -> DataFrame:
    words = tables.documents(spark, sf_dir).select("doc_id", text.word_tokens(F.col("text")).alias("words"))
    return words.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_tokens"),
        F.array_join("words", " ").alias("tokens"),
    )


@query(
    "distinct_n",
    f"""select doc_id, len(grams)::bigint as n_grams, {sql_r6(sql_distinct('grams'))} as distinct_4
    from (select doc_id, {sql_grams('words')} as grams
      from (select doc_id, {sql_words('text')} as words from documents))""",
)
def distinct_n(spark, sf_dir) -> DataFrame:
    counts = tables.documents(spark, sf_dir).select("doc_id", text.ngram_counts(F.col("text")).alias("counts"))
    return counts.select(
        "doc_id",
        F.col("counts.total").cast("bigint").alias("n_grams"),
        r6(text.distinct_share(F.col("counts"))).alias("distinct_4"),
    )


@query(
    "repetition_penalty",
    f"""select doc_id, {sql_r6('distinct_4 - 1')} as repetition_penalty
    from ({sql_distinct_of('text', 'documents', 'doc_id')})""",
)
def repetition_penalty(spark, sf_dir) -> DataFrame:
    return tables.documents(spark, sf_dir).select(
        "doc_id", r6(text.repetition_penalty(F.col("text"))).alias("repetition_penalty")
    )


@query(
    "length_penalty",
    f"""select doc_id, length(text)::bigint as chars,
      {sql_r6('greatest(-1.0e0, -abs(length(text) - 1200) / 1200.0e0)')} as length_penalty
    from documents""",
)
def length_penalty(spark, sf_dir) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length("text").cast("bigint").alias("chars"),
        r6(text.length_penalty(F.col("text"))).alias("length_penalty"),
    )


@query(
    "stylistic_tells",
    with_tables(
        "v_completions",
        "select run_id, model_role, "
        + ", ".join(f"{sql_r6(f'avg({e})')} as {name}" for name, e in STYLE_SQL.items())
        + " from v_completions group by run_id, model_role",
    ),
)
def stylistic_tells(spark, sf_dir) -> DataFrame:
    tells = diagnostics.stylistic_tells(_texts(spark, sf_dir), ["run_id", "model_role"])
    return rounded(tells, *STYLE_SQL)


@query(
    "distinct_n_by_run",
    with_tables(
        "v_completions",
        f"""select run_id, model_role, {sql_r6('avg(distinct_4)')} as distinct_4
        from ({sql_distinct_of('completion', 'v_completions', 'run_id, model_role')})
        group by run_id, model_role""",
    ),
)
def distinct_n_by_run(spark, sf_dir) -> DataFrame:
    means = diagnostics.distinct_n_by_run(_texts(spark, sf_dir), ["run_id", "model_role"])
    return rounded(means, "distinct_4")


@query(
    "last_message_text",
    with_tables(
        "v_pref_texts",
        """select pair_id, chosen, length(chosen)::bigint as chosen_chars, rejected,
          length(rejected)::bigint as rejected_chars from v_pref_texts""",
    ),
)
def last_message_text(spark, sf_dir) -> DataFrame:
    pairs = tables.preference_pairs(spark, sf_dir)
    texts = pairs.select(
        "pair_id", *[text.completion_text(pairs, side).alias(side) for side in ("chosen", "rejected")]
    )
    return texts.select(
        "*",
        *[F.length(s).cast("bigint").alias(f"{s}_chars") for s in ("chosen", "rejected")],
    )


@query(
    "chat_render",
    """select conv_id, turn, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
      || '<|im_start|>assistant' || chr(10) as rendered
    from conversations where role = 'user'""",
)
def chat_render(spark, sf_dir) -> DataFrame:
    turns = tables.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select("conv_id", "turn", text.chat_prompt(F.col("text")).alias("rendered"))


@query(
    "chat_render_messages",
    with_tables(
        "v_pref_texts",
        """select pair_id, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10)
          || '<|im_start|>assistant' || chr(10) || chosen || '<|im_end|>' || chr(10) as rendered
        from v_pref_texts""",
    ),
)
def chat_render_messages(spark, sf_dir) -> DataFrame:
    pairs = tables.preference_pairs(spark, sf_dir)
    return pairs.select("pair_id", text.chat_messages(F.col("chosen")).alias("rendered"))


@query(
    "scorer_input",
    with_tables(
        "v_completions v_prompts",
        """select c.doc_id, prompt || chr(10) || chr(10) || completion as scorer_input
        from v_completions c join v_prompts p on p.prompt_id = c.prompt_id""",
    ),
)
def scorer_input(spark, sf_dir) -> DataFrame:
    answers = tables.completions(spark, sf_dir).select("prompt_id", "doc_id", "completion")
    return answers.join(tables.prompts(spark, sf_dir), "prompt_id").select(
        "doc_id", text.scorer_input(F.col("prompt"), F.col("completion")).alias("scorer_input")
    )


@query(
    "length_caps",
    f"""select doc_id, len(w)::bigint as n_tokens, len(w) > {text.MAX_LENGTH} as too_long,
      array_to_string(w[1:{text.MAX_LENGTH}], ' ') as example,
      array_to_string(w[greatest(len(w) - {text.MAX_PROMPT_LENGTH} + 1, 1):len(w)], ' ') as prompt,
      array_to_string(w[1:{text.MAX_COMPLETION_LENGTH}], ' ') as answer,
      least(len(w), {text.MAX_SCORER_LENGTH})::bigint as scorer_tokens
    from (select doc_id, {sql_words('text')} as w from documents)""",
)
def length_caps(spark, sf_dir) -> DataFrame:
    words = F.col("words")
    return (
        tables.documents(spark, sf_dir)
        .select("doc_id", text.word_tokens(F.col("text")).alias("words"))
        .select(
            "doc_id",
            F.size(words).cast("bigint").alias("n_tokens"),
            (F.size(words) > text.MAX_LENGTH).alias("too_long"),
            F.array_join(text.cap_head(words, text.MAX_LENGTH), " ").alias("example"),
            F.array_join(text.cap_tail(words, text.MAX_PROMPT_LENGTH), " ").alias("prompt"),
            F.array_join(text.cap_head(words, text.MAX_COMPLETION_LENGTH), " ").alias("answer"),
            F.size(text.cap_head(words, text.MAX_SCORER_LENGTH)).cast("bigint").alias("scorer_tokens"),
        )
    )


@query(
    "verdict_normalise",
    with_tables(
        "v_parsed",
        "select raw, verdict, count(*) as n from v_parsed group by raw, verdict",
    ),
)
def verdict_normalise(spark, sf_dir) -> DataFrame:
    verdicts = tables.raw_verdicts(spark, sf_dir).select("raw", parse_verdict(F.col("raw")).alias("verdict"))
    return verdicts.groupBy("raw", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ngrams",
    f"""select doc_id, len(grams)::bigint as n_grams, grams[1] as first_gram, grams[-1] as last_gram,
      md5(array_to_string(grams, '|')) as all_grams
    from (select doc_id, {sql_grams('words')} as grams
      from (select doc_id, {sql_words('text')} as words from documents))""",
)
def ngrams(spark, sf_dir) -> DataFrame:
    """Every 4-gram in its place, the whole list told by its MD5."""
    grams = tables.documents(spark, sf_dir).select("doc_id", text.ngrams(F.col("text")).alias("grams"))
    return grams.select(
        "doc_id",
        F.size("grams").cast("bigint").alias("n_grams"),
        F.get("grams", F.lit(0)).alias("first_gram"),
        F.try_element_at("grams", F.lit(-1)).alias("last_gram"),
        F.md5(F.array_join("grams", "|")).alias("all_grams"),
    )
