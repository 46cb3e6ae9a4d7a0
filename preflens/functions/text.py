"""Text features of completions, chat rendering and length caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import let

# Word characters and white space as Python's `re` defines them
# for str (Java's \w and \s are ASCII only).
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"

# The three style markers. (?d) makes '^' match after \n only.
HEADER = rf"(?md)^{SPACE}{{0,3}}#{{1,6}}{SPACE}"
BULLET = rf"(?md)^{SPACE}*[-*+]{SPACE}"
ENTHUSIASM_PHRASES = "certainly|absolutely|great question|happy to help"
ENTHUSIASM = rf"(?iu)(?:^|{NOT_WORD})(?:{ENTHUSIASM_PHRASES})(?:$|{NOT_WORD})"

# Defaults of the reward shaping terms and of the audit rows.
TARGET_CHARS = 1200
NGRAM = 4
PROMPT_CLIP = 200

# Token limits.
MAX_LENGTH = 1536
MAX_PROMPT_LENGTH = 768
MAX_COMPLETION_LENGTH = 512
MAX_SCORER_LENGTH = 2048

# The ChatML layout; a model's own template goes in its place.
CHAT_TURN = "<|im_start|>%s\n%s<|im_end|>\n"
CHAT_GENERATION_HEADER = "<|im_start|>assistant\n"


def word_tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def token_ngrams(tokens: Column, n: int) -> Column:
    """n-grams of a token array, each joined by a blank (tokens hold none).

    `tokens` has to be a plain column or a lambda variable, since it is read at
    every position. Positions are read one by one: `slice` copies the whole
    array on every call, which is quadratic in the length of the text.
    """

    def gram(start: Column) -> Column:
        pieces = [F.get(tokens, start)]
        for offset in range(1, n):
            pieces += [F.lit(" "), F.get(tokens, start + offset)]
        return F.concat(*pieces)

    starts = F.sequence(F.lit(0), F.size(tokens) - n)
    # Without the guard, sequence(0, -1) would count down.
    return F.when(F.size(tokens) >= n, F.transform(starts, gram)).otherwise(
        F.array().cast("array<string>")
    )


def ngrams(text: Column, n: int = NGRAM) -> Column:
    return let(word_tokens(text), lambda tokens: token_ngrams(tokens, n))


def _paired(items: Column, step: int) -> Column:
    """A 64-bit hash of every entry with the one `step` places on; the last `step` hashes mean nothing."""
    return let(
        items,
        lambda x: F.zip_with(
            x, F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b)
        ),
    )


def _ngram_hashes(tokens: Column, n: int) -> Column:
    """One hash per n-gram, from zips of windows whose width doubles."""
    hashes, width = _paired(tokens, 1), 2
    while width < n:
        step = min(width, n - width)
        hashes, width = _paired(hashes, step), width + step
    return F.slice(hashes, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))


def _distinct_ngrams(tokens: Column, hashes: Column, n: int) -> Column:
    """Number of different n-grams. Only n-grams whose hash repeats are compared by their words."""

    def again(s: Column) -> Column:
        """Places of the hashes that occur more than once, from (hash, place) in order."""
        near = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1))

    def words(place: Column) -> Column:
        return F.concat_ws(" ", *[F.get(tokens, place + k) for k in range(n)])

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(let(ordered, again), lambda r: F.size(F.array_distinct(F.transform(r, lambda x: words(x["i"])))) - F.size(r))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.size(h)).otherwise(F.size(h) + repeated)

    return let(hashes, counted)


def ngram_counts(text: Column, n: int = NGRAM) -> Column:
    """A struct of the numbers of n-grams (`total`) and of different ones (`distinct`).

    N-grams are hashes beside the tokens, not strings; memory is linear in the text.
    """
    return let(word_tokens(text), lambda tokens: _token_ngram_counts(tokens, n))


def _token_ngram_counts(tokens: Column, n: int) -> Column:
    total = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    different = F.size(F.array_distinct(tokens)) if n == 1 else _distinct_ngrams(tokens, _ngram_hashes(tokens, n), n)
    return F.struct(total.alias("total"), different.alias("distinct"))


def distinct_share(counts: Column) -> Column:
    """Share of different n-grams; 1.0 where there is none."""
    return F.when(counts["total"] == 0, F.lit(1.0)).otherwise(counts["distinct"] / counts["total"])


def distinct_n(text: Column, n: int = NGRAM) -> Column:
    """Share of distinct n-grams; 1.0 for a text of fewer than n words."""
    return let(ngram_counts(text, n), distinct_share)


def distinct_of_tokens(tokens: Column, n: int = NGRAM) -> Column:
    """`distinct_n` of a text whose `word_tokens` are a plain column already."""
    return let(_token_ngram_counts(tokens, n), distinct_share)


def repetition_penalty(text: Column, n: int = NGRAM) -> Column:
    """distinct-n minus one: 0 for varied or short text, towards -1 for loops."""
    return distinct_n(text, n) - 1.0


def length_penalty(text: Column, target_chars: int = TARGET_CHARS) -> Column:
    """0 at the target length, falling linearly to -1 on either side."""
    distance = F.abs(F.length(text) - target_chars) / F.lit(float(max(target_chars, 1)))
    return F.greatest(F.lit(-1.0), F.lit(0.0) - distance)


def has_header(text: Column) -> Column:
    return text.rlike(HEADER)


def has_bullet(text: Column) -> Column:
    return text.rlike(BULLET)


def has_enthusiasm(text: Column) -> Column:
    return text.rlike(ENTHUSIASM)


def completion_text(df: DataFrame, name: str) -> Column:
    """A completion column as text, whether it holds strings or message lists.

    The last message's content stands for a list, '' where it has none. An empty
    list reads '[]' and any other type is cast to text, as `str()` would do.
    """
    column, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        last = F.try_element_at(column, F.lit(-1))
        return F.when(column.isNull(), None).when(F.size(column) == 0, F.lit("[]")).otherwise(
            F.coalesce(last["content"], F.lit(""))
        )
    return column.cast("string")


def chat_prompt(prompt: Column) -> Column:
    """One user turn followed by the header that asks for an answer."""
    return F.concat(
        F.format_string(CHAT_TURN, F.lit("user"), prompt), F.lit(CHAT_GENERATION_HEADER)
    )


def chat_messages(messages: Column, ask: bool = False) -> Column:
    """A message list rendered turn by turn, optionally asking for an answer."""
    turns = F.transform(
        messages,
        lambda m: F.format_string(CHAT_TURN, m["role"], F.coalesce(m["content"], F.lit(""))),
    )
    return F.concat(F.array_join(turns, ""), F.lit(CHAT_GENERATION_HEADER if ask else ""))


def scorer_input(prompt: Column, response: Column) -> Column:
    return F.concat(prompt, F.lit("\n\n"), response)


def clip_prompt(prompt: Column, chars: int = PROMPT_CLIP) -> Column:
    return F.substring(prompt, 1, chars)


def cap_head(tokens: Column, limit: int) -> Column:
    """The first `limit` tokens (completions, scorer inputs, whole examples)."""
    return F.slice(tokens, 1, limit)


def cap_tail(tokens: Column, limit: int) -> Column:
    """The last `limit` tokens (prompts keep the part next to the answer)."""
    return let(
        tokens,
        lambda t: F.when(F.size(t) > limit, F.slice(t, -limit, limit)).otherwise(t),
    )
