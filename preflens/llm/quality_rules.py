"""Quality rules as a bitmask ledger, native expressions only.

Every rule is evaluated once per document. The ledger holds the measurements
and one integer whose bit i says that rule i failed. A policy is a version name
and a set of rules: applying it is one bitwise test, and the effect of leaving a
rule out is counted from grouped masks without touching a text again.

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: a null, empty or blank text has
no words, all its measurements are 0 and it fails `few_words` only. The count of
repeated words compares windows of five words by their words, not by a hash
alone. Extra input columns pass through `with_ledger` untouched; the ledger
itself is one struct column whose name the caller chooses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.functions.columns import let

from .registry import query, table

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

#: Rule -> condition on the measurements under which it fails. The order gives the bits; append only.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "many_symbols": lambda m: 100 * m["n_symbols"] > 10 * m["n_words"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "long_words": lambda m: m["word_chars"] > 100 * m["n_words"],
}
MEASURES = ("n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words", "n_symbols")


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(RULES))
#: Without `long_words`: a text in a script without spaces has few, long words and is no junk for that.
PRODUCTION = Policy("3", tuple(rule for rule in RULES if rule != "long_words"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct(
        (a["total"] + p + WINDOW - F.greatest(a["end"], p)).alias("total"), (p + WINDOW).alias("end")
    )
    return F.aggregate(starts, zero, step, lambda a: a["total"])


def repeated_words(w: Column) -> Column:
    """Number of words that lie in a five-word window found twice or more, first finds included.

    Hashes of all windows show in one pass whether any repeats. Only then are
    they sorted with their places; neighbours that agree in hash and words repeat.
    """
    n = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))

    def joined(left: Column, right: Column, by: int) -> Column:
        """Hash of each element of `left` with the element of `right` that many places on."""
        return F.zip_with(
            left, F.slice(right, by + 1, F.greatest(F.size(right) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b)
        )

    pairs = joined(w, w, 1)
    fours = let(pairs, lambda p: joined(p, p, 2))
    hashes = F.slice(joined(fours, w, 4), F.lit(1), n)

    def same(a: Column, b: Column) -> Column:
        agree = a["h"] == b["h"]
        for k in range(WINDOW):
            agree = agree & (F.get(w, a["i"] + k) == F.get(w, b["i"] + k))
        return F.coalesce(agree, F.lit(False))

    def repeats(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: _covered(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]
                    )
                )
            ),
        )

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h)))


def measurements(text: Column) -> Column:
    """All measurements of one text as a struct of longs."""
    raw = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(both: Column) -> Column:
        w, line = both["w"], both["line"]
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.size(line).cast("bigint").alias("n_lines"),
            (F.size(line) - F.size(F.array_distinct(line))).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
            both["symbols"].alias("n_symbols"),
        )

    symbols = F.length(raw) - F.length(F.regexp_replace(raw, SYMBOLS, ""))
    return let(F.struct(words(text).alias("w"), lines.alias("line"), symbols.cast("bigint").alias("symbols")), of)


def failure_bits(m: Column) -> Column:
    """Bit i is set if rule i fails."""
    none = F.lit(0).cast("bigint")
    bits = none
    for place, fails in enumerate(RULES.values()):
        bits = bits + F.when(fails(m), F.lit(1 << place).cast("bigint")).otherwise(none)
    return bits


def with_ledger(docs: DataFrame, text: str = "text", ledger: str = "ledger") -> DataFrame:
    """`docs` with a struct column: the measurements and the failure bits."""
    entry = let(
        measurements(docs[text]),
        lambda m: F.struct(*[m[c].alias(c) for c in MEASURES], failure_bits(m).alias("failed")),
    )
    return docs.withColumn(ledger, entry)


def passes(policy: Policy, ledger: str = "ledger") -> Column:
    return F.col(ledger)["failed"].bitwiseAND(F.lit(policy.mask)) == 0


def ablation(ledgered: DataFrame, policies: list[Policy], ledger: str = "ledger") -> DataFrame:
    """For each policy and each of its rules: documents rejected, and those only this rule rejects.

    Masks are counted first, so the rest works on at most 2**rules rows.
    """
    masks = ledgered.groupBy(F.col(ledger)["failed"].alias("failed")).agg(F.count("*").alias("n"))
    cases = [(p.version, r, p.mask, 1 << list(RULES).index(r)) for p in policies for r in p.rules]
    parts = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit"))
                for v, r, m, b in cases
            ]
        )
    )
    seen = masks.select("failed", "n", parts.alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    none = F.lit(0).cast("bigint")
    return seen.groupBy("version", "rule").agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(none)).alias("rejected"),
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(none)).alias("failing"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(none)).alias("only_by_rule"),
    )


def apply_policy(docs: DataFrame, policy: Policy = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of `docs` the policy keeps, all their columns unchanged; no column is added on the way."""
    failed = let(measurements(docs[text]), failure_bits)
    return docs.where(failed.bitwiseAND(F.lit(policy.mask)) == 0)


_MEASURES = r"""
d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
keyed as (select r, i, count(*) over (partition by r, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) as n from win),
hits as (select distinct r, unnest(range(i, i + 5)) as p from keyed where n > 1),
rep as (select r, count(*) as n from hits group by r),
m as (
  select d.doc_id, cast(len(w.w) as bigint) as n_words,
    cast(length(array_to_string(w.w, '')) as bigint) as word_chars,
    cast(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(w.lines) - len(list_distinct(w.lines)) as bigint) as n_dup_lines,
    cast(len(w.lines) as bigint) as n_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from d join w using (r) left join rep using (r)),
j as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 10 * n_words
      or 100 * n_dup_lines > 50 * n_lines as rejected
  from m)
"""

SQL = f"""with {_MEASURES}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not rejected as kept from j
"""


@query("op3_quality_rules", SQL)
def op3_quality_rules(spark, sf_dir):
    """Measurements and verdict of every document."""
    docs = with_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        *[F.col("ledger")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(BASE)).alias("base_failed"),
        passes(PRODUCTION).alias("kept"),
    )
