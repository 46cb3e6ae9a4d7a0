"""URL filter: host and path rules, then a character language-model ratio.

Rules decide the URLs they fit. All others are judged by two character models,
one trained on the URLs that rules allow, one on those they block. Both are
variable-order Markov models: the probability of a character after its last
ORDER characters is interpolated with that after one character less, down to a
uniform one, and the weight of the longer context grows with its evidence
(Witten-Bell). The score of a URL is the mean over its characters of the
difference of the two log probabilities; it is compared with a threshold that
separates best the rule-labelled URLs held out from training.

Only native expressions. Counts cover all labelled URLs. Model and URLs meet in
joins on character strings. Strings that are frequent, since the same few open
nearly every URL, are joined where they lie; only the others are shuffled.

Defined cases: a null url, or one without `://`, has empty host and path, fits no
rule, and is scored on what text there is (a null one on its end mark alone).
Repeated rows are judged alike. If rules label no URL one way, both models are
uniform where they saw nothing and the threshold is 0; a score equal to the
threshold is allowed. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preflens.functions.columns import let

from .registry import query, table
from .store import freed, saved

ORDER = 5
#: Size of the alphabet behind the uniform model.
ALPHABET = 256
START, END = "\x02", "\x03"
#: A string is frequent above this part of all strings, so fewer than HOT_PART are broadcast.
HOT_PART = 2000
#: Every FOLDS-th labelled URL by hash is held out to set the threshold.
FOLDS = 5
#: Scores are summed as whole millionths, so sums do not depend on their order.
SCALE = 1_000_000
#: Thresholds are tried at steps of 1 / BINS within +-LIMIT.
BINS, LIMIT = 200, 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: The rules given for the query: fixed values.
RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits. Of equal lengths the first given."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """For every character and the end mark: it with the ORDER characters before it."""
    return let(
        F.concat(F.lit(START * ORDER), _lower(F.coalesce(text, F.lit(""))), F.lit(END)),
        lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - ORDER), lambda i: t.substr(i, F.lit(ORDER + 1))),
    )


def _log_ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio: the difference of both models' log probabilities of a gram's last character, in millionths.

    `counts` has gram, accepted, rejected for all grams to be scored; its sums are
    the training URLs'. Shorter grams are sums of longer ones. Probabilities rise
    from the shortest grams: each level joins the one below on its suffix, and the
    totals of a context come from the grams that share it, at most one for each
    character.
    """
    sides = ("accepted", "rejected")
    levels = {ORDER + 1: counts}
    for n in range(ORDER, 0, -1):
        levels[n] = levels[n + 1].groupBy(F.expr(f"right(gram, {n})").alias("gram")).agg(
            *[F.sum(s).alias(s) for s in sides]
        )
    below, written = None, []
    for n in range(1, ORDER + 2):
        context = Window.partitionBy(F.expr(f"left(gram, {n - 1})"))
        level = levels[n].withColumns(
            {f"t_{s}": F.sum(s).over(context) for s in sides}
            | {f"k_{s}": F.count_if(F.col(s) > 0).over(context) for s in sides}
        )
        if below is None:
            level = level.withColumns({f"p_{s}": F.lit(1.0 / ALPHABET) for s in sides})
        else:
            level = level.withColumn("suffix", F.expr(f"right(gram, {n - 1})")).join(below, "suffix")
        new = {}
        for s in sides:
            total, kinds, seen, p = (F.col(f"{x}{s}") for x in ("t_", "k_", "", "p_"))
            new[f"p_{s}"] = F.when(total > 0, (seen + kinds * p) / (total + kinds)).otherwise(p)
        # Written out, so that the next level's plan starts from a table.
        level = saved(level.withColumns(new).select("gram", *[f"p_{s}" for s in sides]))
        written.append(level)
        below = level.withColumnRenamed("gram", "suffix")
    freed(*written[:-1])
    ratio = F.round(SCALE * (F.log("p_accepted") - F.log("p_rejected"))).cast("bigint")
    return level.select("gram", ratio.alias("ratio"))


def _scores(rows: DataFrame, training: Column) -> DataFrame:
    """row_id, score of every row: the mean log ratio under the models trained on the rows that `training` picks."""
    grams = rows.select(
        "row_id",
        F.coalesce(training & (F.col("verdict") == "allow"), F.lit(False)).cast("bigint").alias("accepted"),
        F.coalesce(training & (F.col("verdict") == "block"), F.lit(False)).cast("bigint").alias("rejected"),
        F.explode(_grams(F.col("text"))).alias("gram"),
    )
    counts = saved(
        grams.groupBy("gram").agg(
            F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count("*").alias("times")
        )
    )
    total = counts.agg(F.sum("times")).scalar()
    hot = saved(counts.where(F.col("times") * HOT_PART > total).select("gram"))
    model = _log_ratios(counts.drop("times"))
    freed(counts)
    hot_model = F.broadcast(model.join(F.broadcast(hot), "gram"))
    parts = [
        grams.join(hot_model, "gram"),
        # The model grows with the input: it is never broadcast.
        grams.join(F.broadcast(hot), "gram", "left_anti").join(model.hint("merge"), "gram"),
    ]
    summed = [p.groupBy("row_id").agg(F.sum("ratio").alias("ratio"), F.count("*").alias("n")) for p in parts]
    return (
        summed[0].unionByName(summed[1]).groupBy("row_id").agg((F.sum("ratio") / F.sum("n") / SCALE).alias("score"))
    )


def threshold(scored: DataFrame) -> float:
    """The threshold with the best mean of both classes' shares on the right side; 0 if a class is missing.

    `scored` has score and verdict. Scores are counted in bins, so what reaches the driver is bounded.
    """
    bin_of = F.floor(F.least(F.greatest("score", F.lit(-LIMIT)), F.lit(LIMIT)) * BINS).cast("int")
    found = scored.groupBy(bin_of.alias("bin"), "verdict").count().collect()
    side = {v: {r["bin"]: r["count"] for r in found if r["verdict"] == v} for v in ("allow", "block")}
    total = {v: sum(c.values()) for v, c in side.items()}
    if not all(total.values()):
        return 0.0
    tried, allowed, blocked = [], 0, 0  # labelled URLs below the threshold so far
    for at in sorted({*side["allow"], *side["block"]}):
        quality = 1 - allowed / total["allow"] + blocked / total["block"]
        tried.append((quality, -abs(at), at / BINS))
        allowed += side["allow"].get(at, 0)
        blocked += side["block"].get(at, 0)
    return max(tried)[2]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for every row of `pages`."""
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("text")).withColumns(
        {"host": host_of(F.col("text")), "path": path_of(F.col("text"))}
    )
    rows = rows.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "text", "host", "path", "fits.rule", "fits.verdict"
    )
    rows = saved(rows.withColumn("row_id", F.monotonically_increasing_id()))
    labelled = rows.where("verdict is not null")
    held_out = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    tuning = _scores(labelled, ~held_out).join(labelled.where(held_out).select("row_id", "verdict"), "row_id")
    limit = threshold(tuning)
    scores = _scores(rows, F.col("verdict").isNotNull())
    return rows.join(scores, "row_id").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block")).alias("verdict"),
        "score",
        F.lit(limit).alias("threshold"),
    )


@query("op1_url_filter")
def op1_url_filter(spark, sf_dir):
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"))
