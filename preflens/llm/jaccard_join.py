"""Near duplicates by a token-group matrix on word shingles.

Every text becomes the set of its distinct shingles. Equal sets are one set from
then on. A pair of sets is a link if 100 * intersection >= percent * union; the
result names the class of sets connected by links.

1. Columns of the matrix. The shingles of a set are ordered, rare ones first. If
   two sets have c shingles in common, the first k of these lie among the first
   n - c + k of each. So linked sets share k shingles in that prefix, and only
   prefix shingles found in two sets or more are matrix columns. With k a share of
   n, sets that have just a passage in common fall short of it.
2. Groups. Sets with an equal minimum hash are compared with one of them, its
   leader: the one with the largest share of columns in its prefix. Those linked with it form its group and need no more comparisons
   with each other. The rest try again under the next hash. A leader that others
   have joined stays in its own group, so a group of one set is its leader alone.
3. Matrix. A row is a group, its columns the union of its members' prefixes.
   Pairs of groups that share enough columns are candidates; their leaders are
   compared.
4. Opening. A pair of groups not connected so far is opened if the leaders are as
   close as links on the way allow. A group is held in blocks of bounded size with
   the union of its tokens; a set is compared with a block's members only if the
   union holds enough of its shingles. One link joins two groups.
5. Classes come from the links by label propagation with pointer jumping.

Shingles are 64-bit hashes of word sequences. The rare-first order uses counts of
shingles that are frequent in some task; any common order gives the same result,
so counting less than all of them costs time, not links.

Defined cases: a null, empty or blank text has an empty set and no links; it is a
class of its own. Fewer words than a shingle: the whole sequence is the one
shingle. Repeated rows have equal sets. A null doc_id never names a class unless
all its members' are null. An empty table gives no rows. Only the two named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .store import bucketed, freed, rows_per_batch, saved

WORDS = 3
PERCENT = 90
#: Shared prefix shingles asked of two sets: this share of the smaller one, and this number at least.
COMMON_SHARE, COMMON_LEAST = 0.03, 3
HASHES = 3
#: A shingle is frequent above all shingles / FREQUENT, so fewer than FREQUENT are broadcast.
FREQUENT = 1 << 18
#: Local count from which a task reports a shingle, and the shingles it counts at a time.
_REPORT, _COUNTED = 4, 1 << 21
#: Shingles in a block of a group.
BLOCK = 1 << 16
#: Rows in an Arrow batch of texts or pairs, and of blocks.
ROWS, BLOCK_ROWS = 256, 16

_ODD = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Words()


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[k]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text. A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(_CODES.__getitem__, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(codes))
    n = len(codes) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out + codes[k : k + n], k)
    return np.unique(out)


def needed(n, percent: int = PERCENT):
    """Shingles that a set of n has in common with any set it is linked with, at least."""
    return -(-(n * percent) // 100)


def common(n: int) -> int:
    """Shared prefix shingles asked of a set of n and any set not smaller."""
    return min(n, max(COMMON_LEAST, math.ceil(COMMON_SHARE * n)))


def _common(n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(COMMON_LEAST), F.ceil(n * F.lit(COMMON_SHARE))))


def _enough(a: str, b: str, percent: int) -> Column:
    """Prefix shingles that linked sets of sizes a and b have in common, at least.

    Of two prefixes one ends first in the common order. Up to its end the sets can only share what the prefixes
    share, and beyond it that set has needed - common shingles.
    """
    n, m = F.col(a), F.col(b)
    both = F.ceil(F.lit(percent) * (n + m) / (100 + percent))
    beyond = lambda x: F.ceil(x * percent / 100) - _common(x)
    return F.greatest(F.least(_common(n), _common(m)), both - F.greatest(beyond(n), beyond(m), F.lit(0)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, float]:
    """Whether two sorted sets are linked, and their similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return 100 * both >= percent * union, both / union if union else 0.0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _frequent_rows(words: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for s in (shingles(t, words) for t in batch["text"]):
                held.append(s)
                size += len(s)
                if size >= _COUNTED:
                    yield _counted(held, size)
                    held, size = [], 0
        if size:
            yield _counted(held, size)

    return count


def _counted(held: list[np.ndarray], size: int) -> pd.DataFrame:
    """Shingles counted often enough to report, and a row that tells how many there were in all."""
    token, n = np.unique(np.concatenate(held), return_counts=True)
    many = n >= _REPORT
    token, n = np.r_[_signed(token[many]), np.int64(0)], np.r_[n[many], size]
    return pd.DataFrame({"token": token, "n": n, "all": np.r_[np.zeros(len(n) - 1, bool), True]})


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles and their counts: fewer than FREQUENT, since all counts add up to the total."""
    counts = docs.mapInPandas(_frequent_rows(words), "token long, n long, all boolean").groupBy("all", "token").agg(
        F.sum("n").alias("n")
    )
    counts = saved(counts)
    total = counts.where("all").agg(F.sum("n")).first()[0] or 0
    top = counts.where(~F.col("all") & (F.col("n") > max(_REPORT, total // FREQUENT))).toPandas()
    freed(counts)
    token = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(dtype=np.int64)[order]


def _set_rows(words: int, percent: int, top):
    """A set's size, digest, and prefix under the rare-first order."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, count = top.value
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            prefixes = []
            for s in sets:
                n = len(s)
                length = min(n, n - needed(n, percent) + common(n))
                if len(token) and n:
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    weight = np.where(token[at] == s, count[at], 0)
                    # Equal counts keep the order of the hashes.
                    s = s[np.argsort(weight, kind="stable")]
                prefixes.append(_signed(s[:length]))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n": [len(s) for s in sets],
                    "d1": [int(_signed(_mixed(s, 8)).sum()) for s in sets],
                    "d2": [int(_signed(_mixed(s, 9)).sum()) for s in sets],
                    "prefix": prefixes,
                }
            )

    return rows


def _content_rows(words: int):
    """The sets of candidate rows with their minimum hashes; rows whose text is another set's are left out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done = None, set()  # rows that repeat a doc_id come one after the other
        for batch in batches:
            out = []
            fields = (batch[c] for c in ("doc_id", "sid", "d1", "d2", "shared", "text"))
            for doc, sid, d1, d2, shared, text in zip(*fields):
                if doc != last:
                    last, done = doc, set()
                if sid in done:
                    continue
                done.add(sid)
                s = shingles(text, words)
                if int(_signed(_mixed(s, 8)).sum()) != d1 or int(_signed(_mixed(s, 9)).sum()) != d2:
                    done.discard(sid)
                else:
                    out.append((sid, len(s), shared, s.tobytes(), *[int(_signed(_mixed(s, 10 + k).min(keepdims=True))[0]) for k in range(HASHES)]))
            yield pd.DataFrame(out, columns=["sid", "n", "shared", "content", *[f"h{k}" for k in range(HASHES)]])

    return rows


def _compared(percent: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                for a, b in zip(batch["a"], batch["b"])
            ]
            yield pd.DataFrame(
                {"x": batch["x"], "y": batch["y"], "link": [f[0] for f in found], "near": [f[1] for f in found]}
            )

    return rows


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y, link, near for pairs (x, y) of sets. Written once: what follows reads it more than once."""
    side = lambda x, a: sets.select(F.col("sid").alias(x), F.col("content").alias(a))
    both = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").select("x", "y", "a", "b")
    return saved(both.mapInPandas(_compared(percent), "x long, y long, link boolean, near double"))


def _compatible(a: str, b: str, percent: int):
    """Sizes that allow a link."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """sid and the leader of its group: itself, or a set it is linked with."""
    narrow = saved(sets.drop("content").dropDuplicates(["sid"]))
    found, compared = None, []
    for k in range(HASHES):
        seekers = narrow
        if found is not None:
            seekers = narrow.join(found.select("sid").union(found.select("leader")), "sid", "left_anti")
        # Copies of one text each have shingles of their own; the text itself shares most of its prefix.
        middle = F.max_by(F.struct("sid", "n"), F.struct("shared", -F.col("sid")))
        first = seekers.groupBy(f"h{k}").agg(middle.alias("m"), F.count("*").alias("c")).select(
            f"h{k}", "c", F.col("m.sid").alias("y"), F.col("m.n").alias("ny")
        )
        pairs = (
            seekers.select(F.col("sid").alias("x"), f"h{k}", "n")
            .join(first.where("c > 1"), f"h{k}")
            .where((F.col("x") != F.col("y")) & _compatible("n", "ny", percent))
            .select("x", "y")
        )
        compared.append(_compare(pairs, sets, percent))
        member = compared[-1].where("link").select(F.col("x").alias("sid"), F.col("y").alias("leader"))
        found = member if found is None else found.unionByName(member)
    groups = saved(
        narrow.select("sid", "n").join(found, "sid", "left").withColumn("leader", F.coalesce("leader", F.col("sid")))
    )
    freed(narrow, *compared)
    return groups


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable over edges (x, y). Labels travel and jump, so rounds are few."""
    both = saved(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = held = saved(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        )
        lower = labels.join(near.withColumnRenamed("x", "node"), "node", "left").select(
            "node", F.least("label", F.coalesce("near", F.col("label"))).alias("low"), "label"
        )
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        jumped = saved(
            lower.join(hop, "low", "left").select(
                "node", F.least("low", "far").alias("new"), "label"
            )
        )
        freed(held)
        labels, held = jumped.select("node", F.col("new").alias("label")), jumped
        if jumped.where("new < label").isEmpty():
            freed(both)
            return labels


def _opened(percent: int):
    """Blocks of two groups: sets of the first whose shingles the second's union holds enough of are compared."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y, left, right in zip(batch["x"], batch["y"], batch["left"], batch["right"]):
                members = [np.frombuffer(m, np.uint64) for m in right]
                union = np.unique(np.concatenate(members))
                out.append((x, y, _first_link([np.frombuffer(m, np.uint64) for m in left], members, union, percent)))
            yield pd.DataFrame(out, columns=["x", "y", "link"])

    return rows


def _first_link(queries, members, union, percent) -> bool:
    for q in queries:
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        if int((union[at] == q).sum()) < needed(len(q), percent):
            continue
        if any(linked(q, m, percent)[0] for m in members):
            return True
    return False


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, first_of_component (one row of each class)."""
    with rows_per_batch(docs.sparkSession, ROWS):
        return _near_duplicates(docs, key, text, words, percent)


def _near_duplicates(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    top = context.broadcast(frequent(rows.select("text"), words))
    kind = "doc_id long, n long, d1 long, d2 long, prefix array<long>"
    seen = saved(rows.mapInPandas(_set_rows(words, percent, top), kind).withColumn("row_id", F.monotonically_increasing_id()))
    digest = ["n", "d1", "d2"]
    distinct = seen.where("n > 0").groupBy(*digest).agg(F.min("doc_id").alias("first"), F.first("prefix").alias("prefix"))
    distinct = saved(distinct.withColumn("sid", F.monotonically_increasing_id()))

    columns = distinct.select("sid", "n", F.explode("prefix").alias("token"))
    shared = columns.groupBy("token").count().where("count > 1").select("token")
    columns = saved(columns.join(shared, "token", "left_semi"))
    # The smallest set that a set of n may be linked with has `percent` of n.
    enough = _common(F.ceil(F.col("n") * percent / 100))
    candidates = columns.groupBy("sid", "n").count().where(F.col("count") >= enough)
    candidates = candidates.select("sid", (F.col("count") / F.col("n")).alias("shared"))
    wanted = distinct.join(candidates, "sid").select("sid", "d1", "d2", "shared", F.col("first").alias("__first"))
    content = "sid long, n long, shared double, content binary, " + ", ".join(f"h{k} long" for k in range(HASHES))
    # Every round reads contents by sid: bucketed, so that only those of pairs move.
    sets = bucketed(
        rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["__first"]))
        .select("doc_id", "sid", "d1", "d2", "shared", "text")
        .mapInPandas(_content_rows(words), content),
        "sid",
        codec="snappy",
    )

    groups = _groups(sets, percent)
    matrix = (
        columns.join(groups.select("sid", "leader"), "sid")
        .groupBy("token", "leader")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"))
    )
    many = matrix.groupBy("token").count().where("count > 1").select("token")
    matrix = saved(matrix.join(many, "token", "left_semi"))
    one, two = matrix.alias("one"), matrix.alias("two")
    pairs = (
        one.join(two, "token")
        .where("one.leader < two.leader")
        .where(f"100 * one.high >= {percent} * two.low and 100 * two.high >= {percent} * one.low")
        .groupBy(F.col("one.leader").alias("x"), F.col("two.leader").alias("y"))
        .agg(
            F.count("*").alias("c"),
            F.min("one.low").alias("a"),
            F.max("one.high").alias("a_high"),
            F.min("two.low").alias("b"),
            F.max("two.high").alias("b_high"),
        )
        .where(
            F.when((F.col("a") == F.col("a_high")) & (F.col("b") == F.col("b_high")), F.col("c") >= _enough("a", "b", percent))
            .otherwise(F.col("c") >= F.least(_common(F.col("a")), _common(F.col("b"))))
        )
        .select("x", "y")
    )
    compared = _compare(pairs, sets, percent)
    freed(columns, matrix)
    leaders = groups.select(F.col("leader").alias("node")).distinct()
    links = compared.where("link").select("x", "y")
    classes = components(leaders, links)

    # Distance is a metric: leaders of linked members are at most three links apart, two if one group is a single set.
    sizes = groups.groupBy("leader").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    side = lambda x, c: classes.join(sizes.withColumnRenamed("leader", "node"), "node").select(
        F.col("node").alias(x), F.col("label").alias(f"{x}_class"), F.col("members").alias(c)
    )
    step = 1 - percent / 100
    reach = step * (1 + (F.col("nx") > 1).cast("int") + (F.col("ny") > 1).cast("int"))
    to_open = (
        compared.where(~F.col("link"))
        .join(side("x", "nx"), "x")
        .join(side("y", "ny"), "y")
        .where((F.col("x_class") != F.col("y_class")) & (F.col("nx") + F.col("ny") > 2))
        .where(F.lit(1.0) - F.col("near") <= reach + 1e-9)
        .select("x", "y")
    )
    to_open = saved(to_open)
    done = [distinct, groups, sets, compared, to_open]
    if not to_open.isEmpty():
        opened = to_open.select(F.col("x").alias("leader")).union(to_open.select("y")).distinct()
        blocks = (
            groups.join(opened, "leader", "left_semi")
            .join(sizes, "leader")
            .withColumn("block", F.pmod(F.xxhash64("sid"), F.ceil(F.col("shingles") / BLOCK)))
            .select("sid", "leader", "block")
            .join(sets.select("sid", "content"), "sid")
            .groupBy("leader", "block")
            .agg(F.collect_list("content").alias("contents"))
        )
        blocks = saved(blocks)
        part = lambda x, c: blocks.select(F.col("leader").alias(x), F.col("contents").alias(c))
        more = (
            to_open.join(part("x", "left"), "x")
            .join(part("y", "right"), "y")
            .mapInPandas(_opened(percent), "x long, y long, link boolean")
            .where("link")
            .select("x", "y")
        )
        with rows_per_batch(docs.sparkSession, BLOCK_ROWS):
            more = saved(more)
        freed(blocks)
        done.append(more)
        classes = components(leaders, links.union(more))

    of_set = distinct.select("sid", *digest, "first").join(
        groups.select("sid", "leader").join(classes.withColumnRenamed("node", "leader"), "leader").select("sid", "label"),
        "sid",
        "left",
    )
    of_set = of_set.withColumn("label", F.coalesce("label", F.col("sid")))
    named = of_set.groupBy("label").agg(F.min("first").alias("component_id"))
    of_set = saved(of_set.join(named, "label").select(*digest, "label", "component_id"))
    freed(*done)
    plain = seen.where("n = 0").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first_of_component")
    )
    classed = seen.where("n > 0").select("doc_id", "row_id", *digest).join(of_set, digest)
    stays = classed.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min("row_id").alias("stays"))
    return plain.unionByName(
        classed.join(stays, "label").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "component_id",
            (F.col("row_id") == F.col("stays")).alias("first_of_component"),
        )
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """`docs` with one document of each class, all columns unchanged. Rows with one doc_id go or stay together."""
    columns = docs.columns
    gone = near_duplicates(docs, key, text, words, percent).groupBy("doc_id").agg(
        F.max("first_of_component").alias("stays")
    )
    gone = gone.where(~F.col("stays")).select(F.col("doc_id").alias("__id"))
    return docs.join(gone, docs[key].cast("bigint").eqNullSafe(gone["__id"]), "left_anti").select(
        *[F.col(f"`{c}`") for c in columns]
    )


def classes_by_brute_force(texts: dict[int, str | None], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The definition, for tests: doc_id -> (n_shingles, component_id), from all pairs of word sequences."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for p, i in enumerate(order):
        for j in order[p + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark, sf_dir):
    """Every document with its class of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("first_of_component")
