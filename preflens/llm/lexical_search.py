"""Ranked lexical search: the best documents for every query item, by branch and bound over document FP-trees.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII;
only A-Z are lower-cased. With N documents that have a term, L terms in all, n
terms in a document, df documents holding a term and tf its occurrences in one:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))       m = 50 + (50 n N) div L
    score = sum over the item's different terms of w ((10^9 tf) div (1000 tf + 20 m))

in doubles for w and 64-bit integers else. A document's restricted vector is its
terms that some item of the block asks for, with their tf, the most frequent term
first. Each task builds a tree of up to `BLOCK_DOCUMENTS` vectors at a time: equal
starts share a path, unbranched paths are one node, subtrees of a few documents
are one leaf. Each node keeps its subtree's largest tf per term and its smallest
m. The score grows with tf and falls with m, so putting these into it bounds all
scores below. The depth-first walk goes into a node only for the items whose bound
reaches their score of place `k` so far, the most promising children first; at a
leaf those items' scores are computed exactly. The places found stay from tree to
tree, and a task gives out `k` rows per item at most, which are merged by salt and
then by item. Every document is in a tree, so the result is exact.

Items go in blocks of `BLOCK_ITEMS`; what travels to all tasks is one block's
terms. Statistics cover all documents.

Defined cases: a null or empty text has no terms, counts for nothing and is never
found; an item without terms finds nothing. Equal scores go by ascending doc_id,
null last; repeated rows are separate results, and items with one id are ranked
separately. An empty table of either kind gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table
from .store import rows_per_batch, saved

K = 50
BLOCK_ITEMS = 256
BLOCK_DOCUMENTS = 4096
BLOCK_ENTRIES = 1 << 20
BATCH_ROWS = 512
SALTS = 32
LEAF = 16
#: Cells of subtree maxima that one tree may hold; leaves grow where the vocabulary is large.
MAXIMA = 1 << 24

#: Bytes of UTF-8: A-Z become small, other ASCII outside letters and digits a space, the rest stays.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


# --- the tree --------------------------------------------------------------------


def gains(weights: np.ndarray, tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What terms of these weights and counts add to the score of a document of length measure m."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Item:
    """The query items of a block: the places of their terms, one after the other."""

    def __init__(self, items: list[np.ndarray]):
        self.terms = items
        self.sizes = np.array([len(t) for t in items], "i8")
        self.all = np.concatenate(items) if items else np.empty(0, "i8")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype("i8")

    def sums(self, per_term: np.ndarray) -> np.ndarray:
        """Each item's sum of a value per term."""
        return np.add.reduceat(per_term[self.all], self.starts)

    def sums_of(self, chosen: np.ndarray, per_term: np.ndarray) -> np.ndarray:
        """The same for some items and several documents (rows)."""
        places = np.concatenate([self.terms[i] for i in chosen])
        starts = np.concatenate([[0], np.cumsum(self.sizes[chosen])[:-1]])
        return np.add.reduceat(per_term[:, places], starts, axis=1)


class Node:
    __slots__ = ("first", "last", "children", "largest_tf", "least_m")


class Tree:
    """An FP-tree over vectors sorted by their terms; a node is the span of documents that share its path."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], m: np.ndarray, size: int):
        keys = [terms.astype(">u4").tobytes() for terms, _ in vectors]
        self.order = sorted(range(len(vectors)), key=keys.__getitem__)
        self.vectors = [vectors[i] for i in self.order]
        self.m = m[self.order]
        self.size = size
        self.leaf = max(LEAF, 2 * len(vectors) * size // MAXIMA)
        shared = [0]
        for (a, _), (b, _) in zip(self.vectors, self.vectors[1:]):
            n = min(len(a), len(b))
            different = np.flatnonzero(a[:n] != b[:n])
            shared.append(int(different[0]) if len(different) else n)
        self.shared = np.array(shared)
        self.root = self._grow()

    def _spans(self, first: int, last: int) -> list[tuple[int, int]]:
        """Where the paths below a node part; neighbours of few documents stay together."""
        inner = self.shared[first + 1 : last]
        cuts = np.flatnonzero(inner == inner.min()) + first + 1
        spans: list[tuple[int, int]] = []
        for a, b in zip([first, *cuts.tolist()], [*cuts.tolist(), last]):
            if spans and b - spans[-1][0] <= self.leaf:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        return spans

    def _grow(self) -> Node:
        root = self._node(0, len(self.vectors))
        found, rest = [], [root]
        while rest:
            node = rest.pop()
            found.append(node)
            if node.last - node.first > self.leaf:
                node.children = [self._node(a, b) for a, b in self._spans(node.first, node.last)]
                rest += node.children
        for node in reversed(found):
            if node.children:
                node.largest_tf = np.maximum.reduce([c.largest_tf for c in node.children])
            else:
                node.largest_tf = np.zeros(self.size, "i8")
                for terms, tf in self.vectors[node.first : node.last]:
                    node.largest_tf[terms] = np.maximum(node.largest_tf[terms], tf)
            node.least_m = int(self.m[node.first : node.last].min())
        return root

    def _node(self, first: int, last: int) -> Node:
        node = Node()
        node.first, node.last, node.children = first, last, []
        return node

    def dense(self, node: Node, weights: np.ndarray) -> np.ndarray:
        """What each term adds to the score of each of a leaf's documents."""
        out = np.zeros((node.last - node.first, self.size), "i8")
        for row, i in enumerate(range(node.first, node.last)):
            terms, tf = self.vectors[i]
            out[row, terms] = gains(weights[terms], tf, self.m[i])
        return out


class Places:
    """The best k documents of every item so far."""

    def __init__(self, items: Item, weights: np.ndarray, k: int):
        self.items, self.weights, self.k = items, weights, k
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in items.terms]
        #: What a score has to reach: the k-th best so far, 1 while there are fewer.
        self.needed = np.ones(len(items.terms), "i8")

    def bounds(self, node: Node) -> np.ndarray:
        return self.items.sums(gains(self.weights, node.largest_tf, node.least_m))

    def search(self, tree: Tree, names: list[tuple[int, int]]) -> None:
        """Walk the tree; `names` are (0, doc_id), or (-1, 0) for a null one, in the order of its vectors."""
        rest = [(tree.root, self.bounds(tree.root))]
        while rest:
            node, bounds = rest.pop()
            open_items = np.flatnonzero(bounds >= self.needed)
            if not len(open_items):
                continue
            if node.children:
                below = [(child, self.bounds(child)) for child in node.children]
                rest += sorted(below, key=lambda b: int(b[1][open_items].max()))
                continue
            scores = self.items.sums_of(open_items, tree.dense(node, self.weights))
            for row, at in zip(*np.nonzero(scores >= self.needed[open_items])):
                null, doc_id = names[tree.order[node.first + row]]
                self._take(int(open_items[at]), (int(scores[row, at]), null, -doc_id))

    def _take(self, item: int, entry: tuple[int, int, int]) -> None:
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.needed[item] = heap[0][0]


# --- the jobs --------------------------------------------------------------------


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def vectors(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """doc_id, n, and the document's terms of the vocabulary with their counts; a table written once."""
    numbers = {term: i + 1 for i, term in enumerate(vocabulary)}
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])

    def restricted(batches):
        for batch in batches:
            out = {name: [] for name in schema.names}
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(one.as_py())
                found = np.array(list(filter(None, map(numbers.get, words))), "i8")
                terms, tf = np.unique(found, return_counts=True)
                out["doc_id"].append(doc_id)
                out["n"].append(len(words))
                out["terms"].append((terms - 1).astype("<u4").tobytes())
                out["tf"].append(tf.astype("<u4").tobytes())
            yield _batch(out, schema)

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        return saved(rows.mapInArrow(restricted, "doc_id long, n long, terms binary, tf binary"))


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the `size` terms."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def counted(batches):
        df = np.zeros(size, "i8")
        for batch in batches:
            held = b"".join(batch.column(0).to_pylist())
            df += np.bincount(np.frombuffer(held, "<u4"), minlength=size)
        held = np.flatnonzero(df)
        yield _batch({"term": held, "df": df[held]}, schema)

    totals = found.select("terms").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(size, "i8")
    for term, count in totals.collect():  # one row per term of the block at most
        df[term] = count
    return df


def _search_block(docs: DataFrame, block: list[tuple], key: str, text: str, k: int) -> DataFrame:
    """block: (number, item_id, terms) -> number, doc_id, score of each item's best documents."""
    vocabulary = sorted({t for _, _, terms in block for t in terms})
    found = vectors(docs, vocabulary, key, text)
    total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), max(int(total[1]), 1)
    df = document_frequencies(found, len(vocabulary))
    by_frequency = np.argsort(-df, kind="stable")
    rank = np.empty(len(vocabulary), "i8")
    rank[by_frequency] = np.arange(len(vocabulary))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[by_frequency] + 1))).astype("i8")
    numbers = {t: i for i, t in enumerate(vocabulary)}
    asked = [np.sort(rank[[numbers[t] for t in terms]]) for _, _, terms in block]
    schema = pa.schema([("at", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def searched(batches):
        places = Places(Item(asked), weights, k)
        held, m, names, entries = [], [], [], 0

        def search():
            places.search(Tree(held, np.array(m, "i8"), len(vocabulary)), names)

        for doc_id, n, terms, tf in _rows(batches):
            if not terms:
                continue
            ranks = rank[np.frombuffer(terms, "<u4")]
            order = np.argsort(ranks)
            held.append((ranks[order], np.frombuffer(tf, "<u4").astype("i8")[order]))
            m.append(50 + 50 * n * n_docs // n_terms)
            names.append((-1, 0) if doc_id is None else (0, doc_id))
            entries += len(ranks)
            if len(held) == BLOCK_DOCUMENTS or entries >= BLOCK_ENTRIES:
                search()
                held, m, names, entries = [], [], [], 0
        if held:
            search()
        for at, heap in enumerate(places.heaps):
            ids = [None if null else -minus for _, null, minus in heap]
            yield _batch({"at": [at] * len(heap), "doc_id": ids, "score": [s for s, _, _ in heap]}, schema)

    rows = found.select("doc_id", "n", "terms", "tf").mapInArrow(searched, "at int, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("at", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*best)
    few = rows.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy(*best)))
    ids = F.array(*[F.lit(item_id).cast("long") for _, item_id, _ in block])
    return saved(ranked.where(F.col("rank") <= k).select(F.get(ids, F.col("at")).alias("item_id"), "rank", "doc_id", "score"))


def search(
    docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def split(batches):
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield _batch({"item_id": batch.column(0).to_pylist(), "terms": terms}, schema)

    asked = items.select(items[item_key].cast("long"), items[item_text])
    stream = asked.mapInArrow(split, "item_id long, terms array<binary>").where(F.size("terms") > 0).toLocalIterator()
    result = None
    while block := [(i, r[0], [bytes(t) for t in r[1]]) for i, r in enumerate(islice(stream, BLOCK_ITEMS))]:
        part = _search_block(docs, block, key, text, k)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if result is None else result


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = rf"""with d as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
s as (select count(*) filter (len(w) > 0) as docs, sum(len(w))::bigint as terms from d),
q as (select i, item_id, unnest(list_distinct(w)) as term
  from (select row_number() over () as i, item_id, {_TERMS} as w from benchmark)),
tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from d)
  where term in (select term from q) group by r, term),
df as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from tf, s group by term, docs),
m as (select r, doc_id, 50 + (50 * len(w) * docs) // terms as m from d, s where len(w) > 0),
scored as (select i, item_id, r, doc_id,
    cast(sum(df.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from q join df using (term) join tf using (term) join m using (r) group by i, item_id, r, doc_id)
select item_id, cast(place as integer) as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as place from scored where score > 0)
where place <= {K}
"""


@query("op11_lexical_search", SQL)
def op11_lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
