import collections
import math
import random
import re

import numpy as np
import pytest

from preflens.llm import lexical_search as s
from preflens.llm.registry import ORACLE, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text or "")


def brute(docs, items, k):
    """(item index, rank, doc_id, score) from the definition."""
    words = [(i, TERM.findall(small(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), max(1, sum(len(w) for _, w in words))
    counts = [(i, len(w), collections.Counter(w)) for i, w in words]
    df = collections.Counter(t for _, _, c in counts for t in c)
    out = []
    for at, text in enumerate(items):
        asked, found = set(TERM.findall(small(text))), []
        for i, n, c in counts:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked
            )
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(at, rank, i, -score) for rank, (score, _, i) in enumerate(found[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus(texts):
    rng = random.Random(8)
    docs = [(i, t) for i, t in texts.items()]
    docs += [(None, texts[10]), (None, "one two"), (7, texts[10]), (7, "ONE\x00two\x7fÉtÉ 3d_4"), (8, texts[53] * 3), (9, "é" * 5000)]
    docs += [(1000 + i, "same words for all of these copies") for i in range(150)]
    docs += [(3000 - i, " ".join(rng.choice(texts[53].split()) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    items = [texts[11][:200], texts[40], "one TWO été 3d", "copies of words", None, "", "?!", "nowhere", texts[53], texts[11][:200]]
    return docs, items


def frames(spark, corpus):
    docs, items = corpus
    return (
        spark.createDataFrame([(*d, 1, "x", 0.5) for d in docs], "doc_id long, text string, score long, terms string, n double"),
        spark.createDataFrame([(t, 5 if i in (0, 9) else i, 2) for i, t in enumerate(items)], "text string, item_id long, rank long"),
    )


@pytest.mark.parametrize("parts, block, items_at_once", [(1, 4096, 256), (6, 40, 3)])
def test_search_equals_the_definition(spark, corpus, monkeypatch, parts, block, items_at_once):
    monkeypatch.setattr(s, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(s, "BLOCK_ITEMS", items_at_once)
    docs, items = frames(spark, corpus)
    result = s.search(docs.repartition(parts), items, k=20)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    got = collections.Counter(tuple(r) for r in result.collect())
    wanted = collections.Counter((5 if a in (0, 9) else a, r, i, v) for a, r, i, v in brute(*corpus, 20))
    assert got == wanted and max(wanted.values()) == 2


def test_bounds_hold_and_prune(corpus):
    """No document scores above a bound of any node over it, and far fewer leaves are opened than there are."""
    docs, items = corpus
    vocabulary = sorted({t for x in items for t in s.terms_of(x)})
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = []
    for _, text in docs:
        c = collections.Counter(number[t] for t in s.terms_of(text) if t in number)
        vectors.append((np.array(sorted(c), "i8"), np.array([c[t] for t in sorted(c)], "i8")))
    m = np.array([50 + len(s.terms_of(t)) for _, t in docs], "i8")
    asked = s.Item([np.array([number[t] for t in sorted(set(s.terms_of(x)))], "i8") for x in items if s.terms_of(x)])
    weights = np.arange(1, len(vocabulary) + 1)
    tree, places = s.Tree(vectors, m, len(vocabulary)), s.Places(asked, weights, 5)
    nodes, rest = [], [tree.root]
    while rest:
        nodes.append(rest.pop())
        rest += nodes[-1].children
    leaves = [n for n in nodes if not n.children]
    assert sorted(i for n in leaves for i in range(n.first, n.last)) == list(range(len(docs)))
    for node in nodes:
        exact = asked.sums_of(np.arange(len(asked.terms)), tree.dense(node, weights))
        assert (exact <= places.bounds(node)).all()
        head = tree.vectors[node.first][0]
        depth = int(tree.shared[node.first + 1 : node.last].min(initial=10**6))
        assert node.children == [] or all((v[:depth] == head[:depth]).all() for v, _ in tree.vectors[node.first : node.last])
    opened = []
    tree.dense = lambda node, w, whole=tree.dense: opened.append(node) or whole(node, w)
    places.search(tree, [(0, i) for i in range(len(docs))])
    assert 0 < len(opened) < len(leaves)


def test_empty_tables(spark, corpus):
    docs, items = frames(spark, corpus)
    assert s.search(docs.limit(0), items).count() == 0
    assert s.search(docs, items.limit(0)).count() == 0
    assert s.search(docs.where("doc_id <= 2"), items).count() == 0


def test_query_equals_sql(spark):
    name = "op11_lexical_search"
    assert not oracle.compare(spark, SF, QUERIES[name], ORACLE[name], oracle.connect(SF))
