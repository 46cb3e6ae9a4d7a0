"""The pipeline and the queries against brute force."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from preflens.llm import jaccard_join, quality_rules
from preflens.llm.queries import ORACLE, QUERIES
from preflens.llm.suffix_dedup import LENGTH
from tests import oracle
from tests.llm import test_exact_dedup, test_quality_rules

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert not oracle.compare(spark, SF, QUERIES[name], ORACLE[name], oracle.connect(SF))


def test_jaccard_query_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_jaccard"](spark, SF).collect()}
    assert out == jaccard_join.classes_by_brute_force({r.doc_id: r.text for r in docs})


def cut(texts):
    """The suffix stage by its definition."""
    seen = {}
    for t in texts.values():
        for p in range(len(t) - LENGTH + 1):
            seen[t[p : p + LENGTH]] = seen.get(t[p : p + LENGTH], 0) + 1
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - LENGTH + 1):
            if seen[t[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = b"\x01" * LENGTH
        out[i] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_equal_brute_force(spark, documents, texts):
    texts = dict(texts)
    docs = documents.select("doc_id", "text", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.saved(stages["quality rules"](spark, docs, ""))
    bits = {}
    for i, t in texts.items():
        m = dict(zip(quality_rules.MEASURES, test_quality_rules.measured(t)))
        bits[i] = [100 * m["n_symbols"] > 10 * m["n_words"], m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"], 100 * m["n_dup_lines"] > 50 * m["n_lines"], m["word_chars"] > 100 * m["n_words"]]
    texts = {i: t for i, t in texts.items() if not any(bits[i])}
    assert {r.doc_id for r in docs.collect()} == set(texts)
    docs = corpus_pipeline.saved(stages["exact dedup"](spark, docs, ""))
    texts = {k: texts[k] for _, k, _, _ in test_exact_dedup.expected(texts.items())}
    assert {r.doc_id for r in docs.collect()} == set(texts)
    docs = corpus_pipeline.saved(stages["near duplicates"](spark, docs, ""))
    texts = {c: texts[c] for _, c in jaccard_join.classes_by_brute_force(texts, 5, 80).values()}
    assert {r.doc_id for r in docs.collect()} == set(texts)
    docs = corpus_pipeline.saved(stages["repeated strings"](spark, docs, ""))
    assert {r.doc_id: r.text for r in docs.collect()} == cut({i: t.encode() for i, t in texts.items()})
    assert docs.columns == ["doc_id", "text", "source", "n_chars"]
    packed = stages["packing"](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(texts)


def test_the_rest_works_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, *a):
        if name.startswith("preflens.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "win_rate_summary" in e.queries() and not any(n.startswith("op") for n in e.queries())
"""
    folder = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=folder).returncode == 0
