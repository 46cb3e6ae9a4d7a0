import random

import pytest
from pyspark.sql import functions as F

from preflens.llm import jaccard_join as j
from tests.llm.conftest import prose


def found(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in j.near_duplicates(docs, **options).collect()}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_awkward_texts(documents, no_documents, texts, words, percent):
    assert found(documents, words=words, percent=percent) == j.classes_by_brute_force(texts, words, percent)
    assert j.near_duplicates(no_documents).count() == 0


def test_chains_and_many_near_copies(spark, monkeypatch):
    """Classes held together by chains only, groups of several blocks, and pairs just below the threshold."""
    monkeypatch.setattr(j, "BLOCK", 300)
    rng = random.Random(2)
    texts, n = {}, 0
    for _ in range(4):
        words = prose(rng, 70).split()
        for step in range(25):
            texts[n] = " ".join(words)
            n += 1
            words = list(words)
            if step % 6 == 5:
                words = words[3:] + prose(rng, 3).split()
            else:
                words[rng.randrange(len(words))] = f"new{n}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert found(docs) == j.classes_by_brute_force(texts)


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_random_chains_of_edited_copies(spark, words, percent):
    """Leaders that are linked with leaders of other hashes: no link of a chain may be lost."""
    texts, want = {}, {}
    for seed in range(1200):
        rng, family = random.Random(seed), {}
        line = [f"s{seed}w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 90))]
        for _ in range(rng.randint(3, 8)):
            family[len(texts) + len(family)] = " ".join(line)
            for _ in range(rng.randint(1, 2)):
                line = list(line)
                line[rng.randrange(len(line))] = f"s{seed}n{rng.randrange(10**6)}"
        texts |= family
        want |= j.classes_by_brute_force(family, words, percent)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert found(docs, words=words, percent=percent) == want


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "A b\tc d"), (None, "x y z"), (2, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id, r.n_shingles, r.first_of_component) for r in j.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(2, 2, 0, True), (4, 4, 2, False), (4, 4, 2, True), (None, 4, 2, False), (None, None, 1, True)], key=str)


def test_stage_leaves_one_of_each_class(documents, texts):
    out = j.drop_near_duplicates(documents, words=3, percent=90)
    want = {c for _, c in j.classes_by_brute_force(texts).values()}
    assert out.columns == documents.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_links_at_the_edge_of_the_percentage_are_kept(spark):
    rng = random.Random(11)
    texts = {}
    for family in range(6):
        base = prose(rng, rng.choice([12, 40, 80, 150])).split()
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [f"new{rng.randrange(10**6)}"] * rng.randint(0, 2)
            if rng.random() < 0.3:
                words += [f"end{rng.randrange(10**6)}" for _ in range(rng.randint(1, 8))]
            texts[len(texts)] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for words, percent in ((3, 90), (5, 80)):
        want = j.classes_by_brute_force(texts, words, percent)
        got = found(docs, words=words, percent=percent)
        assert got == want
        assert 6 < len({c for _, c in want.values()}) < len(texts)


def test_joins_on_bucketed_contents_move_the_other_side_only(spark):
    from pathlib import Path

    from preflens.llm.store import bucketed, freed

    table = bucketed(spark.range(500).selectExpr("id as sid", "id * 2 as content"), "sid", codec="snappy")
    name = table._jdf.queryExecution().analyzed().toString().split("bucketed_")[1][:32]
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    joined = spark.range(0, 900, 3).withColumnRenamed("id", "x").hint("merge").join(table, F.expr("x = sid"))
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and joined.count() == 167
    freed(table)
    assert not folder.exists() and not spark.catalog.tableExists(f"bucketed_{name}")
