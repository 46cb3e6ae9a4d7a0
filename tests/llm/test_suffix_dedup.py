import random

from preflens.llm import suffix_dedup as s


def check(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in s.digest(s.remove_repeats(docs)).collect()}
    want = s.removed_by_brute_force([(t or "").encode() for t in texts])
    assert [out[i] for i in range(len(texts))] == want
    return want


def test_awkward_texts(spark, texts):
    want = check(spark, list(texts.values()))
    assert any(n for n, _, _ in want)


def test_copies_edges_and_periods(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, short = letters(260), letters(199)
    texts = [letters(rng.randrange(50)) + shared[a:b] + letters(50) for a, b in [(0, 260), (0, 260), (10, 230), (60, 260), (0, 200), (61, 260)]]
    texts += [short, short, short + "x", "y" + short, letters(100) + short + shared[:199]]
    texts += ["ab" * 300, "aba" + "ab" * 120, "q" * 199, "q" * 200, "q" * 201, shared + shared, None, ""]
    check(spark, texts)


def test_stage_cuts_whole_characters_and_keeps_columns(spark, documents, no_documents):
    out = s.drop_repeats(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert s.drop_repeats(no_documents).count() == 0


def test_stage_takes_columns_of_any_name_and_tables_without_a_length(spark):
    shared = "".join(random.Random(4).choice("abcdefgh ") for _ in range(300))
    rows = [(1, "x" + shared, "p", 0.5, 7, None), (2, "y" + shared, None, None, None, "b"), (3, None, "q", 1.5, 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `my col` string, `a:b` double, row_id long, `kept.x` string")
    out = s.drop_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    found = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    assert found == {1: ("x", "p", 0.5, 7, None), 2: ("y", None, None, None, "b"), 3: ("", "q", 1.5, 9, "c")}
