import hashlib
import re

from pyspark.sql import functions as F

from preflens.llm import exact_dedup as x


def expected(rows):
    """Of each group by normalised text: most code points, then smallest id, then any one row."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return sorted(
        (i, min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g
    )


def found(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.digest) for r in df.collect())


def test_awkward_texts(documents, texts):
    out = x.exact_duplicates(documents)
    assert found(out) == expected(texts.items())
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert kept == {r.keep_id for r in out.collect()}


def test_hot_digest_goes_over_salts(spark):
    rows = [(i, "same  text" if i % 3 else f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(x.exact_duplicates(docs, hot=10, salts=4)) == expected(rows)


def test_texts_with_one_digest_stay_apart(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = x.exact_duplicates(docs, digest=lambda text: F.substring(F.sha2(text, 256), 1, 0)).collect()
    want = {i: (k, n) for i, k, n, _ in expected(rows)}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in out} == want and len(out) == 60
    assert sum(r.kept for r in out) == 7


def test_repeated_rows_and_null_ids_leave_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a b"), (None, "ab"), (None, None)], "doc_id long, text string")
    out = x.exact_duplicates(docs)
    assert sorted((r.group_size, r.kept) for r in out.collect()) == [(1, True), (2, False), (2, False), (2, True), (2, True)]
    assert x.drop_exact_duplicates(docs).count() == 3


def test_stage_keeps_columns_and_empty_tables(documents, no_documents, texts):
    out = x.drop_exact_duplicates(documents)
    assert out.columns == documents.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({k for _, k, _, _ in expected(texts.items())})
    assert x.drop_exact_duplicates(no_documents).count() == 0 and x.exact_duplicates(no_documents).count() == 0
