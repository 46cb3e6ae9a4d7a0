import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from preflens.llm import quality_classifier as q
from preflens.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, "x") for i in range(10, 60)] + [(None, 1, "x"), (5, None, "x"), (999, 1, "x"), (11, 1, "y"), (11, 0, "z")]
    return spark.createDataFrame(rows, "doc_id long, quality int, text string")


def test_shapes():
    assert q.shapes("the The, ABC!!\nx12***  || É字a\U0001f600") == "a Aa, A!\na0* | Aoa\U0001f600" and q.shapes("") == ""


def test_vectors():
    assert [len(part) for part in q.vector(None)] == [0, 0] == [len(part) for part in q.vector(" \n\t")]
    places, values = q.vector("One two three. One two three. One two three. One two three. " * 500)
    assert len(places) < 100 and (np.diff(places.astype(int)) > 0).all() and abs((values**2).sum() - 2) < 1e-5
    plain, _ = q.vector("one two three four five six seven eight")
    again, _ = q.vector("one two three four one two three four")
    half = 1 << (q.BITS - 1)
    assert set(again[again >= half]) - set(plain[plain >= half])


def test_updates_follow_the_definition():
    """Weights from the whole history, in closed form, against the sequence of updates."""
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(6), 3)), [rng.random() for _ in range(3)], rng.randrange(2)) for _ in range(60)]
    model = q.Ftrl(6)
    z, n = [0.0] * 7, [0.0] * 7

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == 6 else (q.L1, q.L2)
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + l2)

    for places, values, label in rows:
        x = dict(zip(places, values)) | {6: 1.0}
        w = {i: weight(i) for i in x}
        error = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - label
        for i, v in x.items():
            g = error * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
            n[i] += g * g
        model.update(np.array(places), np.array(values), label)
    assert np.allclose(model.model(), [weight(i) for i in range(7)])


def test_scores_are_dot_products_of_every_row(spark, documents, texts):
    weights = np.linspace(-3, 3, (1 << q.BITS) + 1)
    rows = documents.select("doc_id", "n", q.score(documents["text"], weights).alias("s")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        places, values = q.vector(texts[row.doc_id])
        assert abs(row.s - 1 / (1 + math.exp(-(weights[places] @ values + weights[-1])))) < 1e-5


def test_training_does_not_depend_on_partitions(documents, labels):
    weights = [q.fit(documents.repartition(n), labels.repartition(n)) for n in (1, 7)]
    assert (weights[0] == weights[1]).all() and weights[0].any()


def test_several_shards_and_the_sample_bound(documents, labels, monkeypatch):
    monkeypatch.setattr(q, "SHARD_ROWS", 8)
    assert q.fit(documents, labels).any()
    assert (q.fit(documents, labels, sample=12) != q.fit(documents, labels)).any()


def test_no_labels_and_no_rows(documents, no_documents, labels):
    for docs, known in ((documents, labels.limit(0)), (no_documents, labels), (no_documents, labels.limit(0))):
        weights = q.fit(docs, known)
        assert not weights.any()
        assert {r.s for r in docs.select(q.score(docs["text"], weights).alias("s")).collect()} <= {0.5}


def test_held_out_fold(spark):
    rows = spark.createDataFrame([(i,) for i in [None, *range(50)]], "doc_id long")
    got = {r.doc_id: r.h for r in rows.select("doc_id", q.held_out(rows["doc_id"]).alias("h")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in got}


def test_query_on_held_out_labels(spark):
    result = QUERIES["op12_quality_classifier"](spark, SF)
    assert result.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = result.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").where(F.col("quality").isNotNull()).collect()}
    judged = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in judged) >= 0.95 * len(judged)
    assert all(p for p, y in judged if y)
