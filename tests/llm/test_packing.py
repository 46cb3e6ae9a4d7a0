import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from preflens.llm import packing as p

public_tokenizers = pytest.importorskip("public_tokenizers")


def ids_of(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}


def check(rows, ids, length=1024):
    documents, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id])
        documents[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces, full in [(documents, {i: len(v) for i, v in ids.items()}), (sequences, None)]:
        for k, parts in pieces.items():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            assert full is None or sum(parts[-1]) == full[k]
    sizes = [sum(parts[-1]) for parts in sequences.values()]
    assert set(documents) == set(ids) and all(0 < n <= length and (n == length or n & (n - 1) == 0) for n in sizes)


def test_every_id_lies_in_one_piece(documents, no_documents, texts):
    texts = dict(texts)
    check(p.packed_documents(documents).collect(), ids_of(texts))
    assert p.packed_documents(no_documents).count() == 0


def test_a_special_string_in_a_text_is_one_id(spark):
    texts = {1: "a<|endoftext|>b", 2: "<|endoftext|>"}
    docs = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "doc_id long, text string, source string")
    check(p.packed_documents(docs).collect(), ids_of(texts))


def tokens(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n long")
    rows = rows.select("source", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    return rows.select(
        F.monotonically_increasing_id().alias("row_id"), F.xxhash64("source", "k").alias("doc_id"), "source", F.expr("1 + k % 90").alias("n_tokens")
    )


def shares(pieces, rows):
    out = pieces.join(rows.select("row_id", "source"), "row_id").groupBy("window", "source").agg(F.sum("length").alias("n"))
    windows = collections.defaultdict(dict)
    for r in out.collect():
        windows[r.window][r.source] = r.n
    return windows


def test_windows_hold_the_sources_in_their_proportions(spark):
    rows = p.saved(tokens(spark, {"big": 4000, "mid": 900, "small": 100}))
    total = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    everything = sum(total.values())
    windows = shares(p.schedule(rows, window=8192), rows)
    assert len(windows) == -(-everything // 8192)
    credit = collections.Counter()
    for w in sorted(windows):
        for source, n in total.items():
            credit[source] += windows[w].get(source, 0)
            # What was sent never differs from the share by more than a quantum: the rest is carried over.
            assert abs(credit[source] - n * w / len(windows)) <= p.QUANTUM


def test_targets_shape_the_windows_until_a_queue_is_empty(spark):
    rows = p.saved(tokens(spark, {"a": 2000, "b": 2000}))
    windows = shares(p.schedule(rows, window=4096, targets={"a": 3, "b": 1}), rows)
    early = [windows[w] for w in sorted(windows)[:20]]
    assert abs(sum(w["a"] for w in early) - 3 * sum(w["b"] for w in early)) <= 4 * p.QUANTUM
