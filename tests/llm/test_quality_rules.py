import collections
import random
import re

from pyspark.sql import functions as F

from preflens.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    return (
        len(w), sum(map(len, w)), len(lines), len(lines) - len(set(lines)), len(hit),
        len(re.findall(r"[#*$%&|<>]", text)),
    )


def test_measurements(documents, texts):
    rows = q.with_ledger(documents).select("doc_id", "ledger.*").collect()
    assert {r.doc_id: tuple(r[c] for c in q.MEASURES) for r in rows} == {i: measured(t) for i, t in texts.items()}


def test_bits_and_policies(documents):
    rows = {r.doc_id: r.failed for r in q.with_ledger(documents).select("doc_id", "ledger.failed").collect()}
    names = list(q.RULES)
    fails = lambda i: {n for k, n in enumerate(names) if rows[i] >> k & 1}
    assert fails(0) == fails(1) == fails(2) == {"few_words"}
    assert fails(6) == {"repeated_windows"} and fails(56) == {"many_symbols"} and fails(10) == set()
    assert {"repeated_windows", "repeated_lines"} <= fails(50)
    kept = {r.doc_id for r in q.apply_policy(documents).collect()}
    assert kept == {i for i, bits in rows.items() if not bits}
    assert q.apply_policy(documents).columns == documents.columns


def test_ablation_counts_what_a_rule_alone_rejects(documents):
    ledgered = q.with_ledger(documents)
    bits = [r.failed for r in ledgered.select("ledger.failed").collect()]
    for r in q.ablation(ledgered, [q.BASE, q.STRICT]).collect():
        policy = {"base": q.BASE, "2": q.STRICT}[r.version]
        bit = 1 << list(q.RULES).index(r.rule)
        assert r.documents == len(bits)
        assert r.rejected == sum(bool(b & policy.mask) for b in bits)
        assert r.failing == sum(bool(b & bit) for b in bits)
        assert r.only_by_rule == sum(b & policy.mask == bit for b in bits)


def test_empty_table_and_a_clashing_ledger_name(no_documents, documents):
    assert q.apply_policy(no_documents).count() == 0
    both = documents.withColumn("ledger", F.lit("mine"))
    assert q.apply_policy(both).columns == both.columns


def test_scripts_without_spaces_are_kept(spark):
    rng = random.Random(6)
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(rng.randrange(110, 200))) for _ in range(14)]
    japanese = ["".join(chr(rng.randrange(0x3041, 0x3096)) for _ in range(rng.randrange(110, 200))) for _ in range(14)]
    docs = spark.createDataFrame([(1, "\n".join(chinese), "mine"), (2, "\n".join(japanese), "mine"), (3, "short", "mine")], "doc_id long, text string, __ledger string")
    kept = q.apply_policy(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r["__ledger"]) for r in kept.collect()} == {(1, "mine"), (2, "mine")}
    assert q.apply_policy(docs, q.STRICT).count() == 0 and q.apply_policy(docs, q.BASE).count() == 2
