import re

import pytest
from pyspark.sql import functions as F

from preflens.functions import text
from tests import plain

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"

EDGES = [
    "", "one", "one two three", "a b c d", "a b c d e", "Élan_9 naïve 中文 x_1 42", "la di da " * 25,
    "## head", "   # head", "    # head", "text\n## head\nmore", "text\r## head", "mid ## head", "#nohead",
    "####### seven", " # nbsp head", "- item", "text\n   * item", "text\r- item", " - x", "-item",
    "1 - 2", "+ plus", "Certainly! yes", "écertainly", "certainly_", "well, GREAT question?", "happy to help",
    "happy  to help", "uncertainly", "x\x0b- y", "\x1c- y", " - y",
]


@pytest.fixture(scope="module")
def rows(spark):
    documents = [r.text for r in spark.read.parquet(DOCUMENTS).select("text").collect()]
    texts = EDGES + documents
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    c = F.col("text")
    out = df.select(
        "id",
        text.word_tokens(c).alias("words"),
        text.ngrams(c).alias("grams"),
        text.ngrams(c, 1).alias("unigrams"),
        text.distinct_n(c).alias("distinct"),
        *[text.distinct_n(c, n).alias(f"distinct_{n}") for n in (1, 2, 3, 5, 7)],
        text.repetition_penalty(c).alias("repetition"),
        text.length_penalty(c, 100).alias("length_penalty"),
        text.has_header(c).alias("header"),
        text.has_bullet(c).alias("bullet"),
        text.has_enthusiasm(c).alias("enthusiasm"),
        F.length(c).alias("chars"),
        text.cap_head(text.word_tokens(c), 3).alias("head"),
        text.cap_tail(text.word_tokens(c), 3).alias("tail"),
        text.clip_prompt(c).alias("clip"),
    ).collect()
    return list(zip(texts, sorted(out, key=lambda r: r.id)))


def test_words_and_ngrams(rows):
    for source, row in rows:
        assert row.words == plain.words(source)
        assert row.grams == plain.grams(source)
        assert row.unigrams == plain.words(source)
        assert row.distinct == pytest.approx(plain.distinct(source))
        for n in (1, 2, 3, 5, 7):
            assert row[f"distinct_{n}"] == pytest.approx(plain.distinct(source, n))
        assert row.repetition == pytest.approx(plain.distinct(source) - 1)
        assert row.chars == len(source)


def test_equal_hashes_are_told_apart_by_words(spark):
    """All hashes forced to be equal, or equal for one first word."""
    c = F.split("t", " ")
    df = spark.createDataFrame([("a b a b a c a b",), ("x",), ("a a a a",)], "t string")
    for modulus in (1, 2, 3):
        hashes = F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda w: F.ascii(w) % modulus)
        got = [r[0] for r in df.select(text._distinct_ngrams(c, hashes, 2)).collect()]
        assert got == [4, 0, 1]


def test_distinct_share_of_a_million_words(spark):
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.concat(F.lit("w"), i % 1000)))
    row = spark.range(1).select(text.ngram_counts(long).alias("c")).first().c
    assert (row.total, row.distinct) == (999_997, 1000)


def test_caps_keep_head_and_tail(rows):
    for source, row in rows:
        w = plain.words(source)
        assert row.head == w[:3] and row.tail == w[-3:] and row.clip == source[:200]


def test_style_markers(rows):
    header = re.compile(r"^\s{0,3}#{1,6}\s", re.M)
    bullet = re.compile(r"^\s*[-*+]\s", re.M)
    phrase = re.compile(r"\b(?:" + text.ENTHUSIASM_PHRASES + r")\b", re.I)
    found = [0, 0, 0]
    for source, row in rows:
        expected = [bool(p.search(source)) for p in (header, bullet, phrase)]
        assert [row.header, row.bullet, row.enthusiasm] == expected, repr(source[:60])
        found = [a + b for a, b in zip(found, expected)]
    assert min(found) >= 3


def test_length_penalty_falls_off_linearly_and_stops_at_minus_one(spark):
    sizes = [0, 1, 16, 32, 40, 63, 64, 65, 900]
    df = spark.createDataFrame([(n, "é" * n) for n in sizes], "n int, t string")
    got = {r.n: r.p for r in df.select("n", text.length_penalty(F.col("t"), 32).alias("p")).collect()}
    assert got == {n: max(-1.0, -abs(n - 32) / 32) for n in sizes} and str(got[32]) == "0.0"


def test_repetition_penalty_is_the_share_of_repeated_ngrams(spark):
    cases = {"one two three": 0.0, "red green blue black white grey": 0.0, "la la la la la la": -2 / 3, "p q r s p q r s": -1 / 5}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.p for r in df.select("t", text.repetition_penalty(F.col("t")).alias("p")).collect()}
    assert got == {t: pytest.approx(p) for t, p in cases.items()}


def test_completion_text_of_each_shape(spark):
    schema = "id int, s string, m array<struct<role: string, content: string>>, n int"
    df = spark.createDataFrame(
        [
            (0, "plain", [("user", "q"), ("assistant", "a")], 5),
            (1, "", [("assistant", None)], 6),
            (2, "x", [], 7),
        ],
        schema,
    )
    out = df.select(*[text.completion_text(df, c).alias(c) for c in ("s", "m", "n")]).collect()
    assert [r.s for r in out] == ["plain", "", "x"]
    assert [r.m for r in out] == ["a", "", "[]"]
    assert [r.n for r in out] == ["5", "6", "7"]


def test_chat_rendering(spark):
    df = spark.createDataFrame(
        [("hi % there", [("system", "be brief"), ("user", "hi")])],
        "p string, m array<struct<role: string, content: string>>",
    )
    row = df.select(
        text.chat_prompt(F.col("p")).alias("prompt"),
        text.chat_messages(F.col("m"), ask=True).alias("messages"),
        text.scorer_input(F.col("p"), F.lit("ok")).alias("scored"),
    ).first()
    assert row.prompt == "<|im_start|>user\nhi % there<|im_end|>\n<|im_start|>assistant\n"
    assert row.messages == (
        "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    )
    assert row.scored == "hi % there\n\nok"
