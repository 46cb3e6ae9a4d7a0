"""Random strings of awkward characters, against Python's own text handling."""

import random
import re

from pyspark.sql import functions as F

from preflens.functions import text
from preflens.functions.verdicts import parse_verdict
from tests import plain

PIECES = (
    list("aAbBtTsSiI_09#*-+.,! \n\r\t") + ["\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ",
    "　", "​", "é", "É", "ß", "ſ", "ı", "Σ", "ς", "ﬁ", "中", "٣", "²", "½", "é", "😀",
    "certainly", "Certainly", "ABSOLUTELY", "great question", "happy to help", "## ", "- ", "* ", "TIE", "Answer: "]
)


def test_random_strings_agree_with_python(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(6000)]
    c = F.col("t")
    rows = (
        spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
        .select(
            "id",
            text.word_tokens(c).alias("words"),
            text.has_header(c).alias("header"),
            text.has_bullet(c).alias("bullet"),
            text.has_enthusiasm(c).alias("enthusiasm"),
            parse_verdict(c).alias("verdict"),
            F.length(c).alias("chars"),
        )
        .collect()
    )
    header = re.compile(r"^\s{0,3}#{1,6}\s", re.M)
    bullet = re.compile(r"^\s*[-*+]\s", re.M)
    phrase = re.compile(rf"\b(?:{text.ENTHUSIASM_PHRASES})\b", re.I)
    counts = {"header": 0, "bullet": 0, "enthusiasm": 0}
    for row in rows:
        source = texts[row.id]
        letters = re.findall("[A-Za-z]", source.upper())
        verdict = letters[0] if letters and letters[0] in "AB" else "TIE"
        assert row.words == plain.words(source), repr(source)
        assert row.verdict == verdict, repr(source)
        assert row.chars == len(source)
        for name, pattern in (("header", header), ("bullet", bullet), ("enthusiasm", phrase)):
            assert row[name] == bool(pattern.search(source)), (name, repr(source))
            counts[name] += row[name]
    assert min(counts.values()) > 50
