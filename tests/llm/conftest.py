from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lor", "min", "tek", "vas", "ru", "é")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    """Awkward texts: null, empty, blank, short, very long, copies, near copies, shared passages, repeated lines."""
    rng = random.Random(5)
    out: dict[int, str | None] = {0: None, 1: "", 2: " \t\n\x0b\f\r ", 3: "one", 4: "one two", 5: "One\ttwo", 6: "a " * 400}
    base = [prose(rng, 90) for _ in range(6)]
    passage = prose(rng, 60)
    for i in range(6):
        out[10 + i] = base[i]
        out[20 + i] = base[i].replace(" ", "  ") if i % 2 else base[i] + "\n"
        words = base[i].split()
        words[i * 7] = "changed"
        out[30 + i] = " ".join(words)
        out[40 + i] = prose(rng, 30) + " " + passage + " " + prose(rng, 30)
    out[50] = "\n".join([base[0][:60]] * 9)
    out[51] = "é" * 300 + base[1] + "字" * 90
    out[52] = "é" * 300 + prose(rng, 20)
    out[53] = prose(rng, 4000)
    out[54] = "x" + base[2][:199] + "y"
    out[55] = "z" + base[2][:200] + "w"
    out[56] = "### $$$ *** " + prose(rng, 20)
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with columns whose names the operators use themselves."""
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, "x", 0.5) for i, t in texts.items()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, n_chars long, row_id long, digest string, n double"
    )


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("doc_id < 0")
