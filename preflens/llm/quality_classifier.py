"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are `[^\\x20\\x09-\\x0D]+`. A text's features are hashed n-grams of two word
sequences: the lower-cased words (one and two words) and their shapes (one to
three words), a shape being the word with runs of capitals, small letters, digits
and each other character written once (`A`, `a`, `0`, itself; letters without case
are `o`). A word whose four-word window stood earlier in the text has a shape of
its own, so that repetition shows. Every n-gram adds to one of `2**BITS` places;
a text's vector holds log(1 + count) there, scaled to length 1 for each of the two
sequences. The score is the logistic function of one sparse dot product.

Training: about `SAMPLE` labelled rows at most, chosen by the hash of their key (the
bound makes them safe to broadcast to the documents), dealt by hash into shards of
about `SHARD_ROWS`. Each shard is one task, which holds its rows' sparse vectors
(bounded, since a vector has at most `2**BITS` entries, however long the text) and
makes `EPOCHS` passes of FTRL-Proximal updates in hash order. The shards' weights are averaged.
Everything else, the scores, covers all rows and whole texts, row by row.

Defined cases: a null or empty text is the empty vector, its score that of the
bias alone. Rows without a label, and labels of no document, train nothing; a key
with several labels trains with each of them once. No labelled rows give 0.5
everywhere. A null key is never trained on. Repeated rows count each. Added
columns are named by the caller; all others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.functions.columns import HASH_SPACE, hash52

from .registry import query, table

BITS = 17
SAMPLE = 65_536
SHARD_ROWS = 4_096
EPOCHS = 8
THRESHOLD = 0.3
FOLDS = 5

# FTRL-Proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0005, 0.01

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_REPEATED = np.uint64(0x27D4EB2F165667C5)


class _Kinds(dict):
    """Code point -> its kind, for `str.translate`; blanks between words stay."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "o" if c.isalpha() else c
        return self[code]


_KINDS = _Kinds()


def shapes(text: str) -> str:
    """The text with runs of each kind of character written once."""
    kinds = np.frombuffer(text.translate(_KINDS).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.ones(len(kinds), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    return kinds[first].tobytes().decode("utf-32-le", "surrogatepass")


def _hashes(text: str) -> np.ndarray:
    """A hash of every word; splitting bytes splits at the six blanks only."""
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(zlib.crc32, words), "u8", len(words))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n hashes in a row."""
    size = len(hashes) - n + 1
    if size <= 0:
        return hashes[:0]
    mixed = np.full(size, np.uint64(n), "u8")
    for i in range(n):
        mixed = (mixed ^ hashes[i : i + size]) * _ODD[i % 3]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The sparse vector of a text: ascending places and their values."""
    lower = _hashes((text or "").lower())
    if not len(lower):
        return np.empty(0, "u4"), np.empty(0, "f4")
    form = _hashes(shapes(text))
    windows = _grams(lower, 4)
    if len(windows):
        _, first = np.unique(windows, return_index=True)
        again = np.ones(len(windows), bool)
        again[first] = False
        form[: len(windows)][again] ^= _REPEATED
    half = 1 << (BITS - 1)
    places, values = [], []
    for offset, sequence, longest in ((0, lower, 2), (half, form, 3)):
        grams = np.concatenate([_grams(sequence, n) for n in range(1, longest + 1)])
        place, count = np.unique((grams * _ODD[0]) >> np.uint64(64 - BITS + 1), return_counts=True)
        weight = np.log1p(count)
        places.append(place.astype("u4") + np.uint32(offset))
        values.append((weight / np.sqrt((weight**2).sum())).astype("f4"))
    return np.concatenate(places), np.concatenate(values)


class Ftrl:
    """FTRL-Proximal logistic regression; the last weight is the bias, which has no penalty."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, places: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrunk = np.where(np.abs(z) <= L1, 0.0, np.sign(z) * L1 - z)
        return shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def bias(self) -> float:
        return -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA)

    def update(self, places: np.ndarray, values: np.ndarray, label: float) -> None:
        w, b = self.weights(places), self.bias()
        error = 1.0 / (1.0 + np.exp(-(w @ values + b))) - label
        g = error * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g
        n = self.n[-1]
        self.z[-1] += error - (np.sqrt(n + error * error) - np.sqrt(n)) / ALPHA * b
        self.n[-1] = n + error * error

    def model(self) -> np.ndarray:
        return np.append(self.weights(slice(0, -1)), self.bias())


def _train_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard -> one row per shard: its weights, and how many rows made them."""
    rows, current = [], None

    def trained() -> pd.DataFrame:
        model = Ftrl()
        for _ in range(EPOCHS):
            for places, values, label in rows:
                model.update(places, values, label)
        return pd.DataFrame({"n": [len(rows)], "weights": [model.model().astype("<f8").tobytes()]})

    for batch in batches:
        for shard, text, label in zip(batch["shard"], batch["text"], batch["label"]):
            if shard != current and rows:
                yield trained()
                rows = []
            current = shard
            rows.append((*vector(text), float(label)))
    if rows:
        yield trained()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    seed: int = 0,
) -> np.ndarray:
    """Weights (the bias last) learned from the labelled rows of `docs`. Filter `labels` to hold rows out."""
    pairs = labels.select(labels[key].alias("key"), labels[label].cast("double").alias("label"))
    pairs = pairs.where("key is not null and label is not null").distinct()
    pairs = pairs.withColumn("place", F.concat_ws(":", "key", "label"))
    count = pairs.count()
    # About `sample` rows of however many, so the broadcast has a bound whatever the tables hold.
    taken = hash52("sample", seed, F.col("place")) < F.lit(HASH_SPACE * min(1.0, sample / max(count, 1)))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(pairs.where(taken)), "key")
    shards = max(1, -(-min(count, sample) // SHARD_ROWS))
    shard = F.pmod(hash52("shard", seed, F.col("place")), F.lit(shards)).alias("shard")
    dealt = (
        rows.select(shard, hash52("order", seed, F.col("place")).alias("at"), "text", "label")
        .repartition(4 * shards, "shard")
        .sortWithinPartitions("shard", "at", "text")
        .select("shard", "text", "label")
    )
    # One row of fixed size per shard, at most sample / SHARD_ROWS of them.
    total, weights = 0, np.zeros((1 << BITS) + 1)
    for n, part in dealt.mapInPandas(_train_shards, "n long, weights binary").collect():
        total += n
        weights += n * np.frombuffer(part, "<f8")
    return weights / max(total, 1)


def score(text: Column, weights: np.ndarray) -> Column:
    """The quality of a text between 0 and 1."""
    weights = weights.astype("f4")

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias = float(weights[-1])
        for texts in parts:
            sums = np.empty(len(texts))
            for i, one in enumerate(texts):
                places, values = vector(one)
                sums[i] = weights[places] @ values + bias
            yield pd.Series(1.0 / (1.0 + np.exp(-sums)))

    return scored(text)


def held_out(key: Column) -> Column:
    """Whether the key belongs to the fold that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


@query("op12_quality_classifier")
def op12_quality_classifier(spark, sf_dir):
    """Quality score of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels.where(~held_out(labels["doc_id"])))
    scored = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), score(docs["text"], weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
