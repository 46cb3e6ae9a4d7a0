"""Removal of long repeated byte strings by distributed prefix doubling.

A byte is removed if a string of `length` bytes that covers it starts anywhere
else too. Sorting all suffixes would move every position of the corpus once for
each doubling. Instead:

1. Names. Inside a task the name of every short string comes from doubling: the
   name of 2n bytes at p is made from the names of n bytes at p and p + n.
2. Anchors. Of the positions inside each window of `length` bytes the one with
   the smallest name is the window's anchor. Equal windows have their anchor at
   the same distance, so two equal strings always show as two equal anchors.
   Only anchors, about one position in seventy, become rows. Spark groups them by
   name and drops those whose name is unique.
3. Growing lengths. The strings that share an anchor form a run of distances.
   For a run Spark counts two longer names: of the part that all its strings have
   in common (unique: nothing in the run repeats) and of everything they cover
   (found twice: all of them repeat). Runs that neither settles are halved into
   shorter runs, whose common part is longer, until a run is a single string.
   A class that is settled as repeated leaves one witness to the next round.
4. The removed intervals of a document are joined with its text and cut out.

Names of more than one byte are fingerprints: 64 bits where a clash only costs
work, 128 bits where it decides. The texts lie in a table bucketed by row, so
joining them with positions moves positions only.

Defined cases: a null text counts as empty. Texts shorter than `length` lose
nothing. Repeated rows are separate documents and so repeat each other. An empty
table gives no rows. Only the named columns are read. A text may be left empty.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query, table
from .store import freed, saved, shared_folder

LENGTH = 200
#: Bytes of an anchor's name, a power of two. Distances of a window's anchor are 0 .. length - ANCHOR.
ANCHOR = 64
#: Widths of the runs of distances, after the whole run; the last has one string.
WIDTHS = (16, 1)
_CHUNK = 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


_FIRST = _random(11, 256)
_LANES = [(_random(seed, 256), int(_random(seed + 1, 1)[0]) | 5) for seed in (21, 31)]


def names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of `length` bytes (a power of two) at every position, by doubling."""
    name, n = _FIRST[data], 1
    while n < length:
        low, high = name[:-n], name[n:]
        name = low * _MULTIPLY + (high ^ (high >> np.uint64(29))) * _MIX
        name ^= name >> np.uint64(32)
        n *= 2
    return name


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of `length` bytes: position, name, smallest and largest distance."""
    empty = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty, empty
    name = names(data, anchor)
    width, n = length - anchor + 1, len(data) - length + 1
    bits = np.uint64(max(1, int(len(name) - 1).bit_length()))
    # The smallest name, of equal ones the first: the place fills the low bits.
    key = (name >> bits << bits) | np.arange(len(name), dtype=np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    at = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    ends = np.r_[starts[1:], n] - 1
    place = at[starts]
    return place, name[place].view(np.int64), place - ends, place - starts


class Fingerprints:
    """Names of any string of a text in two independent lanes, from sums over its bytes."""

    def __init__(self, data: np.ndarray):
        self.sums, self.powers = [], []
        for values, base in _LANES:
            inverse = pow(base, -1, 2**64)
            powers = np.ones(len(data) + 1, dtype=np.uint64)
            powers[1:] = np.uint64(base)
            falling = np.ones(len(data) + 1, dtype=np.uint64)
            falling[1:] = np.uint64(inverse)
            np.multiply.accumulate(powers, out=powers)
            np.multiply.accumulate(falling, out=falling)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values[data] * falling[:-1], out=sums[1:])
            self.sums.append(sums)
            self.powers.append(powers)

    def of(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        name = (self.sums[lane][end] - self.sums[lane][start]) * self.powers[lane][start]
        name ^= name >> np.uint64(33)
        name *= _MIX
        return (name ^ (name >> np.uint64(31))).view(np.int64)


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: list[tuple] = []
        held = 0
        for row, data in zip(batch["row_id"], batch["data"]):
            place, name, near, far = anchors(np.frombuffer(data, dtype=np.uint8))
            if len(place):
                found.append((np.full(len(place), row), place, name, near, far))
                held += len(place)
            if held >= _CHUNK:
                yield _anchor_frame(found)
                found, held = [], 0
        if found:
            yield _anchor_frame(found)


def _anchor_frame(found: list[tuple]) -> pd.DataFrame:
    row, place, name, near, far = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame(
        {"row_id": row, "place": place, "name": name, "near": near.astype(np.int16), "far": far.astype(np.int16)}
    )


_ANCHOR_SCHEMA = "row_id long, place long, name long, near smallint, far smallint"
_RUN_SCHEMA = (
    "row_id long, place long, near smallint, far smallint, part smallint, witness boolean, core long, one long, two long"
)


def _cut_runs(width: int):
    """Runs of distances, cut to parts of `width` places, with the names of their common part and of all they cover."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for row, data, runs in zip(batch["row_id"], batch["data"], batch["runs"]):
                marks = Fingerprints(np.frombuffer(data, dtype=np.uint8))
                place = np.array([r["place"] for r in runs], dtype=np.int64)
                near = np.array([r["near"] for r in runs], dtype=np.int64)
                far = np.array([r["far"] for r in runs], dtype=np.int64)
                witness = np.array([r["witness"] for r in runs], dtype=bool)
                first, last = near // width, far // width
                count = last - first + 1
                of = np.repeat(np.arange(len(place)), count)
                part = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
                near, far, place = np.maximum(near[of], part * width), np.minimum(far[of], part * width + width - 1), place[of]
                reach = np.minimum(part * width + width - 1, LENGTH - ANCHOR)
                core = marks.of(place - part * width, place - reach + LENGTH, 0)
                start, end = place - far, place - near + LENGTH
                out.append(
                    (np.full(len(of), row), place, near, far, part, witness[of], core, marks.of(start, end, 0), marks.of(start, end, 1))
                )
                held += len(of)
                if held >= _CHUNK // 4:
                    yield _run_frame(out)
                    out, held = [], 0
            if out:
                yield _run_frame(out)

    return cut


def _run_frame(out: list[tuple]) -> pd.DataFrame:
    row, place, near, far, part, witness, core, one, two = (np.concatenate(x) for x in zip(*out))
    small = lambda x: x.astype(np.int16)
    return pd.DataFrame(
        {
            "row_id": row, "place": place, "near": small(near), "far": small(far), "part": small(part),
            "witness": witness, "core": core, "one": one, "two": two,
        }
    )


def _bucketed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row_id, doc_id and the bytes of every row, as a table bucketed by row_id in the shared folder."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        docs[key].alias("doc_id"),
        F.encode(F.coalesce(docs[text], F.lit("")), "UTF-8").alias("data"),
    )
    path = f"{shared_folder(spark)}/{name}"
    (
        rows.repartition(n, "row_id")
        .write.format("parquet")
        .option("path", path)
        .option("compression", "zstd")
        .bucketBy(n, "row_id")
        .sortBy("row_id")
        .saveAsTable(name)
    )
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.table(name)


def repeated_strings(texts: DataFrame) -> DataFrame:
    """row_id, start, end: intervals of `texts` (row_id, data) whose bytes are all covered by repeated strings."""
    found = saved(texts.select("row_id", "data").mapInPandas(_anchor_rows, _ANCHOR_SCHEMA))
    twice = found.groupBy("name").count().where("count > 1").select("name")
    open_runs = found.join(twice, "name", "left_semi").select(
        "row_id", F.struct("place", "near", "far", F.lit(False).alias("witness")).alias("run")
    )
    spans, read = [], found  # the table that `open_runs` reads
    for width in (LENGTH, *WIDTHS):
        per_row = open_runs.groupBy("row_id").agg(F.collect_list("run").alias("runs"))
        runs = saved(texts.join(per_row, "row_id").select("row_id", "data", "runs").mapInPandas(_cut_runs(width), _RUN_SCHEMA))
        freed(read)
        whole = ["part", "core", "near", "far", "one", "two"]
        classes = runs.groupBy(*whole).agg(
            F.count("*").alias("n"),
            F.min("row_id").alias("row_id"),
            F.min_by("place", "row_id").alias("place"),
            F.min(F.col("witness").cast("int")).alias("only_witness"),
        )
        classes = read = saved(classes)
        again = classes.where((F.col("n") > 1) & (F.col("only_witness") == 0)).select(*whole)
        hits = runs.where(~F.col("witness")).join(again, whole, "left_semi")
        spans.append(
            saved(
                hits.select(
                    "row_id",
                    (F.col("place") - F.col("far")).alias("start"),
                    (F.col("place") - F.col("near") + LENGTH).alias("end"),
                )
            )
        )
        freed(runs)
        if width == WIDTHS[-1]:
            freed(classes)
            break
        cores = classes.groupBy("part", "core").agg(
            F.count("*").alias("kinds"), F.max(((F.col("n") == 1) & (F.col("only_witness") == 0)).cast("int")).alias("unsettled")
        ).where("kinds > 1 and unsettled = 1")
        open_runs = classes.join(cores, ["part", "core"], "left_semi").select(
            "row_id",
            F.struct("place", "near", "far", ((F.col("n") > 1) | (F.col("only_witness") == 1)).alias("witness")).alias("run"),
        )
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cleaned_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for data, spans in zip(batch["data"], batch["spans"]):
            gone = _merged(spans) if spans is not None and len(spans) else []
            kept, at = [], 0
            for start, end in gone:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            rows.append(([{"start": a, "end": b} for a, b in gone], b"".join(kept)))
        yield pd.DataFrame(
            {
                "row_id": batch["row_id"], "doc_id": batch["doc_id"], "n_bytes": batch["data"].map(len),
                "removed": [r[0] for r in rows], "kept": [r[1] for r in rows],
            }
        )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, removed (maximal intervals), kept (the other bytes)."""
    texts = _bucketed(docs, key, text)
    spans = repeated_strings(texts).groupBy("row_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = T.StructType(
        [
            T.StructField("row_id", T.LongType()),
            T.StructField("doc_id", texts.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("removed", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    return (
        texts.join(spans, "row_id", "left")
        .select("row_id", "doc_id", "data", "spans")
        .mapInPandas(_cleaned_rows, kind)
    )


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` with the repeated strings cut out of `text` and `length` counted anew; all rows and columns stay.

    A character of which a cut took some bytes goes as a whole. Columns may have any names; a table without the
    column `length` gets none.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__row"), F.col(text))
    clean = remove_repeats(row, "__row", text).withColumn("__text", F.pandas_udf(_whole_characters, "string")(F.col("kept")))
    changed = {text: F.col("__text")}
    if length in docs.columns:
        changed[length] = F.length("__text").cast(docs.schema[length].dataType)
    return clean.select(*[changed.get(c, F.col("doc_id")[c]).alias(c) for c in docs.columns])


def _whole_characters(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: b.decode("utf-8", "ignore"))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def removed_by_brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """The definition, for tests: n_removed, n_spans, kept_sha256 of each text."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    """What is left of every document."""
    return digest(remove_repeats(table(spark, sf_dir, "documents")))
