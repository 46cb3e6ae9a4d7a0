"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

A window is `window` tokens of the packed stream. In every round each source
gains its share of a window as credit and sends as many whole quanta from its
queue as its credit pays for; what is left over is carried to the next round,
across windows, partitions and tasks. Because credit grows linearly, the round in
which a quantum leaves is a formula of its place in its queue, so no task has to
know another's state: places come from prefix sums over narrow rows.

The stream is cut every `length` tokens. Its last part is cut into powers of two,
so nothing has to be padded.

Shares default to each source's part of all tokens, with which all queues end in
the last window. With `targets`, a source's share is its weight (1 if absent);
when a queue is empty the others go on in their proportions to each other.

Defined cases: a null or empty text is the end token alone. A null source is the
queue ''. Repeated rows and repeated doc_ids are separate documents. An empty
table gives no pieces. Only the three named columns are read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table
from .store import freed, saved

LENGTH = 1024
WINDOW = 64 * LENGTH
QUANTUM = 256
#: Buckets of a queue by hash of doc_id: the largest part of one source that is summed in one task.
BUCKETS = 4096
_BLOCK = 1024


@lru_cache(maxsize=2)
def _encoding(ranks_path: str, special: tuple[tuple[str, int], ...]):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special)
    )


def token_ids(text: Column, ranks_path: str, special: dict[str, int], end: int) -> Column:
    """Ids of a text and the end token, little-endian unsigned 32-bit in a binary."""
    special_items = tuple(special.items())

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks_path, special_items).encode_to_numpy
        last = np.array([end], dtype="<u4").tobytes()
        return texts.map(lambda t: encode(t, allowed_special="all").astype("<u4").tobytes() + last if t else last)

    return ids(text)


def tokenised(
    docs: DataFrame,
    ranks_path: str,
    special: dict[str, int],
    end: int = 0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """row_id, doc_id, source, ids, n_tokens: a table written once, so row_id is the same for all readers."""
    rows = docs.select(
        docs[key].alias("doc_id"),
        F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"),
        token_ids(docs[text], ranks_path, special, end).alias("ids"),
    )
    return saved(
        rows.withColumns(
            {"row_id": F.monotonically_increasing_id(), "n_tokens": (F.octet_length("ids") / 4).cast("bigint")}
        )
    )


def _queue_places(tokens: DataFrame, buckets: int) -> DataFrame:
    """row_id, doc_id, source, n_tokens, the size of its source's queue, and first: its first token's place there."""
    rows = tokens.select(
        "row_id", "doc_id", "source", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    )
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    queue = Window.partitionBy("source")
    before = sums.select(
        "source",
        "bucket",
        (F.sum("n").over(queue.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(queue).alias("size"),
    )
    inside = F.sum("n_tokens").over(
        Window.partitionBy("source", "bucket").orderBy("doc_id", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("inside", inside - F.col("n_tokens"))
        .join(before, ["source", "bucket"])
        .select("row_id", "doc_id", "source", "n_tokens", "size", (F.col("before") + F.col("inside")).alias("first"))
    )


def _sent(rate: str, per: str, size: str, at: str, quantum: int) -> Column:
    """Tokens a queue of `size` has sent after round `at`, when its credit grows by rate / per a round."""
    return F.expr(
        f"case when cast({rate} as decimal(19,0)) * ({at}) >= cast({size} as decimal(19,0)) * {per} then {size} "
        f"else {quantum} * ((cast({rate} as decimal(19,0)) * ({at})) div (cast({per} as decimal(19,0)) * {quantum})) end"
    ).cast("bigint")


def schedule(
    tokens: DataFrame,
    length: int = LENGTH,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    buckets: int = BUCKETS,
    targets: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of the rows of `tokens`: row_id, doc_id, doc_tokens, start, length, window, sequence_id, offset."""
    places = saved(_queue_places(tokens, buckets))
    total = places.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if targets is None:
        rounds = -(-total // window) or 1
        rate, per = F.col("size"), rounds
    else:
        weight = F.lit(1).cast("bigint")
        for name, value in targets.items():
            weight = F.when(F.col("source") == name, F.lit(value).cast("bigint")).otherwise(weight)
        rate = weight * window
        per = places.select("source").distinct().agg(F.coalesce(F.sum(weight), F.lit(1))).first()[0]

    # The round in which a quantum leaves: the first whose credit covers the quantum's end.
    quanta = F.expr(f"sequence(first div {quantum}, (first + n_tokens - 1) div {quantum})")
    due = lambda c: F.least((c + 1) * quantum, F.col("size")).cast("decimal(19,0)") * F.col("per")
    rounds_of = F.array_distinct(
        F.transform(quanta, lambda c: F.call_function("div", due(c) + F.col("rate") - 1, F.col("rate")))
    )
    units = (
        places.withColumns({"rate": rate, "per": F.lit(per).cast("bigint")})
        .withColumn("round", F.explode(rounds_of))
        .withColumns(
            {
                "gone": _sent("rate", "per", "size", "round - 1", quantum),
                "goes": _sent("rate", "per", "size", "round", quantum),
            }
        )
        .select(
            "row_id",
            "doc_id",
            F.col("n_tokens").alias("doc_tokens"),
            "source",
            "round",
            "gone",
            (F.greatest("first", "gone") - F.col("first")).alias("start"),
            (F.least(F.col("first") + F.col("n_tokens"), F.col("goes")) - F.greatest("first", "gone")).alias("n"),
            (F.greatest("first", "gone") - F.col("gone")).alias("inside"),
        )
        .where("n > 0")
    )
    units = saved(units)
    freed(places)
    # Where each source's part of each round begins in the stream: sums per round, per block of rounds, and over blocks.
    parts = units.groupBy("round", "source").agg(F.sum("n").alias("n"))
    per_round = parts.groupBy("round").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"round div {_BLOCK}"))
    per_block = per_round.groupBy("block").agg(F.sum("n").alias("n"))
    running = lambda w: F.sum("n").over(w) - F.col("n")
    blocks = per_block.select("block", running(Window.orderBy("block")).alias("block_at"))
    rounds_at = (
        per_round.withColumn("in_block", running(Window.partitionBy("block").orderBy("round")))
        .join(blocks, "block")
        .select("round", (F.col("block_at") + F.col("in_block")).alias("round_at"))
    )
    parts_at = (
        parts.withColumn("in_round", running(Window.partitionBy("round").orderBy("source")))
        .join(rounds_at, "round")
        .select("round", "source", (F.col("round_at") + F.col("in_round")).alias("part_at"))
    )
    streamed = units.join(parts_at, ["round", "source"]).withColumn("at", F.col("part_at") + F.col("inside"))

    # Sequences: every `length` tokens, the rest in powers of two.
    whole, rest = divmod(total, length)
    tail, at = [], whole * length
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            tail.append((whole + len(tail), at, at + (1 << bit)))
            at += 1 << bit
    box = lambda s, a, b: F.struct(
        s.cast("bigint").alias("s"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b")
    )
    last = (
        F.array(*[box(F.lit(s), F.lit(a), F.lit(b)) for s, a, b in tail])
        if tail
        else F.array().cast("array<struct<s:bigint,a:bigint,b:bigint>>")
    )
    full = F.transform(
        F.expr(f"sequence(at div {length}, (at + n - 1) div {length})"),
        lambda s: box(s, s * length, (s + 1) * length),
    )
    boxes = F.concat(
        F.filter(full, lambda x: x["s"] < whole),
        F.filter(last, lambda x: (x["a"] < F.col("at") + F.col("n")) & (x["b"] > F.col("at"))),
    )
    return (
        streamed.withColumn("box", F.explode(boxes))
        .withColumns(
            {"from": F.greatest("at", "box.a"), "to": F.least(F.col("at") + F.col("n"), F.col("box.b"))}
        )
        .select(
            "row_id",
            "doc_id",
            "doc_tokens",
            (F.col("start") + F.col("from") - F.col("at")).alias("start"),
            (F.col("to") - F.col("from")).alias("length"),
            F.col("round").alias("window"),
            F.col("box.s").alias("sequence_id"),
            (F.col("from") - F.col("box.a")).alias("offset"),
        )
    )


def packed(docs: DataFrame, ranks_path: str, special: dict[str, int], end: int = 0, **options) -> DataFrame:
    """Pieces with their ids. Options go to `tokenised` (key, source, text) and `schedule`."""
    columns = {k: options.pop(k) for k in ("key", "source", "text") if k in options}
    tokens = tokenised(docs, ranks_path, special, end, **columns)
    pieces = schedule(tokens, **options)
    cut = F.col("ids").substr((F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.join(tokens.select("row_id", "ids"), "row_id").withColumn("ids", cut).drop("row_id")


def packed_documents(docs: DataFrame) -> DataFrame:
    """The production form: the public 50k byte-level vocabulary, its end-of-text string as one id, end token 0."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256})


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window"
    )


@query("op8_packing")
def op8_packing(spark, sf_dir):
    """Every piece of every document with its place."""
    return digest(packed_documents(table(spark, sf_dir, "documents")))
