"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. A text is cut by a pattern, and each piece runs through a finite-state
transducer. Its input are bytes; a transition's output is the last token of what
was read so far. A state is a node of the token automaton (the longest end of
the input that may become a token) with the last token before every place inside
it. Tokens are emitted as soon as all places where a token may still begin agree
on what came before, so what is held back is bounded by a few token lengths.
States and transitions come into being when first needed and are dropped
together when there are too many, so memory is bounded.

Two tokens may follow each other exactly if merging the bytes of both by rank
leaves them as they are. Every piece has exactly one such sequence, the one that
merging the whole piece gives. This needs ranks in which every token's own bytes
merge to that token, and every merge's rank is above those of its parts; the
constructor refuses others.

Decoding feeds token bytes to an incremental UTF-8 automaton that holds back an
unfinished character until its last byte arrives.

Defined cases: null and empty texts give no ids and decode to an empty text.
Pieces and texts of any length take linear time. Other columns are untouched.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import query, table

MAX_STATES = 250_000
MAX_PIECES = 250_000
_NEVER = 1 << 62


class _State:
    """A node of the token automaton with the last token before every place where a token may still begin."""

    __slots__ = ("node", "lasts", "token", "next")

    def __init__(self, node: int, lasts: tuple[int, ...]):
        self.node = node
        self.lasts = lasts
        self.token = lasts[-1]  # the last token of what was read, -1 at the start
        self.next: dict[int, _State] = {}


class Transducer:
    """Bytes of a piece to token ids. `ranks`: token bytes -> id, in the order of merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.length = {i: len(b) for b, i in ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.longest = max(self.length.values())
        self._automaton()
        self._spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._forget()

    def _automaton(self) -> None:
        """The trie of the tokens, with the longest proper suffix of each node that is a node too."""
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.spelt = [-1]  # the token a node spells, -1 if none
        self.depth = [0]
        self.suffix = [0]
        level = [(0, token) for token in self.ranks]
        place = 0
        while level:
            deeper = []
            for node, token in level:
                edge = node << 8 | token[place]
                there = self.child.get(edge)
                if there is None:
                    there = self.child[edge] = len(self.spelt)
                    self.spelt.append(-1)
                    self.depth.append(place + 1)
                    self.suffix.append(self._go(self.suffix[node], token[place]) if node else 0)
                if len(token) == place + 1:
                    self.spelt[there] = self.ranks[token]
                else:
                    deeper.append((there, token))
            level, place = deeper, place + 1

    def _go(self, node: int, byte: int) -> int:
        while (there := self.child.get(node << 8 | byte)) is None and node:
            node = self.suffix[node]
        return there or 0

    def _forget(self) -> None:
        self.start = _State(0, (-1,))
        self.states = {(0, (-1,)): self.start}

    def _merge(self, token: bytes) -> list[list[bytes]]:
        """The parts of a token's bytes after each merge by rank."""
        parts = [token[i : i + 1] for i in range(len(token))]
        history = [list(parts)]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == _NEVER:
                raise ValueError(f"the bytes of {token!r} do not merge to this token")
            if rank < max(self.ranks[parts[i]], self.ranks[parts[i + 1]]) and min(len(parts[i]), len(parts[i + 1])) > 1:
                raise ValueError(f"the rank of {parts[i] + parts[i + 1]!r} is below those of its parts")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            history.append(list(parts))
        return history

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The outermost part of a token as it grows, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self._spines:
            outer = [parts[-1 if right else 0] for parts in self._merge(self.bytes_of[token])]
            grown = [p for i, p in enumerate(outer) if i == 0 or p != outer[i - 1]]
            self._spines[key] = [(p, self.ranks[q]) for p, q in zip(grown, grown[1:])] + [(grown[-1], _NEVER)]
        return self._spines[key]

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of both tokens merge to just these two: no merge reaches across while they grow."""
        known = self._follows.get((a, b))
        if known is None:
            left, right = self._spine(a, True), self._spine(b, False)
            i = j = 0
            while True:
                (x, grows_x), (y, grows_y) = left[i], right[j]
                across = self.ranks.get(x + y, _NEVER)
                # Of equal ranks the leftmost merges first.
                if across < grows_x and across <= grows_y and across != _NEVER:
                    known = False
                    break
                if grows_x == grows_y == _NEVER:
                    known = True
                    break
                if grows_x <= grows_y:
                    i += 1
                else:
                    j += 1
            if len(self._follows) > 4 * MAX_STATES:
                self._follows.clear()
            self._follows[(a, b)] = known
        return known

    def _grow(self, state: _State, byte: int) -> _State:
        """The transition for a byte that a state has not seen."""
        node = end = self._go(state.node, byte)
        known = state.lasts[-self.depth[node] :]
        while True:
            token = self.spelt[end]
            if token >= 0:
                before = known[-self.depth[end]]
                if before < 0 or self.follows(before, token):
                    break
            end = self.suffix[end]
            if not end:
                raise ValueError("no token sequence for these bytes")
        key = (node, (*known, token))
        after = self.states.get(key)
        if after is None:
            if len(self.states) >= MAX_STATES:
                self._forget()
            after = self.states[key] = _State(*key)
        state.next[byte] = after
        return after

    def _settled(self, tokens: list[int], live: int) -> int:
        """The last place that the token sequences up to each of the last `live` places have in common."""
        places = set(range(len(tokens) - live, len(tokens) + 1))
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.length[tokens[last - 1]])
        return places.pop()

    def _read_back(self, tokens: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(tokens[end - 1])
            end -= self.length[tokens[end - 1]]
        out.reverse()
        return out

    def run(self, piece: Iterable[int]) -> Iterator[list[int]]:
        """Ids as they become certain. What is held back are the bytes since the last certain place."""
        state, tokens, step = self.start, [], 8 * self.longest
        for byte in piece:
            state = state.next.get(byte) or self._grow(state, byte)
            tokens.append(state.token)
            if len(tokens) >= step:
                end = self._settled(tokens, len(state.lasts) - 1)
                yield self._read_back(tokens, end)
                del tokens[:end]
                step = len(tokens) + 8 * self.longest
        yield self._read_back(tokens, len(tokens))

    def encode(self, piece: bytes) -> bytes:
        """Ids of a whole piece, four bytes each."""
        packed = self.packed
        if len(piece) >= 8 * self.longest:
            return b"".join(map(packed.__getitem__, chain.from_iterable(self.run(piece))))
        state, tokens = self.start, []
        for byte in piece:
            state = state.next.get(byte) or self._grow(state, byte)
            tokens.append(state.token)
        end = len(tokens)
        out = b""
        while end:
            token = tokens[end - 1]
            out = packed[token] + out
            end -= self.length[token]
        return out


def single_byte_pattern(pattern: str) -> str:
    """The pattern for texts of characters below U+0100, with classes written out, for the faster engine."""
    below = [chr(c) for c in range(256)]

    def spelt(name: str) -> str:
        return "".join(f"\\x{ord(c):02x}" for c in below if regex.match(name, c))

    names = {name: spelt(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\[sS]|[\[\]])", pattern):
        if part in "[]":
            inside = part == "[" if part else inside
        if part == r"\S":
            if inside:
                raise ValueError("a negated class inside brackets")
            part = f"[^{names[chr(92) + 's']}]"
        elif part in names:
            part = names[part] if inside else f"[{names[part]}]"
        out.append(part)
    return "".join(out)


class Encoder(dict):
    """Texts to ids; also the memory of pieces, so that a frequent one runs through the transducer once.

    A piece's ids are kept as the bytes they take in a result, so a text's ids are these joined.
    When the memory is full it becomes the old one; pieces met again come back from there.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.pieces_below_256 = re.compile(single_byte_pattern(pattern)).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            pieces = self.pieces_below_256(text)
        except UnicodeEncodeError:
            pieces = self.pieces(text)
        return b"".join(map(self.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), dtype="<u4")


#: Bytes that an unfinished character still waits for, by its first byte.
def _length(first: int) -> int:
    return 2 if 0xC2 <= first <= 0xDF else 3 if 0xE0 <= first <= 0xEF else 4 if 0xF0 <= first <= 0xF4 else 1


class Utf8Stream:
    """Incremental UTF-8: what was fed so far, without an unfinished last character, becomes text."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        end = len(data)
        for back in range(1, min(3, end) + 1):
            byte = data[end - back]
            if byte & 0xC0 != 0x80:  # the last character starts here
                if _length(byte) > back:
                    end -= back
                break
        self.pending = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], token_bytes: dict[int, bytes], step: int = 4096) -> Iterator[str]:
    """Text chunks of an id stream, `step` ids at a time."""
    stream, data = Utf8Stream(), map(token_bytes.__getitem__, ids)
    while chunk := list(islice(data, step)):
        yield stream.feed(b"".join(chunk))
    yield stream.close()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker. Its many small objects live long, so the cyclic collector looks at them rarely."""
    gc.set_threshold(100_000, 50, 100)
    return Encoder(read_ranks(path), pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers in a binary."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        run = encoder(path, pattern).encode_packed
        return texts.map(lambda t: run(t) if t else b"")

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Text of a binary of little-endian unsigned 32-bit ids; wrong UTF-8 becomes U+FFFD."""

    @F.pandas_udf("string")
    def texts(blobs: pd.Series) -> pd.Series:
        token_bytes = encoder(path, pattern).transducer.bytes_of
        return blobs.map(
            lambda b: "".join(decode_stream(np.frombuffer(b or b"", dtype="<u4").tolist(), token_bytes))
        )

    return texts(ids)


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    """Every document encoded, and the ids decoded again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", encode(F.col("text"), path, pattern).alias("ids"))
    read = coded.select("doc_id", "ids", decode(F.col("ids"), path, pattern).alias("text"))
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
