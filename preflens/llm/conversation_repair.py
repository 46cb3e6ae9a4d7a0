"""Conversation structure repair: the cheapest edits that make the roles alternate, by a grammar-compressed DP.

A conversation's rows, in turn order, become one symbol each: the class of its
role's first letter (s, u, a or another) and its fault. Of a row's faults the
first of these counts: blank (no character outside `[\\x20\\x09-\\x0D]`), duplicate
(role and text stood earlier in the conversation), truncated (the last such
character is none of `.!?`). Kept and inserted rows must spell `(s?(ua)+)?`.
Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit for blank
and duplicate rows), Insert an empty user or assistant row 2; a truncated row
that stays adds 1. Of the cheapest audits (the edits' initials) the ASCII-least
is taken. It settles the roles: after nothing, `s` or `a` comes a user, after `u`
an assistant.

Re-Pair: Spark counts neighbouring symbols over all distinct sequences, weighted
by the conversations that have them; the most frequent pairs that do not touch
each other become rules, and the sequences are rewritten, round by round, until
no pair occurs twice or the grammar has `RULES` rules or `ROUNDS` rounds. That
limits the grammar only: symbols left over are folded one by one, with the same
result. Every rule has one min-plus transfer matrix over the four states of the
pattern, the product of its parts' matrices, so it is evaluated once, bottom-up,
for all conversations whose sequence holds it. Its entries are a cost and an audit
rope, a concatenation that shares the parts' ropes. Equal costs compare ropes,
skipping what both share. (One of two different audits of equal cost for the same
rows and states is never the start of the other, as each ends with a row's letter
and an insertion costs; so the least audit of a whole has the least ones as parts.)

Texts meet in one task per conversation, in order and as a stream: the hash and
the audit of a conversation are one sequence by definition. What a task holds of
a conversation is a letter a row and 16 bytes for each of its different rows.

Defined cases: a null role or text is one space. Null turns come first; equal
turns go by role, then text; equal rows stay neighbours. A null conv_id is one
conversation. An empty role has no letter and cannot be kept. A conversation
whose rows are all `gone` has zeros, an empty audit and no repaired row. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.operators.skew import join_lookup

from .registry import query, table
from .store import rows_per_batch, saved

RULES = 4096
ROUNDS = 12
CANDIDATES = 1024
BATCH_ROWS = 256

#: The symbols: small letters are sound rows, capitals truncated ones, x has to go.
SYMBOLS = "suaoSUAOx"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1

#: States: nothing yet, after s, after u, after a. The pattern may end in the first and the last.
STATES = range(4)
ENDS = (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only role that can be put in at each state.
WANTED = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

_BLANKS = " \t\n\x0b\f\r"


# --- ropes and transfer matrices ------------------------------------------------


class Node:
    """A concatenation of two ropes. A rope is a string or a node."""

    __slots__ = ("size", "left", "right")

    def __init__(self, left, right, size):
        self.left, self.right, self.size = left, right, size


def size(rope) -> int:
    return len(rope) if isinstance(rope, str) else rope.size


def joined(left, right):
    if not size(left):
        return right
    if not size(right):
        return left
    total = size(left) + size(right)
    if total <= 64 and isinstance(left, str) and isinstance(right, str):
        return left + right
    return Node(left, right, total)


def flat(rope) -> str:
    out, rest = [], [rope]
    while rest:
        top = rest.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            rest += (top.right, top.left)
    return "".join(out)


def less(a, b) -> bool:
    """a < b as strings; parts that are the same object on both sides are not looked into."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            left += [x[n:]] if len(x) > n else []
            right += [y[n:]] if len(y) > n else []
            continue
        open_x = isinstance(x, Node) and (isinstance(y, str) or x.size >= y.size)
        open_y = isinstance(y, Node) and (isinstance(x, str) or y.size >= x.size)
        left += (x.right, x.left) if open_x else (x,)
        right += (y.right, y.left) if open_y else (y,)
    return bool(right) and not left


def better(a, b) -> bool:
    """Whether entry a (cost, rope) beats entry b; None is no way at all."""
    if a is None or b is None:
        return a is not None
    return a[0] < b[0] or (a[0] == b[0] and less(a[1], b[1]))


def times(row, matrix) -> list:
    """One row of a min-plus product."""
    out = []
    for j in STATES:
        best = None
        for k in STATES:
            if row[k] is not None and matrix[k][j] is not None:
                cost = row[k][0] + matrix[k][j][0]
                if best is None or cost <= best[0]:
                    entry = cost, joined(row[k][1], matrix[k][j][1])
                    best = entry if better(entry, best) else best
        out.append(best)
    return out


def product(a, b) -> list:
    return [times(row, b) for row in a]


def insertions() -> list:
    """Cheapest insertions that lead from state to state."""
    matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        state, entry = i, (0, "")
        while better(entry, matrix[i][state]):
            matrix[i][state] = entry
            state, entry = STEP[state, WANTED[state]], (entry[0] + INSERT, entry[1] + "I")
    return matrix


INSERTIONS = insertions()
NO_ROW = [[(0, "") if i == j else None for j in STATES] for i in STATES]


@lru_cache(maxsize=None)
def symbol_matrix(letter: str) -> list:
    """Insertions, then the edit of one row."""
    edits = [[None] * 4 for _ in STATES]
    for i in STATES:
        edits[i][i] = (DELETE, "D")
        if letter == "x":
            continue
        extra = TRUNCATED if letter.isupper() else 0
        ways = [(WANTED[i], (REROLE + extra, "R"))]
        ways += [(letter.lower(), (KEEP + extra, "K"))] if (i, letter.lower()) in STEP else []
        for role, entry in ways:
            j = STEP[i, role]
            edits[i][j] = entry if better(entry, edits[i][j]) else edits[i][j]
    return product(INSERTIONS, edits)


class Grammar:
    """Rules (pairs of symbol numbers; the alphabet's come first) and their matrices, each made once when needed."""

    def __init__(self, rules: Iterable[tuple[int, int]] = ()):
        self.rules = list(rules)
        self.matrices: dict[int, list] = {}

    def matrix(self, symbol: int) -> list:
        if symbol < len(SYMBOLS):
            return symbol_matrix(SYMBOLS[symbol])
        if symbol not in self.matrices:
            # Parts have smaller numbers, so bottom-up order is numeric order.
            needed, rest = set(), [symbol]
            while rest:
                top = rest.pop()
                if top >= len(SYMBOLS) and top not in self.matrices and top not in needed:
                    needed.add(top)
                    rest += self.rules[top - len(SYMBOLS)]
            for one in sorted(needed):
                left, right = self.rules[one - len(SYMBOLS)]
                self.matrices[one] = product(self.matrix(left), self.matrix(right))
        return self.matrices[symbol]

    def cheapest(self, symbols: Iterable[int]) -> tuple[int, str]:
        """Cost and audit of a sequence."""
        row = NO_ROW[0]
        for symbol in symbols:
            row = times(row, self.matrix(symbol))
        best = None
        for entry in (times(row, INSERTIONS)[end] for end in ENDS):
            best = entry if better(entry, best) else best
        return best[0], flat(best[1])


# --- rows and faults -------------------------------------------------------------


def _prepared(rows: DataFrame, key: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    known = lambda name: F.coalesce(rows[name], F.lit(" "))
    return rows.select(
        rows[key].cast("long").alias("conv_id"),
        rows[turn].cast("long").alias("turn"),
        known(role).alias("role"),
        known(text).alias("text"),
        (F.lit(False) if gone is None else F.coalesce(rows[gone], F.lit(False))).alias("gone"),
    )


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterable[tuple], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `limit` rows and some 8 million characters."""
    held, chars = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= limit or chars >= 8_000_000:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


FAULTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, sequence string"
_FAULTS = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")] + [("sequence", pa.string())]
)


def symbol(role: str, text: str, again: bool) -> str:
    last = text.rstrip(_BLANKS)[-1:]
    if not last or again:
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter if last in ".!?" else letter.upper()


def _faults_of(conv_id, rows: Iterator[tuple]) -> tuple:
    """The measures of one conversation's rows, in order."""
    seen: set[bytes] = set()
    turns, low, high, before = 0, None, None, None
    blank = duplicate = truncated = illegal = 0
    letters = []
    for _, turn, role, text, gone in rows:
        if gone:
            continue
        if turn is not None and turn != high:
            turns, low, high = turns + 1, turn if low is None else low, turn
        if before is not None:
            illegal += before + role[:1] not in LEGAL
        before = role[:1]
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        letter = symbol(role, text, name in seen)
        seen.add(name)
        letters.append(letter)
        if letter == "x" and not text.strip(_BLANKS):
            blank += 1
        elif letter == "x":
            duplicate += 1
        elif letter.isupper():
            truncated += 1
    gaps = 0 if low is None else high - low + 1 - turns
    return conv_id, gaps, blank, duplicate, truncated, illegal, "".join(letters)


def faults(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """One row per conversation: its counts of faults and its sequence of symbols."""
    ordered = _prepared(rows, key, turn, role, text, gone).repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")

    def measured(batches):
        found = (_faults_of(k, group) for k, group in groupby(_records(batches), key=lambda r: r[0]))
        return _batches(found, _FAULTS, 4096)

    return ordered.mapInArrow(measured, FAULTS)


# --- the grammar and the plans ---------------------------------------------------


def _chosen(candidates: list, room: int) -> list[tuple[int, int]]:
    """The most frequent pairs of which no two can overlap in a sequence."""
    firsts, seconds, pairs = set(), set(), []
    for left, right in candidates:
        if len(pairs) == room or left in seconds or right in firsts or (left == right and (left in firsts or left in seconds)):
            continue
        firsts.add(left)
        seconds.add(right)
        pairs.append((left, right))
    return pairs


def rewritten(symbols: Iterable[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """The sequence with each pair that has a rule replaced, from the left."""
    out: list[int] = []
    for s in symbols:
        rule = rules.get((out[-1], s)) if out else None
        if rule is None:
            out.append(s)
        else:
            out[-1] = rule
    return out


def compressed(sequences: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """sequence, symbols for every distinct sequence, and the rules of the grammar they share."""

    @F.pandas_udf("array<int>")
    def numbered(column):
        return column.map(lambda letters: [SYMBOLS.index(c) for c in letters])

    counted = sequences.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))
    now = saved(counted.withColumn("symbols", numbered("sequence")))
    rules: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        starts = F.sequence(F.lit(1), F.size("symbols") - 1)
        pairs = now.where(F.size("symbols") > 1).select(
            "n", F.explode(F.transform(starts, lambda i: F.struct(F.get("symbols", i - 1).alias("a"), F.get("symbols", i).alias("b")))).alias("p")
        )
        found = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).where("n > 1")
        candidates = found.orderBy(F.desc("n"), "a", "b").limit(CANDIDATES).collect()
        fresh = _chosen([(r.a, r.b) for r in candidates], RULES - len(rules))
        if not fresh:
            break
        numbers = {pair: len(SYMBOLS) + len(rules) + i for i, pair in enumerate(fresh)}
        rules += fresh

        @F.pandas_udf("array<int>")
        def rewrite(column):
            return column.map(lambda symbols: rewritten(symbols, numbers))

        now = saved(now.withColumn("symbols", rewrite("symbols")))
    return now.select("sequence", "symbols"), rules


@lru_cache(maxsize=2)
def _grammar(rules: tuple[tuple[int, int], ...]) -> Grammar:
    """A worker's grammar, so that all its tasks share the matrices."""
    return Grammar(rules)


def plans(sequences: DataFrame) -> DataFrame:
    """sequence, cost, audit for every distinct value of the column `sequence`."""
    table_, rules = compressed(sequences)
    fixed = tuple(rules)
    schema = pa.schema([("sequence", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def evaluated(batches):
        grammar = _grammar(fixed)
        return _batches(((s, *grammar.cheapest(symbols)) for s, symbols in _records(batches)), schema, 4096)

    return table_.mapInArrow(evaluated, "sequence string, cost long, audit string")


def repair_plans(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """One row per conversation: faults, cost and audit; a table written once.

    `gone` names a boolean column of rows that only stand for their conversation.
    """
    with rows_per_batch(rows.sparkSession, BATCH_ROWS):
        measured = saved(faults(rows, key, turn, role, text, gone))
    found = saved(plans(measured.select("sequence")))
    # One sequence may belong to a third of all conversations.
    return saved(join_lookup(measured, found, ["sequence"]).drop("sequence"))


# --- the repaired conversations ---------------------------------------------------


REPAIRED = "conv_id long, place long, edit string, role string, text string"
_REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
)


def _repaired_of(conv_id, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Applies the audit, which comes as the first row's text, to the rows behind it."""
    audit = next(rows)[4]
    state, place, at = 0, 0, 0
    yield conv_id, -1, None, None, None

    def put(edit, role, text):
        nonlocal state, place
        initial = role[:1]
        state, place = STEP[state, initial], place + 1
        return conv_id, place - 1, edit, role, text

    for _, _, _, role, text, gone in rows:
        if gone:
            continue
        while audit[at] == "I":
            yield put("I", NAMES[WANTED[state]], "")
            at += 1
        if audit[at] == "K":
            yield put("K", role, text)
        elif audit[at] == "R":
            yield put("R", NAMES[WANTED[state]], text)
        at += 1
    for _ in audit[at:]:
        yield put("I", NAMES[WANTED[state]], "")


def repaired(
    rows: DataFrame,
    planned: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    gone: str | None = None,
) -> DataFrame:
    """conv_id, place, edit, role, text: the rows after repair, each conversation in order in one partition.

    Each conversation is led by a row of place -1 without a role, so that none is lost.
    """
    heads = planned.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(False).alias("gone"),
    )
    body = _prepared(rows, key, turn, role, text, gone).withColumn("kind", F.lit(1))
    ordered = heads.unionByName(body).repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "kind", "turn", "role", "text")

    def applied(batches):
        groups = groupby(_records(batches), key=lambda r: r[0])
        return _batches(chain.from_iterable(_repaired_of(k, g) for k, g in groups), _REPAIRED, BATCH_ROWS)

    return ordered.mapInArrow(applied, REPAIRED)


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` lines, read off the rows of `repaired` as they come."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(rows):
        total = hashlib.sha256()
        for _, place, _, role, text in rows:
            if place >= 0:
                line = f"{role}:{text}" if place == 0 else f"\n{role}:{text}"
                total.update(line.encode("utf-8", "surrogatepass"))
        return total.hexdigest()

    def hashed(batches):
        groups = groupby(_records(batches), key=lambda r: r[0])
        return _batches(((k, digest(g)) for k, g in groups), schema, 4096)

    return fixed.mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a hash of conv_id and turn; dropped ones are marked `gone`."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), code.alias("code"))
    text = F.col("text")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (F.col("code") == 0).alias("gone"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    """Faults, cheapest repair and repaired text of every damaged conversation."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    planned = repair_plans(rows, gone="gone")
    with rows_per_batch(spark, BATCH_ROWS):
        hashes = saved(digests(repaired(rows, planned, gone="gone")))
    return planned.join(hashes, planned["conv_id"].eqNullSafe(hashes["conv_id"])).drop(hashes["conv_id"])
