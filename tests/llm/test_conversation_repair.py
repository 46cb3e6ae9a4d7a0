import hashlib
import itertools
import random
import re
import zlib

import pytest

from preflens.llm import conversation_repair as c
from preflens.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
PATTERN = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\f\r"


def every_audit(letters):
    """All audits with at most two insertions at a place, with their costs: tried one by one."""
    gaps = ["", "I", "II"]
    edits = [("D",) if x == "x" else ("D", "K", "R") for x in letters]
    for ins in itertools.product(gaps, repeat=len(letters) + 1):
        for row in itertools.product(*edits):
            yield "".join(a + b for a, b in zip(ins, row)) + ins[-1]


def cost_of(audit, letters):
    """Cost of an audit, or None if no roles make it fit."""
    cost, spelled, rows = 0, [""], iter(letters)
    for edit in audit:
        letter = next(rows) if edit != "I" else ""
        cost += {"K": 0, "R": 2, "D": 3, "I": 2}[edit] + (edit in "KR" and letter.isupper())
        new = [""] if edit == "D" else [letter.lower()] if edit == "K" else ["u", "a"]
        spelled = [a + b for a in spelled for b in new if re.fullmatch("s?(ua)*u?", a + b)]
    return cost if any(PATTERN.fullmatch(x) for x in spelled) else None


def brute(letters):
    found = ((cost_of(a, letters), a) for a in every_audit(letters))
    return min(f for f in found if f[0] is not None)


def simple(letters):
    """The same by a plain DP over rows with whole strings; checked against `brute` below."""
    def inserted(states):
        for _ in range(3):
            for i, (cost, audit) in list(states.items()):
                j = c.STEP[i, c.WANTED[i]]
                states[j] = min(states.get(j, (10**9, "")), (cost + 2, audit + "I"))
        return states

    states = {0: (0, "")}
    for x in letters:
        new = {}
        for i, (cost, audit) in inserted(dict(states)).items():
            extra = x.isupper()
            steps = [(i, 3, "D")]
            if x != "x":
                steps += [(c.STEP[i, r], 2 + extra, "R") for r in "ua" if (i, r) in c.STEP]
                steps += [(c.STEP[i, x.lower()], 0 + extra, "K")] if (i, x.lower()) in c.STEP else []
            for j, more, e in steps:
                new[j] = min(new.get(j, (10**9, "")), (cost + more, audit + e))
        states = new
    return min(v for k, v in inserted(dict(states)).items() if k in (0, 3))


def reference(rows):
    """All columns of one conversation from its rows (turn, role, text), in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    letters, seen, n = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        x = role[:1] if role[:1] in set("sua") else "o"
        letters.append("x" if fault in ("blank", "duplicate") else x.upper() if fault else x)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = simple(letters)
    lines, rest, last = [], iter(rows), ""
    for e in audit:
        _, role, text = next(rest) if e != "I" else (None, None, "")
        if e == "D":
            continue
        role = role if e == "K" else "assistant" if last == "u" else "user"
        last = role[:1]
        lines.append(f"{role}:{text}")
    assert PATTERN.fullmatch("".join(line[:1] for line in lines))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)


def test_plain_dp_equals_trying_every_audit():
    for n in range(4):
        for letters in itertools.product(c.SYMBOLS, repeat=n):
            if n < 3 or zlib.crc32("".join(letters).encode()) % 60 == 0:
                assert simple(letters) == brute(letters), letters


def test_grammar_equals_the_plain_dp():
    rng = random.Random(1)
    for _ in range(150):
        letters = [rng.choice(c.SYMBOLS if rng.random() < 0.5 else "ua") for _ in range(rng.randrange(0, 200))]
        symbols, rules = [c.SYMBOLS.index(x) for x in letters], []
        for _ in range(8):
            pairs = c._chosen(sorted(set(zip(symbols, symbols[1:])), key=lambda p: rng.random()), 3)
            numbers = {p: len(c.SYMBOLS) + len(rules) + i for i, p in enumerate(pairs)}
            rules += pairs
            shorter = c.rewritten(symbols, numbers)
            assert not pairs or len(shorter) < len(symbols)
            symbols = shorter
        assert c.Grammar(rules).cheapest(symbols) == simple(letters)


def test_a_very_long_regular_conversation_shares_its_matrices():
    symbols, rules = [c.SYMBOLS.index(x) for x in "au" * 20_000], []
    while len(symbols) > 2:
        pair = tuple(symbols[:2])
        symbols = c.rewritten(symbols, {pair: len(c.SYMBOLS) + len(rules)})
        rules.append(pair)
    cost, audit = c.Grammar(rules).cheapest(symbols)
    assert (cost, audit) == simple("au" * 20_000)


def test_ropes_compare_as_strings():
    rng = random.Random(2)
    ropes = ["", "a", "ab" * 40, "ab" * 39 + "b", "b" * 70]
    for _ in range(200):
        ropes.append(c.joined(rng.choice(ropes[-12:] + ropes[:5]), rng.choice(ropes[-12:] + ropes[:5])))
        if c.size(ropes[-1]) > 3000:
            ropes.pop()
    for a, b in itertools.product(rng.sample(ropes, 60), repeat=2):
        assert c.less(a, b) == (c.flat(a) < c.flat(b))


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(4)
    texts = ["", " \n", "no end", "All well.", "Is it?", "é字!", "x" * 20000 + ".", None]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "tool", "", "User", None]), rng.choice(texts))
            for i in range(40) for t in [*range(rng.randrange(1, 9)), *([None] * (i % 3 == 0)), *([0, 0] * (i % 5 == 0)), *([7] * (i % 7 == 0))]]
    rows += [(100 + i, t, ("user", "assistant")[t % 2], f"Turn {t}.") for i in range(60) for t in range(8)]
    rows += [(200, t, ("user", "assistant")[t % 2 ^ (t % 50 == 0)], f"Turn {t}.") for t in range(3000)]
    rows += [(None, 0, "user", "Hello."), (None, None, "assistant", "Hello."), (201, None, "user", "a"), (201, None, "user", "a")]
    return [(i if i is None else int(i), t, r, x) for i, t, r, x in rows]


def frame(spark, rows):
    """With extra columns whose names the operator uses itself."""
    return spark.createDataFrame(
        [(*r, "k", 1, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string, place long, sequence string"
    )


def test_conversations_against_the_plain_form(spark, conversations):
    df = frame(spark, conversations).repartition(5)
    planned = c.repair_plans(df)
    hashes = {r.conv_id: r.repaired_sha256 for r in c.digests(c.repaired(df, planned)).collect()}
    by_id = {}
    for i, t, role, text in conversations:
        by_id.setdefault(i, []).append((t, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes[r.conv_id]) for r in planned.collect()}
    assert got == {i: reference(rows) for i, rows in by_id.items()}
    rows = [r for r in c.repaired(df, planned).where("place >= 0 and conv_id = 200").orderBy("place").collect()]
    assert [r.place for r in rows] == list(range(len(rows))) and [r.role[:1] for r in rows] == ["u", "a"] * (len(rows) // 2)


def test_rows_that_are_gone_leave_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", True), (2, 0, "user", "Hi.", None)], "conv_id long, turn long, role string, text string, gone boolean")
    planned = c.repair_plans(df, gone="gone")
    got = {r.conv_id: (r.gaps, r.truncated, r.cost, r.audit) for r in planned.collect()}
    assert got == {1: (0, 0, 0, ""), 2: (0, 0, 2, "KI")}
    assert c.repaired(df, planned, gone="gone").where("place >= 0").count() == 2


def test_no_rows(spark, conversations):
    df = frame(spark, conversations).where("conv_id < 0")
    planned = c.repair_plans(df)
    assert planned.count() == 0 and c.digests(c.repaired(df, planned)).count() == 0


def test_query_against_the_plain_form(spark):
    source = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by_id = {r.conv_id: [] for r in source}
    for r in source:
        code, text, role = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20, r.text, r.role
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        by_id[r.conv_id] += [(r.turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    result = QUERIES["op13_conversation_repair"](spark, SF)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert set(result.columns) == {"conv_id", *columns}
    got = {r.conv_id: tuple(r[n] for n in columns) for r in result.collect()}
    assert got == {i: reference(rows) for i, rows in by_id.items()}
    assert len({g[6] for g in got.values()}) > 5
