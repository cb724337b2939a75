"""Conversation repair against brute force, its SQL, and the way by segments."""

import hashlib
import random
import re
from itertools import combinations

import duckdb
import pytest

from riskmart.llm import conversations
from riskmart.llm.conversations import Settings, align, damaged, edits, repaired, report

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def all_repairs(symbols, most):
    """Every (cost, audit) within ``most`` whose result is in the grammar."""
    def options(symbol):
        yield 3, "D", ""
        if symbol != "d":
            late = symbol.isupper()
            yield late, "K", symbol.lower()
            for wanted in "ua":
                yield 2 + late, "R", wanted

    def extend(i, cost, audit, out):
        if cost > most:
            return
        if i == len(symbols) and GRAMMAR.match(out):
            yield cost, audit
        for wanted in "ua":
            yield from extend(i, cost + 2, audit + "I", out + wanted)
        if i < len(symbols):
            for price, letter, wanted in options(symbols[i]):
                yield from extend(i + 1, cost + price, audit + letter, out + wanted)

    yield from extend(0, 0, "", "")


def test_align_is_the_cheapest_and_least():
    rng = random.Random(5)
    cases = ["", "d", "s", "u", "a", "x", "S", "ua", "au", "sua", "ss", "aa", "uu", "dd"]
    cases += ["".join(rng.choice("uuuaaasxdUAS") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    for symbols in cases:
        found = align(symbols)
        assert found == min(all_repairs(symbols, found[0])), symbols


def test_long_rows_of_one_symbol_and_large_slack():
    for symbols in ("u" * 40, "a" * 41, "x" * 30, "ud" * 20, "s" * 20 + "ua" * 10):
        by_row = conversations.walk(symbols, 0, conversations.left_at_the_end().tolist(), True)[0]
        assert align(symbols)[1] == by_row


def test_segments_multiply_to_the_cost_of_the_whole():
    rng = random.Random(7)
    for _ in range(100):
        symbols = "".join(rng.choice("uuaasxdUAS") for _ in range(rng.randint(1, 30)))
        whole = conversations.segment_matrix(symbols)
        cost = min(whole[0] + conversations.left_at_the_end())
        assert cost == align(symbols)[0]
        for cut in list(combinations(range(1, len(symbols)), 1))[:3]:
            parts = [conversations.segment_matrix(symbols[:cut[0]]),
                     conversations.segment_matrix(symbols[cut[0]:])]
            assert (conversations._times(*parts) == whole).all()


def talks(seed, n=40, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rng.randint(-2, 2)
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool", "user", "assistant"])
            text = rng.choice(["Fine.", "So what?", "no end", "", " \t", "Wait! ", "One. Two. Three", "é…"])
            rows.append((conv, turn, role, text + rng.choice(["", str(turn) + "."])))
            turn += rng.choice([1, 1, 1, 2])
    return rows


ODD = [
    (None, 1, "user", "Hello."), (None, 2, "assistant", None), (None, None, None, "x."),
    (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 1, "", "role without a letter."),
    (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 2, "assistant", "same."),
    (4, -2 ** 60, "user", "x" * 200_000 + "."), (4, 2 ** 60, "assistant", "\U0001f600!\n"),
    (5, 1, "unicorn", "kept by its initial."), (5, 2, "assistant", "y.\x85"), (6, 1, "system", "z."),
]


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = con.sql(conversations.ORACLE)
    return {tuple(r) for r in result.fetchall()}, result.columns


def digests(frame, settings=Settings()):
    found = report(edits(frame, settings))
    return {tuple(r) for r in found.collect()}, found.columns


@pytest.mark.parametrize("rows", [talks(1), talks(2, 12, 40), ODD, []], ids=["short", "longer", "odd", "empty"])
def test_query_equals_its_sql(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert digests(damaged(frame)) == oracle(rows)


@pytest.mark.parametrize("segments", [1, 7, 40])
def test_segments_give_the_same_edits(spark, segments):
    rows = talks(3, 10, 60) + [(None, *r[1:]) for r in talks(4, 3, 30)] + ODD + [(9, t, "user", "q.") for t in range(5)]
    frame = damaged(spark.createDataFrame(rows, SCHEMA))
    for limit in (0, 8):
        assert digests(frame, Settings(long_rows=limit, segments=segments)) == digests(frame)


def test_sound_conversations_stay(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(5) for t in range(6)]
    found = edits(spark.createDataFrame(rows, SCHEMA))
    assert {r.edit for r in found.collect()} == {"K"}
    assert {(r.conv_id, r.turn, r.role, r.text) for r in repaired(found).collect()} == set(rows)


def test_repaired_rows_give_the_hash(spark):
    found = edits(spark.createDataFrame(talks(6, 8), SCHEMA))
    texts = {}
    for r in sorted(repaired(found).collect(), key=lambda r: (r.conv_id, r.at)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in report(found).collect():
        whole = "\n".join(texts.get(r.conv_id, []))
        assert r.repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_clashing_columns_and_other_ids(spark):
    rows = [("c", 1, "user", "a.", "x", "y", "z", 1), ("c", 2, "assistant", "b.", "x", "y", "z", 2)]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, sign string,"
                                        " edit string, large_id string, segment int")
    [row] = report(edits(frame)).collect()
    assert (row.conv_id, row.cost, row.audit) == ("c", 0, "KK")
