"""Conversation repair against every possible edit, in pieces and as a whole, on odd inputs and against SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewatch.llm import conversations as C
from pagewatch.llm.oracle import ORACLES
from pagewatch.llm.queries import QUERIES
from pagewatch.operators.skew import SkewPolicy
from tools.compare import rows_of

GRAMMAR = C.Grammar()
SCHEMA = "conv_id long, turn long, role string, text string, audit string, pos int"


def best_edit(turns):
    """Least ``(cost, audit, initials)`` by trying every edit of every turn, with up to two insertions at every gap."""
    done = []

    def go(at, cost, audit, roles, gap):
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if at == len(turns) and re.fullmatch(r"(s?(ua)+)?", roles):
            done.append((cost, audit, roles))
        if gap < 2:
            for made in "ua":
                go(at, cost + 3, audit + "I", roles + made, gap + 1)
        if at < len(turns):
            initial, fault = turns[at]
            go(at + 1, cost + 4, audit + "D", roles, 0)
            if fault not in (C.BLANK, C.DUPLICATE):
                extra = 3 if fault == C.CUT else 0
                if initial:
                    go(at + 1, cost + extra, audit + "K", roles + initial, 0)
                for made in "ua":
                    go(at + 1, cost + 3 + extra, audit + "R", roles + made, 0)

    go(0, 0, "", "", 0)
    return min(done)


def random_turns(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_cheapest_edits_equal_brute_force():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5] * 12:
        turns = random_turns(rng, n)
        cost, audit, roles = C.finish(C.parse_piece(turns, GRAMMAR.root, GRAMMAR), GRAMMAR)
        want = best_edit(turns)
        assert (cost, audit, roles.replace("-", "")) == want, turns


def test_stacks_are_shared_and_bounded():
    assert len(GRAMMAR.entries) == 10
    tops = C.parse_piece(random_turns(random.Random(6), 500), GRAMMAR.root, GRAMMAR)
    assert len(tops) <= 10 and all(len(way[1]) >= 500 for _, way in tops.values())
    with pytest.raises(ValueError):
        C.Grammar(("C=", "C=uCa"))


def loop(rows):
    """Faults and edits of damaged rows per conversation, one after the other."""
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn, role or (" " if role is None else ""), " " if text is None else text))
    found = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        seen, given = set(), []
        for _, role, text in turns:
            last = text.rstrip(C.WHITE)[-1:]
            fault = C.BLANK if not last else C.DUPLICATE if (role, text) in seen else C.CUT if last not in ".!?" else 0
            seen.add((role, text))
            given.append((role[:1], fault))
        known = [t for t, _, _ in turns if t is not None]
        cost, audit, roles = C.finish(C.parse_piece(given, GRAMMAR.root, GRAMMAR), GRAMMAR)
        left, lines = iter(turns), []
        for edit, initial in zip(audit, roles):
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit != "D":
                lines.append(f"{C.MADE_ROLES[initial] if edit in 'IR' else role}:{text}")
        codes = [f for _, f in given]
        found[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, codes.count(C.BLANK), codes.count(C.DUPLICATE),
            codes.count(C.CUT), sum(a + b not in C.LEGAL_PAIRS for (a, _), (b, _) in zip(given, given[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def repaired(rows, policy=None, piece=C.PIECE):
    ordered = C.ordered_turns(rows, policy=policy or C.DEFAULT_POLICY)
    done = C.repairs(ordered, piece=piece)
    digests = C.repaired_digest(C.repaired_turns(ordered, done, piece=piece))
    joined = done.join(digests, "conv", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return {
        int(r.conv[1:]) if r.conv else None: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                                              r.repaired_sha256 or empty)
        for r in joined
    }


def many_rows():
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(6)]:
        for turn in range(rng.randint(1, 14) if conv != 3 else 400):
            rows.append((
                conv, rng.choice([turn, turn, turn, None, turn + 2]), rng.choice(["user", "assistant", "system", "tool", "", None]),
                rng.choice([f"word {turn}.", f"word {turn}", "same!", "", " \n", None, "é?"]), "clash", 1,
            ))
    return rows


def test_pieces_and_hot_conversations_equal_a_loop(spark):
    rows = many_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = loop(rows)
    assert repaired(df) == want
    assert repaired(df, SkewPolicy(min_rows=40, share=0.01), piece=5) == want


def test_damage_and_nulls(spark):
    rows = [(c, t, r, x, None, None) for c in (None, 1, 2) for t in (None, *range(30)) for r, x in [("system", "a. b!"), (None, None)]]
    got = C.damaged_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for conv, turn, role, text, *_ in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        want += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_and_dropped_conversations(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty) == {}
    lone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lone, 0, "user", "gone."), (None, None, None, None)], SCHEMA.split(", audit")[0]).write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == {lone, None}
    assert got[lone].audit == "" and got[lone].cost == 0
    assert got[lone].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_query_equals_sql(spark, sf_dir):
    df = QUERIES["op12_conversation_repair"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(ORACLES["op12_conversation_repair"])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
