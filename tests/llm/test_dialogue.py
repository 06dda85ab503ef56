"""The search against all edits and a recurrence; faults and repairs against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clinframe.llm import dialogue as D
from clinframe.llm.queries import damaged


def plain_search(codes):
    """Least (cost, audit) by a recurrence over turns and states."""

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                to = D.GIVEN[s][1]
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return best

    best = inserted({0: (0, "")})
    for gone, cut, initial, repeats in codes:
        now = {}
        for s, (cost, audit) in best.items():
            moves = [(s, 3, "D")]
            if not gone:
                moves.append((D.GIVEN[s][1], 2 + cut, "R"))
                if s in D.NEXT.get(initial, ()):
                    moves.append((D.NEXT[initial][s], int(cut), "K"))
            for to, price, letter in moves:
                now[to] = min(now.get(to, (10**9, "")), (cost + price + 3 * repeats, audit + letter + "D" * repeats))
        best = inserted(now)
    return min(best[s] for s in (0, 3) if s in best)


def random_codes(rng, n):
    out = []
    for _ in range(n):
        gone = rng.random() < 0.15
        out.append((gone, not gone and rng.random() < 0.2, rng.choice([b"u", b"a", b"u", b"a", b"s", b"x", b""]), int(rng.random() < 0.1)))
    return out


def test_search_equals_recurrence():
    rng = random.Random(5)
    for n in [*range(12)] * 60 + [30, 60, 90]:
        codes = random_codes(rng, n)
        assert D.repair_codes(codes) == plain_search(codes)
    same = [(False, False, b"u", 0)] * 60
    assert D.repair_codes(same) == plain_search(same)


def test_bounds_never_exceed():
    rng = random.Random(6)
    for _ in range(300):
        codes = random_codes(rng, 8)
        early, _ = D.suffix_bounds(codes)
        assert early[0] <= plain_search(codes)[0]


def test_chains_equal_whole(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(D, "STRETCH", 3)
    for n in (4, 9, 20, 31):
        codes = random_codes(rng, n)
        assert D.repair_codes(codes) == plain_search(codes)


def plainly(rows):
    """All columns of a conversation from its (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, codes, counts, initials = set(), [], [0, 0, 0], []
    for _, role, text in rows:
        content = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not content else 1 if (role, text) in seen else 2 if content[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        seen.add((role, text))
        codes.append((fault in (0, 1), fault == 2, role[:1].encode(), 0))
        initials.append(role[:1])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = plain_search(codes)
    left, kept = iter(rows), []
    total = len(rows) - audit.count("D") + audit.count("I")
    for letter in audit:
        role = ("assistant", "user")[(total - len(kept)) % 2 == 0]
        if letter == "I":
            kept.append(f"{role}:")
            continue
        _, own, text = next(left)
        if letter != "D":
            kept.append(f"{own if letter == 'K' else role}:{text}")
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    text = "\n".join(kept)
    assert re.fullmatch("(s?(ua)+)?", "".join(k[:1] for k in kept))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def odd_rows(seed=1, many=400):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Is it?", "cut", "", " \t", None, "é.", "a\nb.", "cut "]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "u2", "tool"]
    out = []
    for conv in [*range(60), None]:
        for _ in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)))
    out += [(777, k % (many // 3), rng.choice(roles), rng.choice(texts)) for k in range(many)]
    return out


@pytest.mark.parametrize("hot", [D.HOT_TURNS, 20])
def test_equals_plain_version(spark, hot):
    given = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in given], "conv_id long, turn long, role string, text string, c string, audit int")
    groups = defaultdict(list)
    for conv, turn, role, text in given:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    found = D.repair(df, hot_turns=hot).cache()
    got = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == {conv: plainly(rows) for conv, rows in groups.items()}
    turns = defaultdict(list)
    for r in D.repaired_turns(df, found).orderBy("place").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, row in got.items():
        assert hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == row[-1]


def test_one_conversation_of_equal_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    for hot in (D.HOT_TURNS, 50):
        (row,) = D.repair(df, hot_turns=hot).collect()
        assert (row["duplicate"], row["illegal"], row["cost"]) == (499, 499, 499 * 3 + 2)
        assert row["audit"] == "K" + "D" * 499 + "I"


def test_empty_and_absent(spark):
    df = spark.createDataFrame([(5, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    (row,) = D.repair(df, there=F.lit(False)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert D.repair(df.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(20) for t in (None, 1, 2)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = None if kind == 0 else "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text, kind != 0)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in damaged(df).select("conv_id", "turn", "role", "text", "there").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
