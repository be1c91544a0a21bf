"""Repair of conversations against a plain shortest-path search."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spindrift.llm import turn_repair as TR

_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FIELDS = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_repair(rows):
    """The report of one conversation's damaged rows, by Dijkstra over (position, state) with audits as tie-breaks."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, made = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            break
        for role in ("user", "assistant"):
            if (to := _STEP.get((q, role[0]))) is not None:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*made, f"{role}:")))
        if i < len(rows):
            kind, (_, _, role, text) = kinds[i], rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, made))
            if kind in ("", "truncated"):
                more = 3 * (kind == "truncated")
                if (to := _STEP.get((q, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (to := _STEP.get((q, new[0]))) is not None:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, to, (*made, f"{new}:{text}")))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def plain_report(rows):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return {c: plain_repair(own) for c, own in by.items()}


def made(spark, rows, parts=3, **sizes):
    turns = spark.createDataFrame(rows, _FIELDS).repartition(parts)
    found = TR.report(TR.damaged(turns), turns.select("conv_id"), **sizes).collect()
    return {r[0]: tuple(r[1:]) for r in found}


def some_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "ok?", "", " \t", "fine. \n", "a.b", "x"]
    return [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), f"{rng.choice(texts)}{rng.choice(['', '', t])}") for c in range(convs) for t in range(rng.randint(1, most))]


def test_short_and_straddling_conversations(spark):
    rows = some_rows(1, 150, 9)
    assert made(spark, rows) == plain_report(rows)


@pytest.mark.parametrize("size", [2, 3])
def test_small_segments_and_levels(spark, size):
    rows = some_rows(size, 40, 23)
    assert made(spark, rows, segment=size, fan=2) == plain_report(rows)


def test_a_conversation_of_many_segments(spark):
    rows = some_rows(7, 3, 8) + [(9, t, ("user", "assistant", "assistant")[t % 3], f"t{t % 700}.") for t in range(1500)]
    assert made(spark, rows) == plain_report(rows)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (None, 3, "assistant", None), (1, None, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 2, "user", "Yes."), (1, 2, "user", "Yes."), (2, 0, None, None), (3, 1, "s", "."), (4, -5, "ümlaut", "é."), (4, 9, "assistant", "\x0b.")]
    rows += [(5, 1, "user", "the same.")] * 300
    turns = spark.createDataFrame(rows, _FIELDS)
    wide = turns.withColumns({c: F.lit(c) for c in ("conv", "at", "pos", "code", "h", "salt", "part", "node", "total", "copy", "key", "cost", "audit", "run", "place", "own")})
    for table in (turns, wide):
        found = {r[0]: tuple(r[1:]) for r in TR.report(TR.damaged(table), table.select("conv_id")).collect()}
        assert found == plain_report(rows)


def test_empty_and_all_dropped(spark):
    assert made(spark, [], 1) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert made(spark, [(gone, 0, "user", "Hi.")], 1) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_are_rows_in_order(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "More.")], _FIELDS)
    done = TR.repair(turns)
    rows = [(r["role"], r["text"]) for r in done.turns.orderBy("conv_id", "pos", "place").collect()]
    summary = done.summary.first()
    assert (summary["cost"], summary["audit"], summary["illegal"]) == (6, "IKKR", 1)
    assert rows == [("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "More.")]
