"""Runs of words against a comparison of every period, and digests against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import word_runs as WR


def plain_runs(words):
    """All maximal stretches by trying every period; the smallest period counts."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_report(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, digest("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_runs_of_small_alphabets(words):
    assert WR.runs_of(words) == [(s, n, q) for s, n, q in sorted(plain_runs(words), key=lambda r: (r[0], r[2]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.integers(1, 6)), max_size=6))
def test_runs_of_texts(parts):
    words = [w for own, times in parts for w in own * times]
    found = dict(WR.runs_in(pa.array([" ".join(words), "", None, "a b"])))
    assert found.get(0, []) == sorted(plain_runs(words), key=lambda r: (r[0], r[2])) and set(found) <= {0}


def test_long_runs_and_equal_hashes(monkeypatch):
    assert WR.runs_of([5] * 3000) == [(0, 3000, 1)]
    block = [random.Random(1).randrange(50) for _ in range(333)]
    words = [99, *block * 5, 98]
    assert WR.runs_of(words) == sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    monkeypatch.setattr(WR, "_PRIME", 3)  # hashes that say little: what is reported is still a run
    for s, n, q in WR.runs_of(words):
        assert words[s : s + n - q] == words[s + q : s + n]


def docs():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["la", "le", "La", "é", "the", "x"]) for _ in range(rng.randrange(0, 120)))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(400))) for i in range(60)]
    return rows


def test_report(spark):
    rows = docs()
    found = WR.report(WR.with_tails(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()
    assert sorted(map(tuple, found)) == sorted(plain_report(*r) for r in rows)


def test_odd_rows_and_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a a"), (4, "x " * 20000), (4, "x " * 20000), (5, "a\x0ba\x0ca\ra\na\ta"), (6, "a a " * 7), (7, "a\x1ca " * 9), (8, None), (-10, "b a " * 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    wide = table.withColumns({c: F.lit(c) for c in ("runs", "words", "n", "a", "p", "best", "key", "start", "length", "period")})
    for t in (table, wide):
        found = WR.report(WR.with_tails(t)).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_report(*r)) for r in rows)
    assert WR.report(WR.with_tails(table.where("false"))).count() == 0


@pytest.mark.parametrize("text, runs", [("a b a b a b a b", [(0, 8, 2)]), ("a b a b a b a", []), ("a a a a a", []), ("a a a a a a", [(0, 6, 1)])])
def test_limits(text, runs):
    assert dict(WR.runs_in(pa.array([text]))).get(0, []) == runs
