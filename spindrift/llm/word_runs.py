"""Runs: stretches of words that repeat one period, found by Lyndon words under both orders of the words.

A run's period is the length of a Lyndon word that starts in it and that is the longest Lyndon word to start there,
under an order of the words or under its reverse. A scan from right to left keeps a stack of these words for each order: a word
takes in the one behind it as long as the text from it on comes before the text from there on. Texts are
compared, and runs extended both ways, by the longest common extension of two places: the first words directly, then a
search by doubling and halving over rolling hashes modulo 2^61 - 1. The words of every run found are compared directly.

Most of a text can't belong to a run of four periods, and isn't scanned: there every five words stand again within the
run, at most a quarter of its length away. Stretches covered by such repeated five words hold all runs whole, so they are scanned on
their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm._words import U64, chunks, mix, word_hashes

#: The least length of a run in words, and in periods.
LEAST, PERIODS = 6, 4
_GRAM = 5
_PRIME = (1 << 61) - 1
_BASE = 0x1D3F5A7B9C2E4681 % _PRIME
#: Words compared one by one before hashes are.
_DIRECT = 4
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Extensions:
    """Longest common extensions of two places in a list of words, given as numbers."""

    def __init__(self, words: list[int]) -> None:
        self.words = words
        self.total, self.power = [0], [1]
        total, power = 0, 1
        for w in words:
            total = (total * _BASE + w) % _PRIME
            power = power * _BASE % _PRIME
            self.total.append(total)
            self.power.append(power)

    def same(self, i: int, j: int, n: int) -> bool:
        """Whether the n words from i and from j on have one hash."""
        t, p = self.total, self.power[n]
        return (t[i + n] - t[i] * p - t[j + n] + t[j] * p) % _PRIME == 0

    def ahead(self, i: int, j: int) -> int:
        """How many words from i and from j on, i < j, are the same."""
        words, room, n = self.words, len(self.words) - j, 0
        while n < room and n < _DIRECT:
            if words[i + n] != words[j + n]:
                return n
            n += 1
        step = _DIRECT
        while n + step <= room and self.same(i + n, j + n, step):
            n += step
            step *= 2
        while step:
            if n + step <= room and self.same(i + n, j + n, step):
                n += step
            step //= 2
        return n

    def behind(self, i: int, j: int) -> int:
        """How many words before i and before j, i < j, are the same."""
        words, n = self.words, 0
        while n < i and n < _DIRECT:
            if words[i - n - 1] != words[j - n - 1]:
                return n
            n += 1
        step = _DIRECT
        while n + step <= i and self.same(i - n - step, j - n - step, step):
            n += step
            step *= 2
        while step:
            if n + step <= i and self.same(i - n - step, j - n - step, step):
                n += step
            step //= 2
        return n


def lyndon_ends(at: Extensions, reverse: bool) -> list[int]:
    """Where the longest Lyndon word from each place on ends, under the order of the words' numbers or its reverse.

    That is the next place from which on the text comes earlier in the order; the end of the text comes before all words.
    """
    words = at.words
    n = len(words)
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        j, a = i + 1, words[i]
        while j < n:
            b = words[j]
            if a == b:
                same = at.ahead(i, j)
                if j + same == n:
                    break
                less = words[j + same] < words[i + same]
            else:
                less = b < a
            if less != reverse:
                break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(words: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a list of words with `periods` (3 at least) periods and `least` words, by start and period."""
    n = len(words)
    if n < max(least, periods):
        return []
    at = Extensions(words)
    value = np.array(words, U64)
    place = np.arange(n)
    found = set()
    for reverse in (False, True):
        period = np.array(lyndon_ends(at, reverse)) - place
        next_one = np.minimum(place + period, n - 1)
        # a run of three periods and more has two whole roots in a row; they are followed from root to root
        twin = (place + 2 * period <= n) & (period[next_one] == period) & (value[next_one] == value)
        firsts = twin.copy()
        firsts[next_one[twin]] = False
        for i in np.flatnonzero(firsts).tolist():
            p, known = int(period[i]), 0
            while i < n and twin[i]:
                if i + 2 * p > known and words[i : i + p] == words[i + p : i + 2 * p]:
                    start, end = i - at.behind(i, i + p), i + p + at.ahead(i, i + p)
                    if words[start : end - p] != words[start + p : end]:  # two hashes were alike by chance
                        start, end = _by_hand(words, i, p)
                    if end - start >= max(least, periods * p):
                        found.add((start, end - start, p))
                    known = end
                i += p
    return sorted(found, key=lambda r: (r[0], r[2]))


def _by_hand(words: list[int], i: int, p: int) -> tuple[int, int]:
    start, end = i, i + p
    while start and words[start - 1] == words[start - 1 + p]:
        start -= 1
    while end < len(words) and words[end] == words[end - p]:
        end += 1
    return start, end


def _stretches(h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """First and end of the stretches of words h that may hold runs of four periods; bounds are those of the texts."""
    n = len(h)
    if n < LEAST:
        return []
    gram = np.zeros(n - _GRAM + 1, U64)
    weights = mix(np.arange(_GRAM, dtype=U64), 61) | U64(1)
    for k in range(_GRAM):
        gram += h[k : k + len(gram)] * weights[k]
    row = np.searchsorted(bounds, np.arange(n), "right")
    whole = row[: len(gram)] == row[_GRAM - 1 :]
    places = np.flatnonzero(whole)
    key = gram[places] + mix(row[places].astype(U64), 62)
    order = np.argsort(key, kind="stable")
    key, at = key[order], places[order]
    twin = key[1:] == key[:-1]
    if not twin.any():
        return []
    far = np.int64(1) << 40
    near = np.full(n, far)  # the distance to the nearest place with the same five words
    gap = (at[1:] - at[:-1])[twin]
    np.minimum.at(near, at[1:][twin], gap)
    np.minimum.at(near, at[:-1][twin], gap)
    limit = np.full(n, far - 1)
    for _ in range(4):
        marks = np.flatnonzero(near <= limit)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, marks, 1)
        np.subtract.at(cover, marks + _GRAM, 1)
        solid = np.cumsum(cover)[:n] > 0
        first = solid.copy()
        first[1:] &= ~(solid[:-1] & (row[1:] == row[:-1]))
        starts = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= ~(solid[1:] & (row[1:] == row[:-1]))
        ends = np.flatnonzero(last) + 1
        number = np.cumsum(first) - 1
        size = (ends - starts) // PERIODS
        was, limit = limit, np.where(solid, size[np.maximum(number, 0)] if len(size) else 0, 0)
        if not len(starts) or (near <= limit).sum() == len(marks):
            break
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= LEAST]


def runs_in(column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The number of every text that has runs, ascending, and its runs."""
    for i, _, data, at in chunks(column):
        h, bounds, _, _ = word_hashes(data, at, lower=False)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in _stretches(h, bounds):
            r = int(np.searchsorted(bounds, a, "right")) - 1
            shift = a - int(bounds[r])
            found.setdefault(r, []).extend((s + shift, n, p) for s, n, p in runs_of(h[a:b].tolist()))
        for r in sorted(found):
            if found[r]:
                yield i + r, sorted(found[r], key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by one space, of every run the first period only."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    stays = np.cumsum(gone)[:-1] == 0
    return b" ".join(w for w, s in zip(words, stays.tolist()) if s)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period) and the collapsed text of docs(doc_id, text), a row for each.

    Words are what white space (0x20, 0x09 to 0x0D) parts, cases differ. A run has a smallest period q, max(6, 4 q) words or more, and
    no neighbour that continues it; what it says after its first period goes, the words that stay are joined by one space. Null
    and empty texts have no runs and collapse to ''. doc_id is passed through, nulls and repeats as well; other columns are
    left out; no rows give no rows. Words are told apart by hashes of 64 bits. No shuffle; a task holds an Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            texts = [b" ".join(x.as_buffer().to_pybytes().split()) if x.is_valid else b"" for x in column.cast(pa.large_binary())]
            runs: list[list[dict]] = [[]] * len(texts)
            for r, found in runs_in(column):
                texts[r] = collapsed(texts[r].split(), found)
                runs[r] = [{"start": s, "length": n, "period": p} for s, n, p in found]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], ["doc_id", "runs", "text"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {_RUNS}, text string")


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where a tenth of the texts, by crc32 of doc_id, repeat some of their words to the end.

    Of n > 0 words each from number a on becomes word a + (i - a) % p. Rows without doc_id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = F.coalesce((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", (g % F.col("n")).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))

    def tail(w: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))

    return rows.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.transform("words", tail), " ")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Of every row of docs(doc_id, text): the number of runs, the longest (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    found = collapse(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.less")
    return out.select("doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
