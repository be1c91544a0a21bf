"""Language-model scores of documents against their own corpus: stupid backoff over counts of all n-grams.

A word's score is the count of the n-gram that ends with it over that of the n-gram's first words, of
the longest n-gram of up to ORDER words that other documents hold; every shortening costs a factor
ALPHA. Counts leave out the scored document itself, else nothing would ever back off.

Relationally: documents explode to n-grams, the n-grams are dealt to a count table partitioned by their
hash, are counted, and the counts join back to the n-grams and are summed by document. What moves
between those steps is packed: a row holds the n-grams that one block of documents sends to one
partition, as sorted hashes with their differences in five bytes each, and the answer holds one count
for each in the same order. An n-gram comes once for each block, so frequent ones make no large group.

A block sends one row to each partition, to 4,096 at most, so rows grow with the input. Where the count table needs
more partitions, the rows of a partition go on in teams of blocks: a team merges what its blocks ask for, asks the
parts of the partition as one block would, and deals the answers out again.

The blocks are a table in the shared folder: both steps that read them see the same rows, whatever
executors are lost in between. A count is that of a hash of 48 bits and the partition's bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._shared import saved
from spindrift.llm._words import U64, mix, utf8, word_hashes

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a block, and for each partition of the count table.
BLOCK, PARTITION = 4 << 20, 8 << 20
#: Bits of a hash that choose among the partitions that one row's sender knows, and at most in all.
FAN, MOST_BITS = 12, 24
_REQUEST = "part int, block long, n int, hashes binary, counts binary"
_ANSWER = "block long, part int, n int, counts binary"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """block long, doc_ids array<long>, n_words long, n_bytes long, texts binary: documents packed by about `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, first = zstandard.ZstdCompressor(level=3), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = words = done = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64).tobytes()
            row = [[first + done], [ids], [words], [held], [pack.compress(lengths + b"".join(parts))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()))], ["block", "doc_ids", "n_words", "n_bytes", "texts"])

        for batch in batches:
            data, at = utf8(batch.column(1))
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(at, at[i] + max(size - held, 0), "right")) - 1)
                if held and at[j] - at[i] + held > size:
                    yield close()
                    ids, parts, held, words, done = [], [], 0, 0, done + 1
                    continue
                ids += batch.column(0).slice(i, j - i).to_pylist()
                parts += [data[a:b].tobytes() for a, b in zip(at[i:j], at[i + 1 : j + 1])]
                held += int(at[j] - at[i])
                words += len(word_hashes(data, at[i : j + 1])[0])
                i = j
        if ids:
            yield close()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "block long, doc_ids array<long>, n_words long, n_bytes long, texts binary")


def ngrams(texts: bytes, rows: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word, by order (0 where the document has too few words before); the documents' bounds."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum(raw[: 8 * rows].view(np.int64))])
    h, bounds, _, _ = word_hashes(raw[8 * rows :], at)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.zeros((order, len(h)), U64)
    chain = h.copy()
    for n in range(1, order + 1):
        if n > 1:  # the n-gram is the word and the (n-1)-gram before it
            chain[1:], chain[0] = mix(chain[:-1] * U64(5) + h[1:], 80 + n), 0
        g = mix(chain, 90 + n)
        g[place < n - 1] = 0
        out[n - 1] = g
    return out, bounds


def pack_counts(counts: np.ndarray) -> bytes:
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes(), 1)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    out = raw[:n].astype(np.int64)
    out[out == 255] = raw[n:].view(np.int64) if len(raw) > n else 255
    return out


def pack_hashes(x: np.ndarray) -> bytes:
    """Ascending 48-bit values as differences of five bytes, or of six where five don't do."""
    gaps = np.diff(x, prepend=U64(0))
    width = 5 if not len(x) or int(gaps.max()) < 1 << 40 else 6
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    raw, width = np.frombuffer(data, np.uint8), data[0]
    wide = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    wide[:, :width] = raw[1:].reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=U64)


def _slices(distinct: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Partition, first and end of each partition that ascending hashes fall in."""
    part = (distinct >> U64(64 - bits)).astype(np.int64)
    cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
    return ((int(part[a]), a, b) for a, b in zip(cut[:-1], cut[1:]))


def _shorten(g: np.ndarray, bits: int) -> np.ndarray:
    """Only the bits that count, so that a block's distinct hashes are distinct in their partition too."""
    return g & U64(0xFFFFFFFFFFFFFFFF << (16 - bits) & 0xFFFFFFFFFFFFFFFF) if bits < 16 else g


def requests(packed: DataFrame, order: int, bits: int) -> DataFrame:
    """part int, block long, n int, hashes binary, counts binary: what each block sends to each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, texts in zip(*(c.to_pylist() for c in batch.columns)):
                g, _ = ngrams(texts, len(ids), order)
                distinct, counts = np.unique(_shorten(g[g != 0], bits), return_counts=True)
                low = (distinct << U64(bits)) >> U64(16)
                yield _requests([(p, block, b - a, pack_hashes(low[a:b]), pack_counts(counts[a:b])) for p, a, b in _slices(distinct, bits)])

    return packed.select("block", "doc_ids", "texts").mapInArrow(run, _REQUEST)


class _Asked:
    """All that some rows of requests ask for: distinct hashes, their counts, and where each row's hashes are among them."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows, self.n = rows, rows["n"].to_numpy()
        x = np.concatenate([unpack_hashes(b) for b in rows["hashes"].to_pylist()])
        c = np.concatenate([unpack_counts(b, k) for b, k in zip(rows["counts"].to_pylist(), self.n.tolist())])
        self.distinct, self.where = np.unique(x, return_inverse=True)
        self.totals = np.bincount(self.where, c).astype(np.int64)

    def answers(self, totals: np.ndarray) -> pa.Table:
        found = totals[self.where]
        ends = np.cumsum(self.n)
        counts = [pack_counts(found[e - k : e]) for k, e in zip(self.n.tolist(), ends.tolist())]
        return pa.table({"block": self.rows["block"], "part": self.rows["part"], "n": self.rows["n"], "counts": pa.array(counts, pa.binary())})


def answered(asked: DataFrame, bits: int, fan: int) -> DataFrame:
    """block long, part int, n int, counts binary: the whole corpus' counts of what each block asked for.

    The next `bits` bits of the hashes divide a partition further, `fan` of them at a time.
    """
    if bits <= 0:

        def one(rows: pa.Table) -> pa.Table:
            found = _Asked(rows)
            return found.answers(found.totals)

        return asked.groupBy("part").applyInArrow(one, _ANSWER)
    asked = saved(asked, "requests")
    step = min(bits, fan)
    teams = -(-asked.select("block").distinct().count() // (1 << fan))
    asked = asked.withColumn("team", F.xxhash64("part", F.pmod(F.xxhash64("block"), F.lit(max(1, teams)))))

    def onward(key: tuple, rows: pa.Table) -> pa.Table:
        found, part = _Asked(rows), rows["part"][0].as_py() << step
        next_bits, rest = found.distinct >> U64(48 - step), (found.distinct << U64(step)) & U64((1 << 48) - 1)
        cut = [0, *(np.flatnonzero(next_bits[1:] != next_bits[:-1]) + 1).tolist(), len(rest)]
        made = [(part | int(next_bits[a]), key[0].as_py(), b - a, pack_hashes(rest[a:b]), pack_counts(found.totals[a:b])) for a, b in zip(cut[:-1], cut[1:])]
        return pa.Table.from_batches([_requests(made)])

    def back(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        found = _Asked(rows)
        totals = np.concatenate([unpack_counts(c, n) for _, n, c in sorted(zip(told["part"].to_pylist(), told["n"].to_pylist(), told["counts"].to_pylist()))])
        if len(totals) != len(found.distinct):
            raise RuntimeError(f"{len(found.distinct)} n-grams asked for, {len(totals)} counted")
        return found.answers(totals)

    told = saved(answered(asked.groupBy("team").applyInArrow(onward, _REQUEST), bits - step, fan), "answers")
    told = told.withColumnRenamed("block", "team")
    return asked.groupBy("team").cogroup(told.groupBy("team")).applyInArrow(back, _ANSWER)


def _requests(made: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*made)) if made else [()] * 5
    arrays = [pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, ["part", "block", "n", "hashes", "counts"])


def _scores(g: np.ndarray, bounds: np.ndarray, totals: np.ndarray, all_words: int, alpha: float, bits: int) -> np.ndarray:
    """The sum of each document's log scores, from the counts of its block's distinct n-grams in ascending order.

    A stable sort puts equal n-grams side by side, and of those the ones of one document, so runs give each
    document's own counts.
    """
    order, n = g.shape
    rows = len(bounds) - 1
    of = np.repeat(np.arange(rows), np.diff(bounds))
    there = np.flatnonzero(g.ravel())
    values = _shorten(g.ravel()[there], bits)
    there = there[np.argsort(values, kind="stable")]
    values, doc = _shorten(g.ravel()[there], bits), of[there % n]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    if int(first.sum()) != len(totals):
        raise RuntimeError(f"{first.sum()} n-grams asked for, {len(totals)} counted")
    run = first.copy()
    run[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(run)
    own = np.diff(np.append(at, len(run)))
    rest = totals[np.cumsum(first)[at] - 1] - own
    counts = np.zeros(order * n)
    counts[there] = np.repeat(rest, own)
    counts = counts.reshape(order, n)
    others = (all_words - np.diff(bounds))[of].astype(float)
    place = np.arange(n) - bounds[:-1][of]
    chance = np.where(counts[0] > 0, counts[0] / np.maximum(others, 1), 1 / (others + 1))
    used = np.ones(n)
    for k in range(1, order):
        context = np.ones(n)
        context[1:] = counts[k - 1][:-1]
        found = counts[k] > 0
        chance = np.where(found, counts[k] / np.maximum(context, 1), chance)
        used = np.where(found, k + 1, used)
    steps = np.minimum(place + 1, order) - used
    logs = np.log(chance) + steps * math.log(alpha)
    return np.bincount(of, logs, rows)


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block: int = BLOCK, partition: int = PARTITION, fan: int = FAN) -> DataFrame:
    """doc_id, n_words long, score double, mean_score double of every whole text.

    score is the sum of the words' natural logarithms of stupid-backoff scores against all other rows:
    for the longest n-gram of at most `order` words with other rows' count c > 0, c over the count of its
    first n - 1 words (of all other rows' words, for one word), times alpha for each word it is shorter
    than it could be; a word that no other row has counts 1 over those words and one more. mean_score is
    score by word. Words are lower-cased (A-Z) runs of bytes that are not white space.

    Null, empty and blank texts have no words and zeros. Every row is a document of its own, repeated
    rows as well, so each sees the other's n-grams; doc_id is only passed through, nulls too. Columns other
    than doc_id and text are left out; no rows give no rows. block and partition are bytes of text, fan the
    bits that one row's sender can tell partitions by; the result does not depend on them.
    """
    if order < 1 or not 0 < alpha <= 1:
        raise ValueError("order must be at least 1 and alpha in (0, 1]")
    packed = saved(blocks(docs, block), "blocks")
    all_words, all_bytes = packed.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    whole = min(MOST_BITS, max(3, math.ceil(math.log2(max(1, all_bytes / partition)))))
    bits = min(whole, fan)
    answers = saved(answered(requests(packed, order, bits), whole - bits, fan), "counts")

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            raise RuntimeError("counts without their block")
        ids = left["doc_ids"][0].as_py()
        g, bounds = ngrams(left["texts"][0].as_py(), len(ids), order)
        sent = sorted(zip(right["part"].to_pylist(), right["n"].to_pylist(), right["counts"].to_pylist()))
        totals = np.concatenate([unpack_counts(c, n) for _, n, c in sent]) if sent else np.zeros(0, np.int64)
        sums, n = _scores(g, bounds, totals, all_words, alpha, bits), np.diff(bounds)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "score": pa.array(sums, pa.float64()), "mean_score": pa.array(sums / np.maximum(n, 1), pa.float64())})

    texts = packed.select("block", "doc_ids", "texts")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, "doc_id long, n_words long, score double, mean_score double")


#: The same by explicit joins, for tables that are small enough.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM docs),
grams AS (SELECT r, i, w AS g1, lag(w) OVER s || ' ' || w AS g2, lag(w, 2) OVER s || ' ' || lag(w) OVER s || ' ' || w AS g3 FROM words WINDOW s AS (PARTITION BY r ORDER BY i)),
long AS (SELECT r, i, 1 AS n, g1 AS g FROM grams UNION ALL SELECT r, i, 2, g2 FROM grams WHERE i >= 2 UNION ALL SELECT r, i, 3, g3 FROM grams WHERE i >= 3),
own AS (SELECT r, g, count(*) AS c FROM long GROUP BY r, g),
rest AS (SELECT r, g, sum(c) OVER (PARTITION BY g) - c AS c FROM own),
c AS (SELECT l.r, l.i, max(CASE WHEN n = 1 THEN rest.c END) AS c1, max(CASE WHEN n = 2 THEN rest.c END) AS c2, max(CASE WHEN n = 3 THEN rest.c END) AS c3
      FROM long l JOIN rest ON l.r = rest.r AND l.g = rest.g GROUP BY l.r, l.i),
d AS (SELECT *, lag(c1) OVER s AS d2, lag(c2) OVER s AS d3, (SELECT count(*) FROM words) - count(*) OVER (PARTITION BY r) AS others FROM c WINDOW s AS (PARTITION BY r ORDER BY i)),
logs AS (SELECT r, CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / d3::DOUBLE)
                        WHEN c2 > 0 THEN ln(c2::DOUBLE / d2::DOUBLE) + (least(i, 3) - 2) * ln(0.4::DOUBLE)
                        WHEN c1 > 0 THEN ln(c1::DOUBLE / others::DOUBLE) + (least(i, 3) - 1) * ln(0.4::DOUBLE)
                        ELSE ln(1 / (others + 1)::DOUBLE) + (least(i, 3) - 1) * ln(0.4::DOUBLE) END AS s FROM d)
SELECT docs.doc_id, len(any_value(w))::BIGINT AS n_words, round(coalesce(sum(s), 0), 6) AS score, round(coalesce(sum(s), 0) / greatest(len(any_value(w)), 1), 6) AS mean_score
FROM docs LEFT JOIN logs USING (r) GROUP BY docs.r, docs.doc_id
"""
