"""Document fingerprints: one-permutation MinHash of word shingles.

Every shingle is hashed once; its leading bits choose one of `bins` bins, and each bin keeps its
smallest hash. Bins that stay empty copy a filled bin that a 2-universal hash of (bin, attempt)
picks (optimal densification). A fingerprint holds the low `bits` bits of every bin's hash, packed as
hexadecimal digits; likeness() takes the chance agreement of low bits out of the share of equal bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._words import U64, chunks, mix, shingle_hashes, word_hashes

BINS, BITS, WORDS = 256, 4, 5
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def codes(data: np.ndarray, at: np.ndarray, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> np.ndarray:
    """The low bits of each row's bins, as a matrix of bytes; a row without words is all zero."""
    h, bounds, _, _ = word_hashes(data, at)
    s, bounds = shingle_hashes(h, bounds, words)
    rows = len(at) - 1
    table = np.full(rows * bins, _EMPTY, U64)
    if len(s):
        lead = U64(64 - (bins - 1).bit_length())
        row = np.repeat(np.arange(rows), np.diff(bounds))
        np.minimum.at(table, row * bins + (s >> lead).astype(np.int64), s >> U64(1))
    table = table.reshape(rows, bins)
    filled = table != _EMPTY
    r, b = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(r):
        pick = (mix(b.astype(U64) + U64(bins * attempt), 5) % U64(bins)).astype(np.int64)
        found = filled[r, pick]
        table[r[found], b[found]] = table[r[found], pick[found]]
        r, b = r[~found], b[~found]
        attempt += 1
    # each bin has low bits of its own, so that chance agreement of copied bins is as independent as of others
    low = (mix(table ^ mix(np.arange(bins, dtype=U64), 7)[None, :], 3) & U64((1 << bits) - 1)).astype(np.uint8)
    low[~filled.any(axis=1)] = 0
    return low


def has_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    _, bounds, _, _ = word_hashes(data, at)
    return np.diff(bounds) > 0


def packed(low: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal strings of packed rows; '' for a row without words."""
    plain = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1)
    return [row.tobytes().hex() if ok else "" for row, ok in zip(np.packbits(plain, axis=1), some)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of rows, corrected for chance; two rows without words are alike, one is not."""
    chance = 2.0**-bits
    share = (a == b).mean(axis=1)
    out = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, out, (~some_a & ~some_b).astype(float))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """part int, look boolean, doc_id long, text string: all rows, dealt in parts by ascending doc_id.

    Each part ends, in the order of (look, doc_id, text), with the first rows of the next part marked
    look, so that every row's successor stands in its own part; the last part ends with the first rows
    of all. Parts are cut at quantiles of doc_id; the driver sees two numbers for each part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    number = _bucket(cuts)
    heads = docs.groupBy(number.alias("part")).agg(F.min("doc_id").alias("head"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).orderBy("part").collect()
    before = {(None if h["nulls"] else h["head"]): heads[i - 1]["part"] for i, h in enumerate(heads)}
    # as many rows as parts
    table = spark.createDataFrame([(h, p) for h, p in before.items() if h is not None], "doc_id long, back int")
    docs = docs.join(F.broadcast(table), "doc_id", "left")
    back = F.when(F.col("doc_id").isNull(), F.lit(before.get(None)).cast("int")).otherwise(F.col("back"))
    copies = F.array(F.struct(number.cast("int").alias("part"), F.lit(False).alias("look")), F.struct(back.cast("int").alias("part"), F.lit(True).alias("look")))
    out = docs.withColumn("to", F.explode(F.filter(copies, lambda x: x["part"].isNotNull())))
    out = out.select("to.part", "to.look", "doc_id", "text")
    return out.repartition(max(1, parts), "part").sortWithinPartitions("part", "look", "doc_id", "text")


def _bucket(cuts: list[int]) -> F.Column:
    """How many of the ascending cuts lie below doc_id, by steps that halve."""
    held = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length() or 1))))
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.coalesce(F.get(held, n + step - 1) < F.col("doc_id"), F.lit(False)), n + step).otherwise(n))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below)


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint of every whole text; no shuffle.

    Equal texts have equal fingerprints. Null and empty texts and texts of white space have ''; a text
    of fewer words than a shingle is one shingle; nulls in doc_id stay; repeats stay; columns other than
    doc_id and text are left out; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in chunks(batch.column(1)):
                prints = packed(codes(data, at, bins, bits, words), has_words(data, at), bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited_prints(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Of every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as
    many, or all, of the next row's text. Rows are in the order of (doc_id, text), a null doc_id first;
    after the last comes the first, and a single row follows itself. Null texts count as empty. Repeated
    rows follow each other. Columns other than doc_id and text are left out; no rows give no rows.
    """

    def batches_of(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        ids, texts, nexts = zip(*rows)
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
        sides = []
        for column in (texts, edited, nexts):
            low, some = [], []
            for _, _, data, at in chunks(pa.array(column, pa.large_string())):
                low.append(codes(data, at, bins, bits, words))
                some.append(has_words(data, at))
            sides.append((np.concatenate(low), np.concatenate(some)))
        (own, has), (new, has_new), (after, has_after) = sides
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(packed(own, has, bits), pa.string()), pa.array(packed(new, has_new, bits), pa.string()),
                pa.array(likeness(own, new, has, has_new, bits)), pa.array(likeness(own, after, has, has_after, bits)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, str] | None = None  # part, doc_id, text of the row before
        ready: list[tuple[int, str, str]] = []
        size = 0
        for batch in batches:
            for part, look, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == part:
                    ready.append((held[1], held[2], text))
                    size += len(held[2])
                held = None if look else (part, doc, text)
                if size > 1 << 20:
                    yield batches_of(ready)
                    ready, size = [], 0
        if ready:
            yield batches_of(ready)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
