"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A sentence's probability is a logistic function of its words and their beginnings, hashed to buckets; a document's is the noisy-or of its
sentences': one minus the product of what is left by each. The likelihood of the documents' labels is climbed on all weights
at once, with steps scaled by each weight's past gradients and weights shrunk towards zero, so that most stay zero. Since
a document is toxic as soon as one sentence is, the weight settles on the words of the sentences that make it so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._words import LOWER, U64, chunks, mix, word_hashes

#: The bounds on labelled documents and on their bytes for the fit, both on the driver; buckets of words.
SAMPLE, SAMPLE_BYTES, BUCKETS = 4000, 48 << 20, 1 << 18
#: Passes, the length of steps, the shrinking of weights; documents that must hold a bucket.
PASSES, STEP, SHRINK, FEWEST = 100, 0.5, 1.0, 3
#: How much larger a bucket's share of toxic documents must be than its share of clean ones; else it has no weight.
LIFT = 2.0
#: The share of buckets that a pass sees: words must do without the others that a document has, or one would speak for all.
KEPT = 0.7
#: From this score on a sentence offends.
OFFENDS = 0.5

_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
#: ASCII other than letters and digits parts words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
#: Lengths in bytes of words' beginnings; a whole word is none of its own.
_HEADS = range(3, 9)
_FOUND = "array<struct<start:bigint,end:bigint,score:double,text:string>>"


def instances(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By ranges of rows: first row, end, buckets of words and beginnings, their sentences, sentences' rows, and their first and end bytes in the column.

    A sentence ends with [.!?] or a line; stretches without a word are none.
    """
    shift = U64(64 - (BUCKETS - 1).bit_length())
    for i, j, data, at in chunks(column):
        low, high = int(at[0]), int(at[-1])
        plain = _PLAIN[data[low:high]]
        h, _, starts, stops = word_hashes(plain, at - low)
        edges = np.unique(np.concatenate([at[:-1] - low, at[1:] - low, np.flatnonzero(_END[data[low:high]]) + 1]))
        piece = np.searchsorted(edges, starts, "right") - 1
        full, sentence = np.unique(piece, return_inverse=True)
        rows = np.searchsorted(at[1:] - low, edges[full], "right")
        ends = edges[np.minimum(full + 1, len(edges) - 1)] if len(full) else full
        found, owner = [(mix(h, 81) >> shift).astype(np.int32)], [sentence]
        head, some = np.zeros(len(h), U64), np.arange(len(h))
        plain = LOWER[plain]
        for k in range(1, _HEADS.stop):
            head = head * U64(0x9E3779B97F4A7C15) + plain[starts[some] + k - 1]
            longer = stops[some] - starts[some] > k
            head, some = head[longer], some[longer]
            if k in _HEADS:
                found.append((mix(head, 81 + k) >> shift).astype(np.int32))
                owner.append(sentence[some])
        yield i, j, np.concatenate(found), np.concatenate(owner), rows, edges[full] + low, ends + low


class Model:
    """weights of buckets and the offset of a sentence's logit."""

    def __init__(self, weights: np.ndarray, offset: float) -> None:
        self.weights, self.offset = weights.astype(np.float32), offset

    def logits(self, buckets: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Of n sentences, of which every distinct bucket counts once."""
        some = np.flatnonzero(self.weights[buckets])
        pairs = np.unique(sentence[some] * BUCKETS + buckets[some])
        return self.offset + np.bincount(pairs // BUCKETS, self.weights[pairs % BUCKETS], n)


def noisy_or(logits: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The probability of each of n documents that one of its sentences at least is toxic; 0 without sentences."""
    return -np.expm1(-np.bincount(rows, np.logaddexp(0, logits), n))


def gradient(logits: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """The labels' mean negative log-likelihood, and what it gains with each sentence's logit (times the number of documents)."""
    clean = np.bincount(rows, np.logaddexp(0, logits), len(toxic))  # minus the log of what the sentences leave
    clean = np.maximum(clean, 1e-12)
    some = 1 / (1 + np.exp(-logits))
    pull = np.where(toxic, -1 / np.expm1(np.minimum(clean, 500)), 1.0)
    loss = np.where(toxic, -np.log(-np.expm1(-clean)), clean).mean()
    return float(loss), some * pull[rows]


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, passes: int = PASSES) -> Model:
    """A model of documents, each its buckets and their sentence numbers; labels 0 or 1. With one class only, or none, all sentences are alike."""
    toxic = np.asarray(toxic) > 0
    weights = np.zeros(BUCKETS)
    counts = np.array([int(s.max()) + 1 if len(s) else 0 for _, s in bags], np.int64)
    rows = np.repeat(np.arange(len(bags)), counts)
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    offset = float(np.log(np.expm1(-np.log1p(-share) / max(1.0, counts.mean() if len(counts) else 1.0))))
    if not toxic.any() or toxic.all():
        return Model(weights, offset)
    held = np.zeros((2, BUCKETS), np.int64)
    for (b, _), y in zip(bags, toxic.astype(int)):
        held[y, np.unique(b)] += 1
    lift = (held[1] + 0.5) / toxic.sum() / ((held[0] + 0.5) / (~toxic).sum())
    known = np.flatnonzero((held.sum(0) >= FEWEST) & (lift >= LIFT))
    number = np.full(BUCKETS, -1, np.int32)
    number[known] = np.arange(len(known))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    pairs = [(number[b], (s + f).astype(np.int32)) for (b, s), f in zip(bags, first)]
    bucket, sentence = (np.concatenate([p[k][p[0] >= 0] for p in pairs]) for k in (0, 1))
    w, past, past_offset = np.zeros(len(known)), np.full(len(known), 1e-6), 1e-6
    dice = np.random.default_rng(13).integers(0, 256, len(bucket), np.uint8)
    for k in range(passes):
        kept = dice + np.uint8(97 * k % 256) < KEPT * 256
        some, of = bucket[kept], sentence[kept]
        logits = offset + np.bincount(of, w[some], len(rows))
        _, pull = gradient(logits, rows, toxic)
        g = np.bincount(some, pull[of], len(known)) / len(toxic)
        past += g * g
        rate = STEP / np.sqrt(past)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK / len(toxic), 0)
        g0 = pull.sum() / len(toxic)
        past_offset += g0 * g0
        offset -= STEP * g0 / np.sqrt(past_offset)
    # with all buckets seen sentences weigh more: a slope for all weights, and the offset again
    sums, slope, past = np.bincount(sentence, w[bucket], len(rows)), 1.0, np.full(2, 1e-6)
    for _ in range(passes):
        _, pull = gradient(offset + slope * sums, rows, toxic)
        g2 = np.array([pull @ sums, pull.sum()]) / len(toxic)
        past += g2 * g2
        slope, offset = np.array([slope, offset]) - STEP / 4 * g2 / np.sqrt(past)
    weights[known] = max(slope, 0.0) * w
    return Model(weights, float(offset))


def _bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row's number, its buckets and their sentences, counted from 0; a bucket once a sentence."""
    for i, j, buckets, sentence, rows, _, _ in instances(column):
        pairs = np.unique(sentence * BUCKETS + buckets)
        cuts = np.searchsorted(rows[pairs // BUCKETS], np.arange(j - i + 1))
        for r in range(j - i):
            own = pairs[cuts[r] : cuts[r + 1]]
            yield i + r, own % BUCKETS, own // BUCKETS - (own[0] // BUCKETS if len(own) else 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the texts in docs(doc_id, text) with labels(doc_id, label): of `sample` of them, and of `sample_bytes` of text, at most.

    The sample is the first by md5 of doc_id. Documents with a null label or contradicting ones, with labels other than 0
    and 1, a null doc_id or no text teach nothing; where a doc_id has several texts, each teaches. The
    driver gets 8 bytes for a bucket of a sentence of the sample.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label is not null")
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top and label in (0, 1)").select("doc_id", "label")
    chosen = labels.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")  # `sample` rows
    texts = texts.withColumn("order", F.md5(F.col("doc_id").cast("string"))).orderBy("order", "doc_id", F.md5("text")).limit(sample)
    turn = Window.orderBy("order", "doc_id", F.md5("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over `sample` rows
    texts = texts.withColumn("bytes", F.sum(F.octet_length("text")).over(turn)).where(F.col("bytes") <= sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(b.astype(np.int32).tobytes(), s.astype(np.int32).tobytes()) for _, b, s in _bags(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], ["label", "buckets", "sentences"])

    bags, y = [], []
    for r in texts.select("label", "text").mapInArrow(run, "label int, buckets binary, sentences binary").toLocalIterator():
        bags.append((np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["sentences"], np.int32)))
        y.append(r["label"])
    return fit_bags(bags, np.array(y))


def _offset(data: np.ndarray, base: int, at: int) -> int:
    """The number of code points from byte `base` to byte `at`."""
    return int((data[base:at] & 0xC0 != 0x80).sum())


def locate(docs: DataFrame, model: Model, least: float = OFFENDS) -> DataFrame:
    """doc_id, score, n_sentences, offending (start, end, score, text) of every whole text.

    score, in 0 to 1, is higher for what label 1 marks; texts without words, null and empty ones have 0. A sentence offends
    from `least` on; where a text's score is so high without such a sentence, its best one (ties: the first) does. start and end count
    code points. doc_id is passed through, nulls and repeats as well; other columns are left out; no rows give no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            n = len(column)
            scores, numbers = np.zeros(n), np.zeros(n, np.int64)
            offending: list[list[dict]] = [[]] * n
            for (i, j, buckets, sentence, rows, starts, ends), (_, _, data, at) in zip(instances(column), chunks(column)):
                logits = model.logits(buckets, sentence, len(rows))
                scores[i:j] = noisy_or(logits, rows, j - i)
                numbers[i:j] = np.bincount(rows, minlength=j - i)
                cuts = np.searchsorted(rows, np.arange(j - i + 1))
                for r in np.flatnonzero(scores[i:j] >= least).tolist():
                    own = 1 / (1 + np.exp(-logits[cuts[r] : cuts[r + 1]]))
                    bad = np.flatnonzero(own >= least)
                    found, seen, base = [], 0, int(at[r])
                    for k in (bad if len(bad) else own.argmax()[None]).tolist():
                        a, b = int(starts[cuts[r] + k]), int(ends[cuts[r] + k])
                        seen += _offset(data, base, a)
                        size = _offset(data, a, b)
                        found.append({"start": seen, "end": seen + size, "score": float(own[k]), "text": data[a:b].tobytes().decode()})
                        seen, base = seen + size, b
                    offending[i + r] = found
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(numbers), pa.array(offending, kind)], ["doc_id", "score", "n_sentences", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, n_sentences bigint, offending {_FOUND}")
