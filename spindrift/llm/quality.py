"""Quality classification by Naive Bayes support vectors.

Features are indicators of hashed n-grams: words, pairs of words and runs of three bytes, as written.
Each is scaled by its class log-count ratio; rows are scaled to length one; a linear hinge-loss model is
fitted to them by dual coordinate descent. Margins of rows left out of the fit set a logistic curve that
turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._words import U64, chunks, mix, word_hashes

#: The bound on labelled documents for the fit, buckets; the fit's constants. A document is BUCKETS / 8 bytes on the driver at most.
SAMPLE, BUCKETS = 4000, 1 << 18
PASSES, COST, FOLDS, SMOOTH = 12, 1.0, 3, 1.0


def indicators(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number and the buckets of its n-grams, ascending."""
    shift = U64(64 - (BUCKETS - 1).bit_length())
    for i, j, data, at in chunks(column):
        h, bounds, starts, ends = word_hashes(data, at, lower=False)
        one = (mix(h, 71) >> shift).astype(np.int64)
        two = (mix(h[:-1] * U64(3) + mix(h[1:], 72), 73) >> shift).astype(np.int64)
        two[h[1:] == h[:-1]] = BUCKETS - 1  # a word after itself is one n-gram, whatever the word
        b = data[at[0] : at[-1]].astype(U64)
        three = (mix(b[:-2] | (b[1:-1] << U64(8)) | (b[2:] << U64(16)), 74) >> shift).astype(np.int64) if len(b) > 2 else np.zeros(0, np.int64)
        flags = np.zeros(BUCKETS, bool)
        for r in range(j - i):
            w0, w1 = bounds[r], bounds[r + 1]
            b0, b1 = int(at[r] - at[0]), int(at[r + 1] - at[0])
            used = np.concatenate([one[w0:w1], two[w0 : max(w0, w1 - 1)], three[b0 : max(b0, b1 - 2)]])
            if len(used) < BUCKETS // 16:
                yield i + r, np.unique(used)
            else:
                flags[used] = True
                found = np.flatnonzero(flags)
                flags[found] = False
                yield i + r, found


def packed(x: np.ndarray) -> bytes:
    """Ascending buckets as numbers, or as a bitmap where that is shorter: BUCKETS / 8 bytes at most."""
    if len(x) * 4 < BUCKETS // 8:
        return x.astype(np.int32).tobytes()
    flags = np.zeros(BUCKETS, bool)
    flags[x] = True
    return np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < BUCKETS // 8:
        return np.frombuffer(data, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


class Model:
    """weights of buckets (class ratios included), the offset, and the curve from margins to probabilities."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, offset: float, slope: float, middle: float) -> None:
        self.ratio2 = (ratio * ratio).astype(np.float32)
        self.weights = (ratio * weights).astype(np.float32)
        self.offset, self.slope, self.middle = offset, slope, middle

    def margin(self, x: np.ndarray) -> float:
        norm = float(np.sqrt(self.ratio2[x].sum(dtype=np.float64)))
        return float(self.weights[x].sum(dtype=np.float64)) / norm + self.offset if norm > 0 else self.offset

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.middle, -500, 500))))


def log_ratio(rows: list[bytes], y: np.ndarray) -> np.ndarray:
    """Of each bucket: log of its smoothed share among rows of class 1 over that among class -1."""
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[unpacked(x)] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[bytes], y: np.ndarray, ratio: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and offset of least hinge loss, by coordinate descent in the dual; the classes weigh alike.

    A row's values are its buckets' ratios, scaled to length one; they are made again at each step, so that
    memory holds packed rows only.
    """
    squares = np.array([(ratio[unpacked(x)] ** 2).sum() for x in rows])
    scale = 1 / np.sqrt(np.where(squares > 0, squares, 1))
    w, b = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(y))
    n = len(y)
    most = costs(y)
    square = squares * scale * scale + 1.0
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(n).tolist():
            x = unpacked(rows[i])
            v = ratio[x] * scale[i]
            gradient = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[x] += step * v
                b += step
    return w, b


def costs(y: np.ndarray) -> np.ndarray:
    """What a row's hinge loss costs: both classes COST times half of all rows."""
    return COST * len(y) / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the curve, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - t) * margins).sum(), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins * margins).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def fit_rows(rows: list[bytes], labels: np.ndarray) -> Model:
    """A model of packed rows of buckets with labels 0 or 1; of one class only, or of none, a constant one."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    if not pos or not neg:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log((pos + 1) / (neg + 1))))
    margins, fold = np.zeros(len(y)), np.zeros(len(y), int)
    for side in (y > 0, y < 0):
        fold[side] = np.arange(side.sum()) % FOLDS
    for k in range(FOLDS):
        fit = np.flatnonzero(fold != k)
        if len(set(y[fit])) < 2:
            continue
        train = [rows[i] for i in fit]
        ratio = log_ratio(train, y[fit])
        part = Model(ratio, *dual_descent(train, y[fit], ratio), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(unpacked(rows[i]))
    ratio = log_ratio(rows, y)
    return Model(ratio, *dual_descent(rows, y, ratio), *logistic(margins, y))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the texts in docs(doc_id, text) with labels(doc_id, label): of at most `sample` of them.

    The sample is the first by md5 of doc_id. Documents with a null or with contradicting labels, a null
    doc_id or no text row teach nothing; where a doc_id has several texts, each teaches. The driver gets the
    sample's buckets: `sample` times BUCKETS / 8 bytes at most (131 MB), whatever the texts.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label is not null")
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").select("doc_id", "label")
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = labels.orderBy(order, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(x) for _, x in indicators(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "buckets"])

    got = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, buckets binary")
    got = got.withColumn("order", F.md5(F.col("doc_id").cast("string"))).orderBy("order", "doc_id", "buckets").select("label", "buckets")
    rows, y = [], []
    for r in got.limit(sample).toLocalIterator():
        rows.append(bytes(r["buckets"]))
        y.append(r["label"])
    return fit_rows(rows, np.array(y))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score double in 0 to 1 of every whole text, higher for what label 1 marks.

    Null and empty texts have the score of a text without n-grams. doc_id is passed through, nulls and
    repeats as well; other columns are left out; no rows give no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(x) for _, x in indicators(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
