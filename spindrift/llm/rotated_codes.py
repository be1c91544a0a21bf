"""Nearest neighbours by randomly rotated one-bit codes.

A vector's difference from the centre is scaled to length one and turned by a few fixed random rotations; the
signs of its coordinates after each are its code, packed to 64-bit words. A query's turned coordinates are rounded
to four bits and laid out as four bit planes, so their inner product with a code is a sum of counts of common
bits. With the difference's length and its inner products with its own codes' directions, that estimates the
squared distance, with an error that is below a bound but for a small chance. The vectors with the best estimates
are ranked exactly first; then every vector whose lower bound is within the k-th of those distances is.

For 64 dimensions a code has 32 bytes and its factors 24, against 256 of the vector in single precision, and a pair
takes 16 word operations against 64 multiplications. Codes are packed in blocks and queries in blocks; each
block of queries meets each block of codes: both are dealt to the fields of a grid by shuffles, never by a broadcast. No
table of all queries or of all codes is sent to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._shared import saved, scratch

#: Neighbours; standard errors in a bound; rotations; bits of a query's coordinate; queries and codes in a block.
K, ERRORS, ROTATIONS, DEPTH, QUERY_BLOCK, CODE_BLOCK = 10, 2.5, 4, 4, 1024, 4096
#: How many times k estimates are ranked exactly for the limit, and queries that meet a block of codes at once.
_AHEAD, _AT_ONCE = 8, 32


def rotations(d: int, n: int = ROTATIONS, seed: int = 17) -> np.ndarray:
    """n random orthogonal matrices on top of each other, the same for the same arguments; d grows to whole words of 64."""
    d = -(-d // 64) * 64
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id long, v array<double> of the rows that take part: of finite numbers, not all zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("v", lambda x: x != 0.0))


def _turned(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the differences from the centre, and the differences after all rotations."""
    u = np.zeros((len(v), turn.shape[1]))
    u[:, : v.shape[1]] = v - centre
    return np.sqrt((u * u).sum(axis=1)), u @ turn.T


def _encode(v: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs as words, lengths, and the unit vectors' inner products with their code of each rotation."""
    d = turn.shape[1]
    length, u = _turned(v, centre, turn)
    u /= np.where(length > 0, length, 1)[:, None]
    return np.packbits(u > 0, axis=1).view(np.uint64), length, (np.abs(u).reshape(len(v), -1, d).sum(axis=2) / math.sqrt(d)).astype(np.float32)


def grid(n: int, n_queries: int, d: int, tasks: int, split: int) -> tuple[int, int]:
    """Rows and columns of about `tasks` fields: a block of queries goes to all columns, a block of codes to all rows, so that both move about as many bytes."""
    words = -(-d // 64)
    code, query = 8 + 8 * words * ROTATIONS + 8 + 4 * ROTATIONS, 8 * d + 16
    columns = min(tasks, max(1, round(math.sqrt(tasks * n * code / (n_queries * query)))))
    return min(split, max(1, round(tasks / columns))), columns


def codes(vectors: DataFrame, centre: np.ndarray, turn: np.ndarray, size: int = CODE_BLOCK) -> DataFrame:
    """n int, ids binary, bits binary, lengths binary, products binary: the codes of all vectors, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def close() -> pa.RecordBatch:
            ids, bits, lengths, products = (np.concatenate(x) for x in zip(*held))
            row = [[len(ids)], *([x.tobytes()] for x in (ids, bits, lengths, products))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 4))], ["n", "ids", "bits", "lengths", "products"])

        for batch in batches:
            for i in range(0, len(batch), size):
                part = batch.slice(i, size)
                if len(part):
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    held.append((part.column(0).to_numpy(), *_encode(v, centre, turn)))
                    n += len(part)
                if n >= size:
                    yield close()
                    held, n = [], 0
        if held:
            yield close()

    return vectors.mapInArrow(run, "n int, ids binary, bits binary, lengths binary, products binary")


def estimates(queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, words: np.ndarray, lengths: np.ndarray, products: np.ndarray, errors: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances, a row for each query, and the errors that bound them."""
    d, n = turn.shape[1], products.shape[1]
    per = d // 64
    far, u = _turned(queries, centre, turn)
    u = u.reshape(len(u), n, d)
    low, total = u.min(axis=2), u.sum(axis=2)
    step = np.maximum((u.max(axis=2) - low) / (2**DEPTH - 1), 1e-300)
    levels = np.rint((u - low[:, :, None]) / step[:, :, None]).astype(np.uint8)
    planes = [np.packbits(levels >> j & 1, axis=2).reshape(len(u), -1).view(np.uint64) for j in range(DEPTH)]
    ones = np.bitwise_count(words).reshape(len(words), n, per).sum(axis=2).astype(np.float64)
    safe = np.maximum(products.astype(np.float64), 1e-6)
    inner = np.zeros((len(u), len(words)))
    for a in range(0, len(u), _AT_ONCE):
        b = slice(a, a + _AT_ONCE)
        for r in range(n):
            common = np.zeros((len(u[b]), len(words)), np.int64)
            for w in range(r * per, (r + 1) * per):
                own = np.ascontiguousarray(words[:, w])
                for j in range(DEPTH):
                    common += np.bitwise_count(planes[j][b, w, None] & own[None, :]).astype(np.int64) << j
            signed = 2 * (low[b, r, None] * ones[None, :, r] + step[b, r, None] * common) - total[b, r, None]
            inner[b] += signed / (safe[None, :, r] * (n * math.sqrt(d)))
    spread = np.maximum(1 / (safe * safe) - 1, 0).mean(axis=1) / (max(d - 1, 1) * n)
    rounding = (step * step).mean(axis=1)[:, None] / 6 * (1 / (safe * safe)).mean(axis=1)[None, :] / n
    scale = far[:, None] ** 2 + lengths[None, :] ** 2
    middle = scale - 2 * lengths[None, :] * inner
    error = 2 * errors * lengths[None, :] * np.sqrt(far[:, None] ** 2 * spread[None, :] + rounding) + 1e-12 * scale
    return middle, error


def search(vectors: DataFrame, queries: DataFrame, k: int = K, errors: float = ERRORS) -> DataFrame:
    """What nearest() gives, as a saved table of k rows a query; its intermediate tables are removed."""
    with scratch() as kept:
        found = saved(nearest(vectors, queries, k, errors), "neighbours")
        kept.append(found)
    return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, errors: float = ERRORS) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: each query's k nearest vectors found, but itself.

    vectors and queries have vec_id and embedding. Nearness is the Euclidean distance in double precision
    of the vectors as given; rank 1 is nearest, a tie goes to the smaller vec_id. With fewer candidates
    than k, all come. Vectors that are null, all zero, or hold a null, a NaN or an infinity take no part,
    nor do rows with a null vec_id; rows that repeat a vec_id count once, with its smallest vector. All
    vectors must have one length, else ValueError. No vectors or no queries give no rows. Other columns
    are left out. Queries must be of the vectors' length, else ValueError. With ERRORS standard errors a neighbour
    is missed with a chance of about one in 100. Numbers of any magnitude count: codes are of vectors divided by the
    largest component, and where a square would overflow or vanish, so are distances.
    """
    spark = vectors.sparkSession
    base = saved(valid(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asked = saved(valid(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    schema = "query_id long, rank int, vec_id long, score double"
    width, most = F.size("v"), F.array_max(F.transform("v", F.abs))
    n, low, high, top = base.agg(F.count("*"), F.min(width), F.max(width), F.max(most)).first()
    n_queries, asked_low, asked_high, asked_top = asked.agg(F.count("*"), F.min(width), F.max(width), F.max(most)).first()
    if low is None or not n_queries:
        return spark.createDataFrame([], schema)
    if not low == high == asked_low == asked_high:
        raise ValueError(f"vectors of {low} to {high} and queries of {asked_low} to {asked_high} numbers")
    d = low
    unit = 2.0 ** min(max(math.frexp(max(top, asked_top))[1], -1000), 1023)
    centre = np.array(base.agg(*(F.avg(F.col("v")[i] / unit) for i in range(d))).first(), float)
    turn = rotations(d)

    split = max(1, math.ceil(n_queries / QUERY_BLOCK))
    rows, columns = grid(n, n_queries, d, int(spark.conf.get("spark.sql.shuffle.partitions")), split)
    small = base.select("vec_id", F.transform("v", lambda x: x / unit).alias("v"))
    blocks = saved(codes(small, centre, turn), "codes").withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int"))
    blocks = blocks.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def scan(questions: DataFrame, pick) -> DataFrame:
        """query_id, vec_id, near of what pick(estimates, errors, limits) leaves of each block of codes; questions have vec_id, v and limit."""

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            columns = [rows["vec_id"].to_numpy(), rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), rows["limit"].to_numpy()]
            return pa.table({"query_block": pa.array([key[0].as_py()], pa.int32())} | {k: pa.array([c.tobytes()], pa.binary()) for k, c in zip(("query_ids", "vectors", "limits"), columns)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q, v, limits, n, ids, bits, lengths, products in zip(*(c.to_pylist() for c in batch.columns)):
                    q, ids = np.frombuffer(q, np.int64), np.frombuffer(ids, np.int64)
                    middle, error = estimates(np.frombuffer(v, float).reshape(-1, d), centre, turn, np.frombuffer(bits, np.uint64).reshape(n, -1), np.frombuffer(lengths, float), np.frombuffer(products, np.float32).reshape(n, -1), errors)
                    middle[q[:, None] == ids[None, :]] = np.inf
                    r, c = pick(middle, error, np.frombuffer(limits, float))
                    yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(ids[c]), pa.array(middle[r, c].astype(float))], ["query_id", "vec_id", "near"])

        dealt = questions.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(split)).cast("int"))
        query_blocks = dealt.groupBy("query_block").applyInArrow(pack, "query_block int, query_ids binary, vectors binary, limits binary")
        # each block of queries with each block of codes: the stated queries against all rows
        left = query_blocks.withColumn("row", F.pmod("query_block", F.lit(rows))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        # Spark takes an exploded table for as small as what it came from; unless told it would send it to the driver
        pairs = left.hint("merge").join(blocks, ["row", "column"]).select("query_ids", "vectors", "limits", "n", "ids", "bits", "lengths", "products")
        return pairs.mapInArrow(run, "query_id long, vec_id long, near double")

    ahead = _AHEAD * k

    def best(middle: np.ndarray, error: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best estimates of each row."""
        last = np.partition(middle, ahead - 1, axis=1)[:, ahead - 1] if middle.shape[1] > ahead else middle.max(axis=1)
        return np.nonzero((middle <= last[:, None]) & np.isfinite(middle))

    def within(middle: np.ndarray, error: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that may be as near as the limit."""
        return np.nonzero((middle - error <= limits[:, None]) & np.isfinite(middle))

    by = Window.partitionBy("query_id")

    def length(by: float) -> Column:
        return F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a / by - b / by) * (a / by - b / by) if by != 1 else (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.join(base.hint("merge"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        plain = length(1)
        return both.select("query_id", "vec_id", F.when((plain == float("inf")) | (plain < 1e-140), length(unit) * unit).otherwise(plain).alias("score"))

    small_asked = asked.select("vec_id", F.transform("v", lambda x: x / unit).alias("v"))
    first = scan(small_asked.withColumn("limit", F.lit(0.0)), best)
    first = first.withColumn("n", F.row_number().over(by.orderBy("near", "vec_id"))).where(F.col("n") <= ahead)
    # the k-th distance of those bounds the k-th of all; fewer than k are all there are
    near = exact(first.select("query_id", "vec_id")).withColumn("n", F.row_number().over(by.orderBy("score", "vec_id")))
    kth = near.groupBy("query_id").agg((F.max(F.when(F.col("n") == k, F.col("score"))) / unit).alias("s"))
    limits = saved(kth.select("query_id", F.coalesce(F.col("s") * F.col("s") * (1 + 1e-9), F.lit(float("inf"))).alias("limit")), "limits")
    found = scan(small_asked.join(limits, F.col("vec_id") == F.col("query_id")).select("vec_id", "v", "limit"), within)
    ranked = exact(found.select("query_id", "vec_id")).withColumn("rank", F.row_number().over(by.orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The exact search.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, sqrt(list_reduce(list_transform(range(1, len(v) + 1), lambda i: (v[i] - q[i]) * (v[i] - q[i])), lambda s, x: s + x)) AS score FROM q JOIN v ON vec_id <> query_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10
"""
