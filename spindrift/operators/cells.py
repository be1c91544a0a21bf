"""An exact vector index: cells around centres, skipped by the triangle inequality.

Vectors are scaled to length one, where half the squared straight distance is the cosine distance. Every vector belongs to the
cell of its nearest centre; a cell knows the smallest and the largest distance of its vectors from there. What is at most r
from a centre is at least d - r from a query at distance d, so a cell whose bound lies beyond the k-th best distance found so
far holds no answer and is not read. The nearest cells with k vectors give a first k-th distance, the cells
that it doesn't exclude the rest. Answers are those of a scan of everything, ties and zero vectors included.

Centres come from a bounded sample; how well they fit decides how many cells are read, never what is found.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import vectors as V
from spindrift.operators import blocks, retrieval

#: The most vectors that centres are fitted to, the most centres, and the rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 8
#: What straight distances may be off by rounding.
SLACK = 1e-6
#: The cell of vectors that have no direction.
NOWHERE = -1
KEY = retrieval.KEY


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors from centres."""
    squares = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(squares, 0))


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors by Lloyd's rounds, from spread-out first ones."""
    rng = np.random.default_rng(5)
    cells = min(cells, len(np.unique(sample, axis=0)))
    centres = sample[rng.choice(len(sample), 1)]
    near = _far(sample, centres)[:, 0]
    while len(centres) < cells:  # the next are drawn by their squared distances from those there are
        some = min(cells - len(centres), max(1, len(centres)))
        weight = near * near
        if weight.sum() <= 0:
            break
        more = sample[rng.choice(len(sample), some, p=weight / weight.sum())]
        centres = np.vstack([centres, more])
        near = np.minimum(near, _far(sample, more).min(1))
    for _ in range(rounds):
        of = _far(sample, centres).argmin(1)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Cells(NamedTuple):
    """vectors(cell, key, embedding, norm), partitioned by cell; of each cell the number, centre and distances of its vectors."""

    vectors: DataFrame
    numbers: np.ndarray
    counts: np.ndarray
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit queries: distances from the centres, and how near a vector of each cell can be."""
        if not len(self.centres):
            return np.zeros((len(asked), 0)), np.zeros((len(asked), 0))
        far = _far(asked, self.centres)
        return far, np.maximum(np.maximum(far - self.high, self.low - far), 0)


def build(chunks: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Writes the cells of chunks(key, embedding) under a folder that all executors share; by default as many as the root of the number of chunks."""
    spark = chunks.sparkSession
    base = chunks.select(*KEY, V.doubles(F.col("embedding")).alias("embedding")).withColumn("norm", V.norm(F.col("embedding")))
    whole = (F.col("norm") > 0) & (F.col("norm") < F.lit(float("inf")))  # a vector with NaN has a norm above all
    n = base.count()
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
    rows = base.where(whole).orderBy(F.xxhash64(*KEY), *KEY).limit(sample).select("embedding").collect()
    vectors = np.array([r[0] for r in rows], np.float64)
    centres = centres_of(_unit(vectors), cells) if len(vectors) else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = batch.column("norm").to_numpy(zero_copy_only=False)
            good = np.flatnonzero((norms > 0) & (norms < np.inf))
            cell, far = np.full(len(batch), NOWHERE), np.zeros(len(batch))
            if len(good) and len(centres):
                x = np.stack(batch.column("embedding").take(pa.array(good)).to_numpy(zero_copy_only=False)) / norms[good][:, None]
                for a in range(0, len(good), 1024):
                    d = _far(x[a : a + 1024], centres)
                    cell[good[a : a + 1024]] = d.argmin(1)
                    far[good[a : a + 1024]] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], [*batch.schema.names, "cell", "far"])

    found = base.mapInArrow(assign, "space_key string, chunk_id string, embedding array<double>, norm double, cell int, far double")
    # ranges, so that a cell with most vectors is written by several tasks
    found.repartitionByRange("cell", *KEY).sortWithinPartitions("cell", *KEY).write.partitionBy("cell").parquet(f"{folder}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{folder}/centres")
    spark.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).write.parquet(f"{folder}/extents")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Cells:
    """The cells that build() wrote; the driver gets one row for each, MOST_CELLS at most."""
    vectors = spark.read.schema("space_key string, chunk_id string, embedding array<double>, norm double, far double, cell int").parquet(f"{folder}/vectors")
    rows = spark.read.parquet(f"{folder}/extents").join(spark.read.parquet(f"{folder}/centres"), "cell").orderBy("cell").collect()
    column = lambda name, kind: np.array([r[name] for r in rows], kind)
    return Cells(vectors, column("cell", np.int64), column("n", np.int64), column("centre", np.float64), column("low", np.float64), column("high", np.float64))


def _pairs(cells: Cells, asked: DataFrame, k: int, reach: DataFrame | None) -> DataFrame:
    """query_id, cell: the nearest cells that together have k vectors, or all others that a query's `reach` touches."""
    kind = asked.schema["query_id"].dataType.simpleString()
    plain, nearest = Cells(None, *cells[1:]), reach is None  # what goes to tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column("q").to_numpy(zero_copy_only=False)) / batch.column("m").to_numpy()[:, None] if len(batch) else np.zeros((0, 1))
            at, out = [], []
            for i in range(len(x)):
                far, bound = plain.bounds(x[i : i + 1])
                order = np.argsort(far[0], kind="stable")
                before = np.cumsum(plain.counts[order]) - plain.counts[order]
                first = np.zeros(len(order), bool)
                first[order] = before < k
                chosen = first if nearest else ~first & (bound[0] <= batch.column("reach")[i].as_py() + SLACK)
                own = plain.numbers[chosen]
                at.append(np.full(len(own), i))
                out.append(own)
            at, out = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (at, out))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.int32())], ["query_id", "cell"])

    rows = asked.select("query_id", "q", "m") if reach is None else asked.join(reach, "query_id").select("query_id", "q", "m", "reach")
    return rows.mapInArrow(run, f"query_id {kind}, cell int")


def _scored(cells: Cells, asked: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """query_id, key, distance of the pairs' queries and all vectors of their cells. Only these cells' files are read."""
    spark = asked.sparkSession
    found = pairs.collect() if n <= retrieval.MOST_QUERIES else None  # at most queries x cells numbers
    if found is not None:
        pairs = retrieval._if_small(spark.createDataFrame(found, pairs.schema), len(found))
        wanted = sorted({r["cell"] for r in found})
    else:
        wanted = [r[0] for r in pairs.select("cell").distinct().collect()]
    near = cells.vectors.where(F.col("cell").isin(wanted)).select("cell", *KEY, "embedding", "norm").join(pairs, "cell")
    full = near.join(F.broadcast(asked) if n <= retrieval.MOST_QUERIES else asked, "query_id")
    return full.select("query_id", *KEY, V.cosine_distance(F.col("embedding"), F.col("q"), F.col("norm"), F.col("m")).alias("distance"))


def _rest(cells: Cells, asked: DataFrame, reach: DataFrame, k: int) -> DataFrame:
    """query_id, key, distance of vectors that may be as near as a query's reach, the k nearest of each task; nothing is listed by query and cell."""
    plain, numbers = Cells(None, *cells[1:]), cells.numbers[cells.numbers != NOWHERE]

    def touched(x: np.ndarray, norms: np.ndarray, rows: pa.Table) -> np.ndarray:
        reach, out = rows["reach"].to_numpy(), np.zeros((len(x), len(plain.numbers)), bool)
        for i in range(0, len(x), 512):
            s = slice(i, i + 512)
            out[s] = plain.bounds(x[s] / norms[s][:, None])[1] <= reach[s][:, None] + SLACK
        return out

    found = []
    for some in retrieval._blocks(asked.join(reach, "query_id").select("query_id", "q", "m", "reach")):
        rows = some.toArrow().combine_chunks()
        wanted = np.zeros(len(plain.numbers), bool)
        for i in range(0, len(rows), 512):
            few = rows.slice(i, 512).combine_chunks()
            if len(plain.numbers):
                wanted |= touched(np.stack(few["q"].to_numpy()), few["m"].to_numpy(), few).any(0)
        near = cells.vectors.where(F.col("cell").isin(plain.numbers[wanted].tolist())).select("cell", *KEY, F.col("embedding").alias("v"), F.col("norm").alias("n"))
        found.append(blocks.nearest(near, some, k, touched, numbers))
    return functools.reduce(DataFrame.unionByName, found)


def candidates(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """retrieval.vector_candidates() by cells: query_id, key, distance, vector_rank of the k nearest of each of queries(query_id, query_embedding).

    Runs two jobs while the plan is made, to learn how far each query has to look and which cells' files that needs.
    Queries must have distinct ids, which are compared as they are.
    """
    asked = queries.select("query_id", V.doubles(F.col("query_embedding")).alias("q")).withColumn("m", V.norm(F.col("q")))
    n = asked.count()
    whole = (F.col("m") > 0) & (F.col("m") < F.lit(float("inf")))
    aimed, lost = asked.where(whole), asked.where(~F.coalesce(whole, F.lit(False)))
    order = [F.col("distance").asc()]
    first = _scored(cells, aimed, _pairs(cells, aimed, k, None), n)
    best = retrieval._ranked(first, order, k, "vector_rank")
    reach = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(2 * F.max("distance"), F.lit(0.0)))).otherwise(F.lit(float("inf"))).alias("reach"))
    if n <= retrieval.MOST_QUERIES:
        reach = asked.sparkSession.createDataFrame(reach.collect(), reach.schema)
    rest = _rest(cells, aimed, reach, k)
    # vectors without a direction have no distance: the first by key follow all others; for a query without one that holds of all vectors
    nowhere = cells.vectors.where(F.col("cell") == NOWHERE).orderBy(*KEY).limit(k).select(*KEY, F.lit(float("nan")).alias("distance"))
    anywhere = cells.vectors.orderBy(*KEY).limit(k).select(*KEY, F.lit(float("nan")).alias("distance"))
    ends = [retrieval._if_small(few, k).join(some.select("query_id"), F.lit(True)) for few, some in ((nowhere, aimed), (anywhere, lost))]
    every = [x.select("query_id", *KEY, "distance") for x in (rest, *ends)]
    return retrieval._ranked(functools.reduce(DataFrame.unionByName, every), order, k, "vector_rank")
