"""The vector index against a scan of everything."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import cells, retrieval
from spindrift.sources import shared

CHUNK = "space_key string, chunk_id string, embedding array<double>"


def clustered(n, dimension, groups, seed=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dimension)) * 4
    return [("AB"[i % 2], f"{i:05d}", (middles[i % groups] + rng.normal(size=dimension) * 0.2).tolist()) for i in range(n)]


def both(spark, tmp_path, rows, asked, k, **options):
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = spark.createDataFrame(asked, "query_id int, query_embedding array<double>")
    index = cells.build(chunks, str(tmp_path / f"cells-{random.random()}"), **options)
    key = lambda r: (r.query_id, r.vector_rank, r.space_key, r.chunk_id, None if r.distance != r.distance else round(r.distance, 12))
    found = cells.candidates(index, queries, k)
    return index, found, sorted(map(key, found.collect()), key=repr), sorted(map(key, retrieval.vector_candidates(chunks, queries, k).collect()), key=repr)


def test_cells_find_what_a_scan_finds(spark, tmp_path):
    rows = clustered(600, 6, 15)
    rows += [("A", f"t{i}", rows[0][2]) for i in range(40)]  # ties
    rows += [("A", f"z{i}", [0.0] * 6) for i in range(3)] + [("A", "n", None)]
    asked = [(i, rows[i * 7][2]) for i in range(20)] + [(100, [1.0, -1.0, 0.5, 0.0, 0.0, 3.0]), (101, [0.0] * 6), (102, [1e-9] * 6)]
    for k, options in ((1, {}), (5, {}), (20, {"cells": 3}), (30, {"cells": 200, "sample": 50})):
        _, _, got, want = both(spark, tmp_path, rows, asked, k, **options)
        assert got == want


def test_more_asked_than_there_are(spark, tmp_path):
    rows = [("A", "a", [1.0, 0.0]), ("A", "b", [0.0, 0.0]), ("A", "c", [0.0, 2.0])]
    _, _, got, want = both(spark, tmp_path, rows, [(1, [1.0, 1.0]), (2, [0.0, 0.0])], 10)
    assert got == want and len(got) == 6
    _, _, got, want = both(spark, tmp_path, rows[1:2], [(1, [1.0, 1.0])], 10)
    assert got == want and len(got) == 1


@pytest.mark.parametrize("seed", range(3))
def test_random_directions(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = [("A", f"{i:04d}", rng.normal(size=4).round(seed).tolist()) for i in range(300)]
    _, _, got, want = both(spark, tmp_path, rows, [(i, rng.normal(size=4).tolist()) for i in range(12)], 7)
    assert got == want


def test_only_cells_that_can_hold_an_answer_are_read(spark, tmp_path):
    rows = clustered(1200, 8, 24)
    index, found, got, want = both(spark, tmp_path, rows, [(1, rows[3][2])], 10, cells=24)
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    read = [set(re.findall(r"\d+", x)) for x in re.findall(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([^)]*)\)", plan)] + [{x} for x in re.findall(r"PartitionFilters: \[[^\]]*\(cell#\d+ = (\d+)\)", plan)]
    assert read and len(set().union(*read)) <= 3
    asked = spark.createDataFrame([(1, rows[3][2])], "query_id int, query_embedding array<double>").select("query_id", F.col("query_embedding").alias("q"), F.lit(1.0).alias("m"))
    assert cells._scored(index, asked, cells._pairs(index, asked, 10, None), 1).count() < len(rows) / 8


def test_folders_are_removed(spark):
    path = shared.own_folder(spark, "cells")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    shared.remove(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
