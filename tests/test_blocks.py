"""Blocks of queries against the Column functions, pair by pair."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import vectors as V
from spindrift.operators import blocks, retrieval


def test_nearest_is_what_all_pairs_give(spark):
    rng = np.random.default_rng(1)
    rows = [("AB"[i % 2], f"{i:03d}", rng.normal(size=5).round(1).tolist()) for i in range(150)]
    rows += [("A", f"t{i}", rows[3][2]) for i in range(9)] + [("B", "z", [0.0] * 5), ("A", "n", None), ("A", "m", [1.0, None, 0.0, 0.0, 1.0]), ("B", "tiny", [1e-170] * 5), ("A", "huge", [1e200] * 5), ("A", "nan", [float("nan")] * 5)]
    chunks = spark.createDataFrame(rows, "space_key string, chunk_id string, embedding array<double>").repartition(3)
    asked = [(i, r[2]) for i, r in enumerate(rows[:12] + rows[-6:])]
    queries = spark.createDataFrame(asked, "query_id int, query_embedding array<double>")
    all_ = chunks.crossJoin(queries).select("query_id", *retrieval.KEY, V.cosine_distance(F.col("embedding"), F.col("query_embedding")).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", *retrieval.KEY)
    for k in (1, 7, 400):
        want = all_.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)
        found = retrieval.vector_candidates(chunks, queries, k)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()  # a pair is no row
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_other_widths_come_first_as_nulls(spark):
    chunks = spark.createDataFrame([("A", "a", [1.0, 0.0]), ("A", "b", [1.0]), ("A", "c", [0.0])], "space_key string, chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, query_embedding array<double>")
    got = [(r.chunk_id, r.distance) for r in retrieval.vector_candidates(chunks, asked, 2).orderBy("vector_rank").collect()]
    assert got[0] == ("b", None) and got[1][0] == "a"


def test_closest_values(spark):
    rng = np.random.default_rng(2)
    rows = [("A", f"{i:03d}", float(rng.integers(0, 20))) for i in range(120)] + [("A", "n", None), ("B", "nan", float("nan")), ("B", "inf", float("inf"))]
    values = spark.createDataFrame(rows, "space_key string, chunk_id string, x double").repartition(2)
    asked = spark.createDataFrame([(i, y) for i, y in enumerate([0.0, 3.5, 19.0, None, float("nan"), float("inf")])], "query_id int, y double")
    order = Window.partitionBy("query_id").orderBy("gap", *retrieval.KEY)
    want = values.crossJoin(asked).select("query_id", *retrieval.KEY, F.abs(F.col("x") - F.col("y")).alias("gap")).withColumn("r", F.row_number().over(order))
    for k in (1, 6, 200):
        found = blocks.closest(values, asked, k).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.where(F.col("r") <= k).collect()))


def test_cells_list_no_pairs_of_queries_and_cells(spark, tmp_path, monkeypatch):
    from spindrift.operators import cells

    rng = np.random.default_rng(6)
    chunks = spark.createDataFrame([("A", f"{i:03d}", rng.normal(size=6).tolist()) for i in range(200)], "space_key string, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(5)], "query_id int, query_embedding array<double>")
    reached = []
    monkeypatch.setattr(cells, "_pairs", lambda c, a, k, reach, real=cells._pairs: reached.append(reach) or real(c, a, k, reach))
    found = cells.candidates(cells.build(chunks, str(tmp_path / "cells")), queries, 4)
    assert reached == [None] and found.count() == 20
