"""How blocks of queries and of codes meet in operator 6."""

import numpy as np

from spindrift.llm import rotated_codes


def test_blocks_meet_by_shuffles_not_through_the_driver(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    plan = rotated_codes.nearest(df, df.where("vec_id % 10 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [row#" in plan
    assert not any("BroadcastHashJoin [row#" in line or "BroadcastHashJoin [shard#" in line for line in plan.splitlines())


def test_grid_moves_no_more_than_in_proportion():
    for n in (10_000, 100_000, 1_000_000, 10_000_000):
        q = n // 100
        rows, columns = rotated_codes.grid(n, q, 64, 200, -(-q // rotated_codes.QUERY_BLOCK))
        assert q * columns * 528 + n * rows * 64 <= 800 * n and rows * columns >= 40
    assert rotated_codes.grid(5, 1, 64, 200, 1)[0] == 1
