"""Counts of shared members against all pairs, through many blocks and few rows at a time."""

import random

import numpy as np
import pyarrow as pa

from spindrift.operators import postings, retrieval


def _sets(rng, n):
    made = [[sorted(set(rng.choices(["  a", "abc", "é x", "高", "𝒳y ", "q", "r", "s"], k=rng.randrange(0, 8)))) for _ in range(n)] for _ in range(2)]
    made[0][3] = made[1][5] = None
    return made


def test_blocks_of_sets_give_all_pairs(spark, monkeypatch):
    made = _sets(random.Random(4), 50)
    left, right = (spark.createDataFrame([(f"{n}{i}", x) for i, x in enumerate(s)], f"{n}_id string, trigrams array<string>") for s, n in zip(made, ("left", "right")))
    a, b = ({f"{n}{i}": set(x or ()) for i, x in enumerate(s)} for s, n in zip(made, ("left", "right")))
    want = {(i, j, len(x), len(y), len(x & y)) for i, x in a.items() for j, y in b.items() if x & y}
    for sets, pairs in ((20_000, 1 << 20), (7, 3)):
        monkeypatch.setattr(postings, "SETS", sets)
        monkeypatch.setattr(postings, "PAIRS", pairs)
        assert len(list(postings._blocks(right))) == 1 if sets > 50 else len(list(postings._blocks(right))) > 7
        assert sorted(map(tuple, postings.shared(left, right, lambda n, m, both: both > 0).collect())) == sorted(want)


def test_long_lists_are_followed_in_pieces(monkeypatch):
    made = _sets(random.Random(5), 40)
    held = [x or [] for x in made[1]]
    lists = postings._Lists.of(pa.table({"right_id": list(range(40)), "trigrams": held}))
    code = {t: i for i, t in enumerate(lists.members.to_pylist())}
    rows = [[code[t] for t in x or [] if t in code] for x in made[0]]
    want = [[len(set(x or []) & set(y)) for y in held] for x in made[0]]
    for places in (1, 50, 1 << 21):
        monkeypatch.setattr(postings, "PLACES", places)
        got = lists.counts(np.repeat(np.arange(40), [len(x) for x in rows]), np.concatenate([np.array(x, np.int64) for x in rows]), 40)
        assert got.tolist() == want


def test_no_rows_of_single_trigrams_move_for_held_sets(spark):
    left, right = (spark.createDataFrame([(1, ["a", "b"])], f"{n}_id int, trigrams array<string>") for n in ("left", "right"))
    plan = retrieval.holding_sets(left, right, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_no_rows_of_single_trigrams_move_for_similar_sets(spark):
    left, right = (spark.createDataFrame([(1, ["a", "b"])], f"{n}_id int, trigrams array<string>") for n in ("left", "right"))
    plan = retrieval.similar_sets(left, right, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
