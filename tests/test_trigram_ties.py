"""Equal similarities around the k-th, for several queries at once, and how often texts are searched."""

import random
import re

from test_retrieval import plain_word_similarity

from spindrift.operators import retrieval


def test_ties_at_the_last_rank_go_by_key_and_texts_are_searched_once(spark):
    rng = random.Random(12)
    texts = [rng.choice(["creative commons", "a licence of creative minds", "all rights", "", "rights of commons"]) + rng.choice([" x", " é", ""]) for _ in range(120)]
    chunks = spark.createDataFrame([(rng.choice("AB"), f"{i:03d}", t) for i, t in enumerate(texts)], "space_key string, chunk_id string, content string").repartition(3)
    keys = {r.chunk_id: r.space_key for r in chunks.collect()}
    questions = {"a": "creative commons", "b": "alle rechte", "c": "commons rights minds"}
    asked = spark.createDataFrame(list(questions.items()), "query_id string, query_text string")
    for k in (1, 4, 30):
        df = retrieval.trigram_candidates(chunks, asked, k, 0.1)
        got = {(r.query_id, r.trgm_rank): (r.space_key, r.chunk_id, round(r.trgm_score, 9)) for r in df.collect()}
        want = {}
        for q, text in questions.items():
            scores = [(-round(plain_word_similarity(text, t), 9), keys[f"{i:03d}"], f"{i:03d}") for i, t in enumerate(texts)]
            want |= {(q, i): (s, c, -x) for i, (x, s, c) in enumerate(sorted(x for x in scores if x[0] <= -0.1)[:k], 1)}
        assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "collect_list" in plan


def test_the_kth_is_learned_from_ten_times_as_many_texts(spark):
    chunks = spark.createDataFrame([("A", "1", "creative commons")], "space_key string, chunk_id string, content string")
    asked = spark.createDataFrame([("a", "commons")], "query_id string, query_text string")
    plan = retrieval.trigram_candidates(chunks, asked, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"first#\d+ <= 40\)", plan)
