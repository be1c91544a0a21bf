"""Multiple-instance learning: its formulas against plain ones, planted sentences, and held-out documents."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import queries
from spindrift.llm import toxicity as TX


def test_noisy_or_and_gradient():
    rng = np.random.default_rng(1)
    logits, rows, toxic = rng.normal(-1, 2, 40), np.sort(rng.integers(0, 9, 40)), rng.random(9) < 0.4
    p = 1 / (1 + np.exp(-logits))
    plain = np.array([1 - np.prod(1 - p[rows == d]) for d in range(9)])
    assert np.allclose(TX.noisy_or(logits, rows, 9), plain)
    some = np.isin(np.arange(9), rows)
    loss = lambda z: TX.gradient(z, rows, toxic & some)[0] * 9
    _, slope = TX.gradient(logits, rows, toxic & some)
    for k in range(0, 40, 7):
        step = np.zeros(40)
        step[k] = 1e-5
        assert slope[k] == pytest.approx((loss(logits + step) - loss(logits - step)) / 2e-5, abs=1e-4)


def test_sentences_cover_all_words():
    texts = ["One two. Three!\nfour", "", None, "...", "no end", "é%%% è$$$ a?b"]
    pieces = []
    for i, j, buckets, sentence, rows, starts, ends in TX.instances(pa.array(texts)):
        data = "".join(t or "" for t in texts[i:j]).encode()
        pieces += [(i + r, data[a:b].decode()) for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist())]
        assert set(sentence.tolist()) == set(range(len(rows)))
    assert pieces == [(0, "One two."), (0, " Three!"), (0, "four"), (4, "no end"), (5, "é%%% è$$$ a?"), (5, "b")]


def planted(n=400, seed=2):
    """Documents of made-up sentences; a third have one with a bad word, or with one that starts as bad words do."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for d in range(n):
        sentences = [" ".join(rng.choices(words, k=rng.randint(3, 12))).capitalize() + "." for _ in range(rng.randint(1, 25))]
        bad = None
        if d % 3 == 0:
            k = rng.randrange(len(sentences))
            own = sentences[k].split(" ")
            own.insert(rng.randrange(len(own)), rng.choice(["wretch", "vermin", "Zyxqu" + rng.choice(words)]))
            sentences[k] = bad = " ".join(own)
        rows.append((d, " ".join(sentences), int(d % 3 == 0), bad))
    return rows


def test_offending_sentences_are_found(spark):
    rows = planted()
    table = spark.createDataFrame(rows, "doc_id long, text string, label int, bad string")
    model = TX.fit(table, table.where("doc_id < 300").select("doc_id", "label"))
    found = {r["doc_id"]: r for r in TX.locate(table.repartition(3), model).collect()}
    fresh = [r for r in rows if r[0] >= 300]
    assert np.mean([(found[d]["score"] >= 0.5) == bool(y) for d, _, y, _ in fresh]) > 0.93
    hits = 0
    for d, text, y, bad in fresh:
        for s in found[d]["offending"]:
            assert text[s["start"] : s["end"]] == s["text"]
        hits += bool(y) and any(s["text"].strip() == bad for s in found[d]["offending"])
    assert hits >= 0.8 * sum(y for _, _, y, _ in fresh)


def test_odd_rows_labels_and_columns(spark):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "..!\n"), (None, "Vermin all."), (4, "word " * 30000), (4, "word " * 30000), (5, "é" * 50)], "doc_id long, text string")
    wide = table.withColumns({c: F.lit(c) for c in ("label", "order", "bytes", "score", "top", "key", "offending", "n_sentences")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 7), (5, 0), (5, 0)], "doc_id long, label int")
    for t in (table, wide):
        for some in (labels, labels.where("false")):
            found = TX.locate(t, TX.fit(t, some)).collect()
            assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "4", "4", "5", "None"]
            assert all(0 <= r["score"] <= 1 for r in found) and all(r["n_sentences"] == 0 and r["score"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert TX.locate(table.where("false"), TX.fit(table.where("false"), labels)).count() == 0


def test_sample_bounds(spark):
    table = spark.createDataFrame([(d, f"word{d} again.") for d in range(50)], "doc_id long, text string")
    labels = table.selectExpr("doc_id", "cast(doc_id % 2 as int) label")
    assert TX.fit(table, labels, sample=1).weights.any() == False  # noqa: E712  one class only
    assert TX.fit(table, labels, sample_bytes=1).weights.any() == False  # noqa: E712


def test_held_out_documents(spark):
    rows = queries.op13_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert len(rows) > 700 and right > 0.97
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 8
    assert sum(r["predicted"] and r["toxic"] for r in rows) >= 0.8 * sum(r["toxic"] for r in rows)
