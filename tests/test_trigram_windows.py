"""Trigrams by one expression against the windows of every word."""

import random

from pyspark.sql import functions as F

from spindrift.functions import text as T


def test_windows_are_those_of_every_word(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "a", "?", "𝒳𝒴 𝒳", "𐐨", "é _x_ 9", "ab ab abc\nab"] + ["".join(rng.choice("ab𝒳é高_ 1?\n") for _ in range(rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.trigrams(F.col("t")).alias("all"), T.trigram_set(F.col("t")).alias("set"), F.flatten(F.transform(T.tokens(F.col("t")), T.word_trigrams)).alias("want"))
    assert "lambda" not in df.select("all", "set")._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        assert r.all == r.want and r.set == (list(dict.fromkeys(r.want)) if r.want is not None else None)
