"""Columns of any name beside an operator's own, and rows repeated a thousand times, through every operator and stage."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import byte_bpe, fingerprints, language, licenses, lm_score, mixing, ngram_join, quality, rotated_codes, template_lines, toxicity, turn_repair, word_runs

#: What operators call columns inside.
NAMES = "key gone gone_key gone_id own mine template tokens line row first first_doc later place cell mask n a b c best rank __key __gone __dir __best __from __id __text __own __source__ label labels top order bytes part parts runs words h at seen size sizes node conv terms term id count number number_of".split()
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa la le les une der die das und".split()


def table(spark, n=24):
    rows = [(i, "\n".join(" ".join(WORDS[(i * 7 + j * 3 + k * (1 + i % 5)) % len(WORDS)] for k in range(9)) for j in range(3)), ("en", "fr")[i % 2], f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None)], "doc_id long, text string, lang string, source string").withColumn("path", F.concat(F.lit("d/"), F.col("doc_id")))


def wide(df):
    return df.select(*df.columns, *(F.lit("clash").alias(c) for c in NAMES if c not in df.columns))


BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
OPERATORS = {
    "lm_score": lambda d: lm_score.score(d),
    "byte_bpe": lambda d: byte_bpe.round_trip(d, *BPE),
    "template_lines": lambda d: template_lines.dedup(d, min_docs=3),
    "language": lambda d: language.annotate(d, language.fit(d)),
    "mixing": lambda d: mixing.mix(d, block=2),
    "licenses": lambda d: licenses.scan(d),
    "fingerprints": lambda d: fingerprints.edited_prints(d),
    "ngram_join": lambda d: ngram_join.join(d, words=4, num=85, den=100),
    "quality": lambda d: quality.scores(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("label")))),
    "word_runs": lambda d: word_runs.report(word_runs.with_tails(d)),
    "toxicity": lambda d: toxicity.locate(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("label")))),
}


def rows_of(df, columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name(spark, name):
    plain = table(spark)
    before, after = OPERATORS[name](plain), OPERATORS[name](wide(plain))
    assert rows_of(before, before.columns) == rows_of(after, before.columns)
    kept = [f"`{c}`" for c in NAMES if c in after.columns and c not in before.columns]
    assert not kept or {str(x) for r in after.select(*kept).distinct().collect() for x in r} == {"clash"}


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_columns_of_any_name(spark, stage, tmp_path):
    name, run = corpus_pipeline.STAGES[stage]
    docs = wide(table(spark).drop("path"))
    out = run(spark, docs, str(tmp_path))
    assert out.count() >= 0
    if stage < 4:
        assert out.columns == docs.columns


def test_repeated_rows_teach_once(spark):
    docs = spark.createDataFrame([(1, "one two three", "en"), (2, "un deux trois", "fr")] + [(3, "four five six", "en")] * 1000 + [(4, None, "en")] * 1000, "doc_id long, text string, lang string")
    once = docs.distinct()
    many, few = language.fit(docs, per_language=2), language.fit(once, per_language=2)
    for d in ("one five", "trois un", "six"):
        probe = spark.createDataFrame([(1, d)], "doc_id long, text string")
        assert language.predict(probe, many).collect() == language.predict(probe, few).collect()


def test_vectors_and_turns_with_columns_of_any_name(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0, float(i)]) for i in range(60)], "vec_id long, embedding array<float>")
    found = [rows_of(rotated_codes.search(v, v.where("vec_id % 10 = 0")), ("query_id", "rank", "vec_id", "score")) for v in (vectors, wide(vectors))]
    assert found[0] == found[1]
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for c in range(5) for t in range(4)], "conv_id long, turn long, role string, text string")
    found = [rows_of(turn_repair.repair(t).summary, ("conv_id", "cost", "audit")) for t in (turns, wide(turns))]
    assert found[0] == found[1]
