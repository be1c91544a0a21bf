"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import byte_bpe, fingerprints, language, licenses, lm_score, mixing, ngram_join, quality, rotated_codes, template_lines, toxicity, turn_repair, word_runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document by trigrams of all others."""
    return lm_score.score(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("score", "mean_score")})


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k rank file and decoded again."""
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose templates recur in ten documents."""
    kept = template_lines.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose fold is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_fold(4) != 2))
    return language.predict(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "n_spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mixture of sources by flattened weights."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "block_no", "slot", "in_block")


def op6_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return rotated_codes.search(vectors, vectors.where("vec_id % 100 = 0"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's."""
    return licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside that of its edited text."""
    return fingerprints.edited_prints(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by 4-word shingles at a Jaccard similarity of 85/100."""
    return ngram_join.join(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(_fold(5) != 0)
    scored = quality.scores(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.report(turn_repair.damaged(turns), turns.select("conv_id"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of words, a tenth of them with tails that repeat."""
    return word_runs.report(word_runs.with_tails(table(spark, sf_dir, "documents")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document and where its offending sentences are, learned from labels of those whose fold is not 0."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(_fold(5) != 0)
    found = toxicity.locate(docs, toxicity.fit(docs, labels))
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["score"], (-s["start"]).alias("before"), s["end"])))
    places = (F.size("offending").cast("long").alias("n_offending"), (-worst["before"]).alias("worst_start"), worst["end"].alias("worst_end"))
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", *places)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_byte_bpe, op3_template_lines, op4_language, op5_mixing, op6_rotated_codes, op7_licenses, op8_fingerprints, op9_ngram_join, op10_quality, op11_turn_repair, op12_word_runs, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_score": lm_score.ORACLE_SQL, "op3_template_lines": template_lines.ORACLE_SQL, "op6_rotated_codes": rotated_codes.ORACLE_SQL, "op7_licenses": licenses.ORACLE_SQL}
