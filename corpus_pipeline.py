"""A corpus from raw documents to tokens: five stages, each over all rows that the one before it kept.

run() applies them to the table documents, with a Parquet table in the cluster's shared folder after each
stage but the last. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import byte_bpe, language, mixing, ngram_join, template_lines
from spindrift.llm._shared import saved

#: The least share of a text's letters in its language, and what near-duplicates are.
LEAST_SHARE, WORDS, SIMILAR = 0.4, 5, (80, 100)


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where documents have it, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else docs.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without letters or without a main language go.

    Null and empty texts have no letters and go. A tie goes to the first language by name; a table without any lang
    teaches none, so all rows go. Repeated rows and null doc_ids fare by their texts. No rows give no rows.
    """
    found = language.annotate(docs, language.fit(docs)).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that recur in ten documents out of texts; all rows stay, if only with an empty text.

    Long lines have no lower limit here: that would empty the copies that the next stage has to recognise.

    A template stays in the rows with the smallest doc_id that have it, at its first line there; rows alike in doc_id and
    text fare alike, null texts stay null. No rows give no rows.
    """
    return _measured(template_lines.dedup(docs, few_docs=template_lines.MIN_DOCS), docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest doc_id stays.

    Rows without words all stay. Rows are told apart by doc_id and text, so one that only shares a doc_id with a
    copy stays; of repeated rows one stays. No rows give no rows.
    """
    return ngram_join.representatives(docs, WORDS, *SIMILAR).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixture of their sources.

    A null source is a source of its own; ties in the order of a source go by doc_id, then text; repeated rows
    follow each other. No rows give no rows.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its tokens' number and digests, encoded and decoded again; slot and in_block, its place in the mixture.

    A table that is read again may come in any order; the places follow from its rows, as in the stage before.
    Null and empty texts have no tokens, null doc_ids stay, repeated rows come repeatedly. No rows give no rows.
    """
    import public_tokenizers

    return byte_bpe.round_trip(mixing.mix(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("slot", "in_block"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Language models, links and merges are beyond SQL; tests/llm hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
