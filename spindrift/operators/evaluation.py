"""Scores of answers against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_hit(answer: Column, expected: Column) -> Column:
    """The share of groups of which an answer holds any alias, whatever the case; 0 without groups."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    hits = F.size(F.filter(expected, lambda group: F.exists(group, lambda alias: F.contains(low, F.lower(alias)))))
    n = F.coalesce(F.size(expected), F.lit(0))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def source_hit(cited: Column, expected: Column) -> Column:
    return F.coalesce(F.array_contains(cited, expected), F.lit(False))


def evaluate(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """id, keyword_hit, source_hit, status of golden(id, expected_source_id, expected_keywords) against answers(id, answer, cited_source_ids).

    PASS is a cited expected source and some keyword; anything else, an unanswered item too, is a MISS.
    """
    joined = golden.join(answers, "id", "left")
    scored = joined.select("id", keyword_hit(F.col("answer"), F.col("expected_keywords")).alias("keyword_hit"), source_hit(F.col("cited_source_ids"), F.col("expected_source_id")).alias("source_hit"))
    return scored.withColumn("status", F.when(F.col("source_hit") & (F.col("keyword_hit") > 0), "PASS").otherwise("MISS"))


def summary(evaluated: DataFrame) -> DataFrame:
    """items, keyword_hit (mean), source_hits, passed (every source was hit)."""
    return evaluated.agg(
        F.count("*").alias("items"), F.avg("keyword_hit").alias("keyword_hit"), F.count_if("source_hit").alias("source_hits"),
        (F.count_if("source_hit") == F.count("*")).alias("passed"),
    )
