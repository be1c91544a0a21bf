"""Golden sets in YAML."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id string, question string, expected_source_id string, expected_keywords array<array<string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The items of a YAML file; a keyword that stands alone is a group of one."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    return from_text(spark, row[0])


def from_text(spark: SparkSession, text: str) -> DataFrame:
    items = yaml.safe_load(text)["items"]
    rows = [(i["id"], i["question"], i["expected_source_id"], [[str(a) for a in k] if isinstance(k, list) else [str(k)] for k in i.get("expected_keywords") or []]) for i in items]
    return spark.createDataFrame(rows, SCHEMA)
