"""Markdown documents with a YAML header as a DataFrame source."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "source_id string, title string, space_key string, body string, breadcrumb string, error string"


def read(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """The documents of folder/*.md, one for each file; a file's name without its ending stands in for a missing source_id."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return parse(files.select(stem().alias("fallback"), F.col("value").alias("text")), strict)


def stem() -> Column:
    """A file's name without its ending, from its metadata, which gives it as in a URL."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def parse(files: DataFrame, strict: bool = False) -> DataFrame:
    """The documents in files(text, fallback): source_id, title, space_key, body, breadcrumb, error.

    A header starts the text with `---` and ends at the next line that starts so; it is a YAML mapping with
    title, space_key and, where there is no fallback, source_id. A text that breaks this has an error and
    nulls for the rest; with strict, it fails the job. Only the header goes through Python.
    """
    text = F.regexp_replace(F.col("text"), r"(?U)^[\s\x1c-\x1f]+", "")
    rest = F.substring(text, F.lit(4), F.length(text))
    at = F.locate("\n---", rest)
    parts = files.select(
        "fallback",
        text.startswith("---").alias("opened"),
        at.alias("at"),
        F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).alias("header"),
        F.when(at > 0, F.substring(rest, at + 4, F.length(rest))).alias("body"),
    )

    @F.pandas_udf("source_id string, title string, space_key string, breadcrumb string, error string")
    def fields(headers: pd.Series, fallbacks: pd.Series) -> pd.DataFrame:
        rows = []
        for header, fallback in zip(headers, fallbacks):
            try:
                found = yaml.safe_load(header) or {} if isinstance(header, str) else {}
            except yaml.YAMLError as problem:
                rows.append((None, None, None, None, f"frontmatter is not YAML: {problem}"))
                continue
            if not isinstance(found, dict):
                rows.append((None, None, None, None, "frontmatter must be a YAML mapping"))
                continue
            value = {k: str(found[k]).strip() if found.get(k) else "" for k in ("source_id", "title", "space_key", "breadcrumb")}
            value["source_id"] = value["source_id"] if found.get("source_id") else (fallback or "").strip()
            missing = [k for k in ("source_id", "title", "space_key") if not value[k]]
            if missing:
                rows.append((None, None, None, None, f"the header lacks {', '.join(missing)}"))
            else:
                rows.append((value["source_id"], value["title"], value["space_key"], value["breadcrumb"] if found.get("breadcrumb") else None, None))
        return pd.DataFrame(rows, columns=["source_id", "title", "space_key", "breadcrumb", "error"])

    found = parts.withColumn("f", fields("header", "fallback"))
    error = F.when(~F.col("opened"), "a header between two lines of --- is missing").when(F.col("at") == 0, "the header is unterminated: no second line of ---").otherwise(F.col("f.error"))
    body = F.when(error.isNull(), F.regexp_replace("body", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    good = {k: F.when(error.isNull(), F.col(f"f.{k}")).alias(k) for k in ("source_id", "title", "space_key", "breadcrumb")}
    out = found.select(good["source_id"], good["title"], good["space_key"], body.alias("body"), good["breadcrumb"], error.alias("error"))
    if strict:
        out = out.withColumn("source_id", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("source_id")))
    return out
