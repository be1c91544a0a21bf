"""Rules for citations and cited answers, as error columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of citations, and a fully qualified table name.
KINDS = ("document", "bigquery", "report")
TABLE_NAME = r"(?U)^[\w-]+\.[\w$]+\.[\w$]+$"


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def citation_error(c: Column) -> Column:
    """Null for a valid citation struct, else what is wrong with it."""
    return (
        F.when(c.isNull(), "a citation is missing")
        .when(c["kind"].isNull() | ~c["kind"].isin(*KINDS), "kind must be one of " + ", ".join(KINDS))
        .when(_empty(c["source_id"]), "source_id must not be empty")
        .when((c["kind"] == "bigquery") & _empty(c["sql"]), "a bigquery citation needs its SQL")
        .when((c["kind"] == "bigquery") & ~c["source_id"].rlike(TABLE_NAME), "a bigquery citation needs a fully-qualified table")
        .when((c["kind"] == "document") & _empty(c["heading"]) & _empty(c["snippet"]), "a document citation needs heading or snippet")
    )


def answer_error(answer: Column, citations: Column) -> Column:
    """Null for an answer with text and one valid citation or more."""
    errors = F.filter(F.transform(citations, citation_error), lambda e: e.isNotNull())
    return F.when(_empty(answer), "an answer must not be empty").when(F.coalesce(F.size(citations), F.lit(0)) < 1, "an answer needs a citation").otherwise(F.try_element_at(errors, F.lit(1)))
