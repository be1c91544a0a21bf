"""The engine's measures as SQL functions of a session.

They are SQL functions that the optimizer writes out in place, but for word_similarity, which takes Arrow
batches. The guard admits built-in functions only, so guarded statements can't call them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrift.functions import embedding

_VECTORS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_TRIGRAMS = "array_distinct(flatten(transform(regexp_extract_all(lower({0}), '([\\\\p{{L}}\\\\p{{N}}_]+)', 1), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"

#: Name, parameters, result and body.
FUNCTIONS = [
    ("vector_norm", "a ARRAY<DOUBLE>", "DOUBLE", f"sqrt({_DOT.format('a', 'a')})"),
    ("cosine_distance", _VECTORS, "DOUBLE", f"CASE WHEN {_DOT.format('a', 'a')} > 0 AND {_DOT.format('b', 'b')} > 0 THEN 1 - {_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})) ELSE double('NaN') END"),
    ("trigram_set", "t STRING", "ARRAY<STRING>", _TRIGRAMS.format("t")),
    ("trigram_similarity", "t STRING, u STRING", "DOUBLE", "coalesce(try_divide(size(array_intersect({0}, {1})), size(array_union({0}, {1}))), 0D)".format(_TRIGRAMS.format("t"), _TRIGRAMS.format("u"))),
    ("rrf", "k INT, r ARRAY<INT>", "DOUBLE", "aggregate(r, 0D, (s, x) -> s + coalesce(1D / (k + x), 0D))"),
]


def _extent(q: list[str], t: list[str]) -> float:
    """The largest similarity of a query's trigrams to the trigrams of any stretch of a text's.

    A best stretch starts and ends with a trigram of the query, and ends at its first new one.
    """
    wanted = set(q)
    at = [i for i, x in enumerate(t) if x in wanted]
    best = 0.0
    for n, i in enumerate(at):
        if len(at) - n < best * len(wanted):
            break
        seen: set[str] = set()
        shared = 0
        last = i
        for j in at[n:]:
            if t[j] in seen:
                continue
            seen.update(t[last : j + 1])
            last = j
            shared += 1
            best = max(best, shared / (len(wanted) + len(seen) - shared))
            if shared == len(wanted):
                break
            if len(wanted) <= best * len(seen):  # longer stretches can't be better
                break
    return best


def stretch_similarity(query: str, content: str) -> float:
    """retrieval.word_similarity() of two strings, for SQL, which has no way to say it."""
    q, t = ([f"  {w} "[i : i + 3] for w in re.findall(r"\w+", text.lower()) for i in range(len(w) + 1)] for text in (query, content))
    return _extent(list(dict.fromkeys(q)), t) if q else 0.0


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session for its life, and returns their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    @F.pandas_udf("double")
    def word_similarity(query: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([stretch_similarity(q or "", c or "") for q, c in zip(query, content)], dtype=float)

    @F.pandas_udf("array<double>")
    def hashed_embedding(texts: pd.Series, dimension: pd.Series) -> pd.Series:
        return pd.Series([embedding.hashed_vector(t or "", int(d)) for t, d in zip(texts, dimension)])

    spark.udf.register("word_similarity", word_similarity)
    spark.udf.register("hashed_embedding", hashed_embedding)
    return [f[0] for f in FUNCTIONS] + ["word_similarity", "hashed_embedding"]
