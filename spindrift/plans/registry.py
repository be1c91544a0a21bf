"""Queries by name and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import embedding, fulltext, vectors
from spindrift.functions import text as T
from spindrift.operators import blocks, cells, chunking, citations, evaluation, grounding, retrieval
from spindrift.plans import guard
from spindrift.sources import chunk_store
from spindrift.sources.shared import own_folder
from spindrift.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- vectors

#: embeddings as chunks: a label is a space.
_V = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, sqrt(list_reduce(list_prepend(0::DOUBLE, v), lambda s, x: s + x * x)) AS n FROM v),
d AS (SELECT q.vec_id AS query_id, n.vec_id, n.label, n.v, q.v AS q,
      1 - list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(n.v) + 1), lambda i: n.v[i] * q.v[i])), lambda s, x: s + x) / (n.n * q.n) AS distance
      FROM n JOIN (SELECT * FROM n WHERE vec_id % 100 = 0) q ON true)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("s%02d", "label").alias("space_key"), F.format_string("%012d", "vec_id").alias("chunk_id"), "vec_id", "label", "embedding")


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@_query(f"WITH {_V} SELECT vec_id, label, round(distance, 6) + 0 AS distance FROM d WHERE query_id = 0 ORDER BY d.distance, label, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to the first."""
    chunks = _chunks(spark, sf_dir)
    first = chunks.where("vec_id = 0").first()["embedding"]
    return retrieval.search(chunks, first, top_k=10).select("vec_id", "label", (F.round("distance", 6) + 0).alias("distance"))


@_query(f"WITH {_V} SELECT vec_id, round(distance, 6) + 0 AS distance FROM d WHERE query_id = 0 AND label = 1 ORDER BY d.distance, vec_id LIMIT 10")
def vector_space_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within one space."""
    chunks = _chunks(spark, sf_dir)
    first = chunks.where("vec_id = 0").first()["embedding"]
    return retrieval.search(chunks, first, space_key="s01", top_k=10).select("vec_id", (F.round("distance", 6) + 0).alias("distance"))


@_query(f"WITH {_V}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, label, vec_id) AS k FROM d) SELECT query_id, k::INT AS vector_rank, vec_id, round(distance, 6) + 0 AS distance FROM r WHERE k <= 20")
def vector_topk_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every hundredth vector, from the cells that can hold them."""
    chunks = _chunks(spark, sf_dir)
    found = cells.candidates(cells.build(chunks, own_folder(spark, "cells")), _asked(chunks), 20)
    return found.select("query_id", "vector_rank", F.col("chunk_id").cast("long").alias("vec_id"), (F.round("distance", 6) + 0).alias("distance"))


@_query(f"""WITH {_V},
a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, label, vec_id) AS r FROM d),
b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(v[1] - q[1]), label, vec_id) AS r FROM d),
c AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(v[2] - q[2]), label, vec_id) AS r FROM d),
f AS (SELECT query_id, vec_id, max(CASE WHEN s = 1 THEN r END) AS x, max(CASE WHEN s = 2 THEN r END) AS y, max(CASE WHEN s = 3 THEN r END) AS z FROM
      (SELECT *, 1 AS s FROM a WHERE r <= 20 UNION ALL SELECT *, 2 FROM b WHERE r <= 20 UNION ALL SELECT *, 3 FROM c WHERE r <= 20) GROUP BY query_id, vec_id)
SELECT query_id, vec_id, x::INT AS vector_rank, y::INT AS fts_rank, z::INT AS trgm_rank,
       round(coalesce(1::DOUBLE / (60 + x), 0) + coalesce(1::DOUBLE / (60 + y), 0) + coalesce(1::DOUBLE / (60 + z), 0), 9) AS rrf_score FROM f""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranked lists of every hundredth vector, fused."""
    chunks = _chunks(spark, sf_dir)
    asked = _asked(chunks)
    near = retrieval.vector_candidates(chunks, asked, 20)
    stated = retrieval._blocks(asked)  # a stated query set

    def by(i: int, rank: str) -> DataFrame:
        values = chunks.select(*retrieval.KEY, F.col("embedding")[i].cast("double").alias("x"))
        found = [retrieval._ranked(blocks.closest(values, some.select("query_id", F.col("query_embedding")[i].cast("double").alias("y")), 20), [F.col("gap").asc()], 20, rank) for some in stated]
        return functools.reduce(DataFrame.unionByName, found)

    fused = retrieval.fuse(near, by(0, "fts_rank"), by(1, "trgm_rank"))
    return fused.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), "vector_rank", "fts_rank", "trgm_rank", F.round("rrf_score", 9).alias("rrf_score"))


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores, dealt out to all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _as_chunks(docs: DataFrame) -> DataFrame:
    """documents as chunks: a language is a space."""
    docs = _spread(docs)
    return docs.select(F.col("lang").alias("space_key"), F.format_string("%012d", "doc_id").alias("chunk_id"), F.col("doc_id"), F.col("text").alias("content"))


_ASKED = [("a", "apache license version"), ("b", "alle rechte der verlag"), ("c", '"rights reserved" or mit')]


def _stored(chunks: DataFrame) -> DataFrame:
    """chunks with the lengths of their vectors, as a table: vectors are made once, however often they are read."""
    path = own_folder(chunks.sparkSession, "chunks")
    chunk_store.with_norms(chunks).write.parquet(path)
    return chunks.sparkSession.read.parquet(path)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions over all documents: hashed vectors, English full text and trigrams, fused."""
    chunks = _stored(embedding.hashed(_as_chunks(table(spark, sf_dir, "documents")), "content", dimension=64))
    asked = embedding.hashed(spark.createDataFrame(_ASKED, "query_id string, query_text string"), "query_text", "query_embedding", 64)
    hits = retrieval.hybrid(chunks, asked)
    return hits.select("query_id", "ref", "doc_id", (F.round("distance", 6) + 0).alias("distance"), F.round("rrf_score", 9).alias("rrf_score"), "vector_rank", "fts_rank", "trgm_rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)


# --- full text and trigrams

_TOKENS = r"t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"


def _question(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("q", text)], "query_id string, query_text string")


@_query(f"""WITH {_TOKENS}, s AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM t)
SELECT doc_id FROM s WHERE (list_contains(w, 'license') AND NOT list_contains(w, 'apache')) OR j LIKE '% rights reserved %'""")
def fts_simple_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one word and without another, or with a phrase."""
    chunks = _as_chunks(table(spark, sf_dir, "documents"))
    found = retrieval.fulltext_matches(chunks, _question(spark, 'license -apache or "rights reserved"'), "simple")
    return found.select(F.col("chunk_id").cast("long").alias("doc_id"))


_COVERS = """a AS (SELECT doc_id, lang, i AS e, max(CASE WHEN x = 'f' THEN i END) OVER o AS f, max(CASE WHEN x = 'g' THEN i END) OVER o AS g FROM p WHERE x IN ('f', 'g') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, lang, least(f, g) AS s, e FROM a WHERE f IS NOT NULL AND g IS NOT NULL),
c AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY e) AS before FROM b),
m AS (SELECT doc_id, any_value(lang) AS lang, sum(1::DOUBLE / (e - s + 1)) AS score FROM c WHERE before IS NULL OR before < s GROUP BY doc_id)"""


@_query(f"""WITH {_TOKENS}, w AS (SELECT doc_id, lang, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
p AS (SELECT doc_id, lang, i, CASE x WHEN 'the' THEN 'f' WHEN 'license' THEN 'g' END AS x FROM w), {_COVERS},
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, lang, doc_id) AS k FROM m)
SELECT doc_id, k::INT AS fts_rank, round(score, 9) AS text_score FROM r WHERE k <= 20""")
def fts_simple_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents with the densest covers of two words."""
    found = retrieval.fulltext_candidates(_as_chunks(table(spark, sf_dir, "documents")), _question(spark, "the license"), 20, "simple")
    return found.select(F.col("chunk_id").cast("long").alias("doc_id"), "fts_rank", "text_score")


#: The English words whose Porter stems are those of `license` and of `rights`.
_STEMS = "CASE WHEN x IN ('license', 'licenses', 'licensed', 'licensing') THEN 'f' WHEN x IN ('version', 'versions') THEN 'g' WHEN x IN ('right', 'rights', 'righted', 'righting') THEN 'h' END"


@_query(f"""WITH {_TOKENS}, w AS (SELECT doc_id, lang, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
p AS (SELECT doc_id, lang, i, {_STEMS} AS x FROM w), {_COVERS},
z AS (SELECT doc_id, lang, max(score) AS score FROM (SELECT doc_id, lang, score FROM m UNION ALL SELECT doc_id, any_value(lang), count(*)::DOUBLE FROM p WHERE x = 'h' GROUP BY doc_id) GROUP BY doc_id, lang),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, lang, doc_id) AS k FROM z)
SELECT doc_id, k::INT AS fts_rank, round(score, 9) AS text_score FROM r WHERE k <= 20""")
def fts_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for a question under the English analyzer."""
    found = retrieval.fulltext_candidates(_as_chunks(table(spark, sf_dir, "documents")), _question(spark, "licensed by the versions or rights"), 20, "english")
    return found.select(F.col("chunk_id").cast("long").alias("doc_id"), "fts_rank", "text_score")


_TRIGRAMS = r"list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@_query(f"""WITH d AS (SELECT doc_id, {_TRIGRAMS.format('text')} AS t FROM documents), b AS (SELECT item_id, {_TRIGRAMS.format('text')} AS q FROM benchmark),
s AS (SELECT doc_id, item_id, len(list_intersect(t, q)) AS n, len(t) AS x, len(q) AS y FROM d, b)
SELECT doc_id, item_id, round(n::DOUBLE / (x + y - n), 6) AS similarity FROM s WHERE n::DOUBLE / (x + y - n) >= 0.5""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items whose trigram sets are alike."""
    found = retrieval.similar_sets(*_trigram_sets(spark, sf_dir), 0.5)
    return found.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), F.round("similarity", 6).alias("similarity"))


def _trigram_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("left_id"), T.trigram_set(F.col("text")).alias("trigrams"))
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("right_id"), T.trigram_set(F.col("text")).alias("trigrams"))


@_query(f"""WITH d AS (SELECT doc_id, {_TRIGRAMS.format('text')} AS t FROM documents), b AS (SELECT item_id, {_TRIGRAMS.format('text')} AS q FROM benchmark)
SELECT item_id, count(*)::BIGINT AS candidates FROM d, b WHERE len(list_intersect(t, q)) >= 0.8 * len(q) GROUP BY item_id""")
def trigram_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold enough of an item's trigrams to be looked at."""
    found = retrieval.holding_sets(*_trigram_sets(spark, sf_dir), 0.8)
    return found.groupBy(F.col("right_id").alias("item_id")).agg(F.count("*").alias("candidates"))


def _similar_sql(asked: list[tuple[str, str]], k: int) -> str:
    """CTEs up to trgm(query_id, doc_id, trgm_rank, trgm_score): every start and end of a stretch, but ends that have too many distinct trigrams on the way."""
    values = ", ".join(f"('{i}', '{text}')" for i, text in asked)
    repeated = _TRIGRAMS.replace("list_distinct(", "(", 1)
    return f"""questions AS (SELECT * FROM (VALUES {values}) AS x(query_id, text)),
qq AS (SELECT query_id, {_TRIGRAMS.format('text')} AS q FROM questions), qx AS (SELECT query_id, len(q) AS m, unnest(q) AS x FROM qq),
tt AS (SELECT doc_id, lang, {repeated.format('text')} AS t FROM documents),
places AS (SELECT doc_id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS p FROM tt),
hit AS (SELECT query_id, m, doc_id, p, x, lag(p) OVER o AS before, lead(p) OVER o AS after FROM places JOIN qx USING (x) WINDOW o AS (PARTITION BY query_id, doc_id, x ORDER BY p)),
ends AS (SELECT a.query_id, a.doc_id, a.m, a.p AS i, b.p AS j, row_number() OVER (PARTITION BY a.query_id, a.doc_id, a.p ORDER BY b.p) AS s
  FROM hit a JOIN hit b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.p >= a.p AND coalesce(b.before, 0) < a.p AND b.p < coalesce(a.after, 1e9)),
enough AS (SELECT * FROM ends WHERE s >= 0.2 * m - 1e-9),
way AS (SELECT doc_id, i, len(list_distinct(t[i:i + 99])) AS least FROM (SELECT DISTINCT doc_id, i FROM enough) JOIN tt USING (doc_id)),
tried AS (SELECT query_id, doc_id, m, i, j, s FROM enough JOIN way USING (doc_id, i) WHERE j <= i + 99 OR s >= 0.2 * (m + least - s)),
alike AS (SELECT query_id, doc_id, any_value(lang) AS lang, max(s::DOUBLE / (m + len(list_distinct(t[i:j])) - s)) AS trgm_score FROM tried JOIN tt USING (doc_id) GROUP BY query_id, doc_id),
trgm AS (SELECT * FROM (SELECT query_id, doc_id, trgm_score, row_number() OVER (PARTITION BY query_id ORDER BY trgm_score DESC, lang, doc_id)::INT AS trgm_rank FROM alike WHERE trgm_score >= 0.2) WHERE trgm_rank <= {k})"""


_PHRASES = [("a", "Apache License"), ("b", "alle Rechte"), ("c", "creative commons by")]


@_query(f"WITH {_similar_sql(_PHRASES, 20)} SELECT query_id, doc_id, trgm_rank, round(trgm_score, 6) AS trgm_score FROM trgm")
def word_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents with the most similar stretch for each of three texts."""
    asked = spark.createDataFrame(_PHRASES, "query_id string, query_text string")
    found = retrieval.trigram_candidates(_as_chunks(table(spark, sf_dir, "documents")), asked, 20)
    return found.select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), "trgm_rank", F.round("trgm_score", 6).alias("trgm_score"))


def _stemmed(word: str) -> str:
    """The English words with the stem of a word, as a list of SQL strings: those that common endings make."""
    base, ends = fulltext.stem(word), "e s es ed ing er ers or ion ions able al ly ness ment ments ful ive ize e'd".split()
    made = {base, word, *(base + x for x in ends), *(base + x + y for x in ends for y in ends)}
    return ", ".join(f"'{w}'" for w in sorted(made) if w.isalpha() and fulltext.stem(w) == base and w not in fulltext.STOP_WORDS)


def _dense_sql(name: str, query_id: str, words: list[str]) -> str:
    """CTEs up to {name}(query_id, doc_id, lang, score): the density of covers of all words."""
    case = " ".join(f"WHEN x IN ({_stemmed(w)}) THEN {i}" for i, w in enumerate(words))
    last = ", ".join(f"max(CASE WHEN k = {i} THEN i END) OVER o AS f{i}" for i in range(len(words)))
    each = [f"f{i}" for i in range(len(words))]
    return f"""{name}p AS (SELECT doc_id, lang, i, CASE {case} END AS k FROM w),
{name}a AS (SELECT doc_id, lang, i AS e, {last} FROM {name}p WHERE k IS NOT NULL WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
{name}b AS (SELECT doc_id, lang, least({', '.join(each)}) AS s, e FROM {name}a WHERE {' AND '.join(f'{x} IS NOT NULL' for x in each)}),
{name}c AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY e) AS before FROM {name}b),
{name} AS (SELECT '{query_id}' AS query_id, doc_id, any_value(lang) AS lang, round(sum(1::DOUBLE / (e - s + 1)), 9) AS score FROM {name}c WHERE before IS NULL OR before < s GROUP BY doc_id)"""


def _hybrid_sql() -> str:
    vector = r"""buckets AS (SELECT kind, id, ('0x' || h[1:8])::BIGINT % 64 AS bucket, sum(CASE WHEN ('0x' || h[9:10])::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (
  SELECT kind, id, sha256(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS h FROM (SELECT 'd' AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'q', query_id, text FROM questions)) GROUP BY ALL),
spread AS (SELECT kind, id, list_transform(range(64), lambda i: coalesce(m[i], 0::DOUBLE)) AS v FROM (SELECT kind, id, map(list(bucket), list(x)) AS m FROM buckets GROUP BY kind, id)),
scaled AS (SELECT kind, id, list_transform(v, lambda x: x / sqrt(list_reduce(list_prepend(0::DOUBLE, v), lambda s, y: s + y * y))) AS v FROM spread),
vectors AS (SELECT kind, id, v, sqrt(list_reduce(list_prepend(0::DOUBLE, v), lambda s, y: s + y * y)) AS n FROM scaled),
far AS (SELECT q.query_id, doc_id, lang, CASE WHEN d.n > 0 AND x.n > 0 THEN 1 - list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, 65), lambda i: d.v[i] * x.v[i])), lambda s, y: s + y) / (d.n * x.n) ELSE 'nan'::DOUBLE END AS distance
  FROM documents CROSS JOIN questions q LEFT JOIN vectors d ON d.kind = 'd' AND d.id = doc_id::VARCHAR LEFT JOIN vectors x ON x.kind = 'q' AND x.id = q.query_id),
near AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, lang, doc_id)::INT AS vector_rank FROM far) WHERE vector_rank <= 20)"""
    text = f"""{_TOKENS}, w AS (SELECT doc_id, lang, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
{_dense_sql('one', 'a', ['apache', 'license', 'version'])},
{_dense_sql('two', 'b', ['alle', 'rechte', 'der', 'verlag'])},
phrase AS (SELECT r.doc_id, r.lang, count(*)::DOUBLE AS score FROM w r JOIN w s ON r.doc_id = s.doc_id AND s.i = r.i + 1 WHERE r.x IN ({_stemmed('rights')}) AND s.x IN ({_stemmed('reserved')}) GROUP BY r.doc_id, r.lang),
single AS (SELECT doc_id, lang, count(*)::DOUBLE AS score FROM w WHERE x IN ({_stemmed('mit')}) GROUP BY doc_id, lang),
three AS (SELECT 'c' AS query_id, doc_id, lang, max(score) AS score FROM (SELECT * FROM phrase UNION ALL SELECT * FROM single) GROUP BY doc_id, lang),
matched AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
fts AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lang, doc_id)::INT AS fts_rank FROM matched) WHERE fts_rank <= 20)"""
    return f"""WITH {_similar_sql(_ASKED, 20)},
{vector},
{text},
fused AS (SELECT query_id, doc_id, max(v)::INT AS vector_rank, max(f)::INT AS fts_rank, max(g)::INT AS trgm_rank FROM (SELECT query_id, doc_id, vector_rank AS v, NULL AS f, NULL AS g FROM near
  UNION ALL SELECT query_id, doc_id, NULL, fts_rank, NULL FROM fts UNION ALL SELECT query_id, doc_id, NULL, NULL, trgm_rank FROM trgm) GROUP BY query_id, doc_id),
scored AS (SELECT *, coalesce(1::DOUBLE / (60 + vector_rank), 0) + coalesce(1::DOUBLE / (60 + fts_rank), 0) + coalesce(1::DOUBLE / (60 + trgm_rank), 0) AS rrf_score FROM fused JOIN far USING (query_id, doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, distance, lang, doc_id)::INT AS ref FROM scored)
SELECT query_id, ref, doc_id, round(distance, 6) + 0 AS distance, round(rrf_score, 9) AS rrf_score, vector_rank, fts_rank, trgm_rank FROM best WHERE ref <= 5"""


_query(_hybrid_sql())(hybrid_search)


# --- lines, headings and chunks; documents have no headings or fences, so both engines put some in

_DERIVED = """x AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
  CASE WHEN (i - 1) % 13 = 12 THEN '```' WHEN (i - 1) % 5 = 0 THEN repeat('#', (((i - 1) // 5 + doc_id) % 3 + 1)::INT) || ' ' || l ELSE l END), chr(10)) AS body FROM documents),
s AS (SELECT doc_id, string_split(body, chr(10)) AS s FROM x),
l AS (SELECT doc_id, unnest(list_transform(s, lambda x: x)) AS line, unnest(range(len(s))) AS pos, len(s) AS n FROM s),
lines AS (SELECT doc_id, pos, line FROM l WHERE pos < n - 1 OR line <> ''),
fenced AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS in_fence FROM lines)"""
_HEADED = _DERIVED + """,
h AS (SELECT *, CASE WHEN NOT in_fence AND regexp_matches(line, '^#{1,6}\\s') THEN len(regexp_extract(line, '^(#{1,6})\\s', 1)) END AS level, trim(regexp_extract(line, '^#{1,6}\\s+(.*)$', 1)) AS title FROM fenced),
p AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER o AS p1, max(CASE WHEN level = 2 THEN pos END) OVER o AS p2, max(CASE WHEN level = 3 THEN pos END) OVER o AS p3,
  count(level) OVER o AS section FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
titled AS (SELECT p.doc_id, p.pos, p.line, p.in_fence, p.section, CASE WHEN p.section > 0 THEN concat_ws(' > ', a.title,
  CASE WHEN p.p2 > coalesce(p.p1, -1) THEN b.title END, CASE WHEN p.p3 > greatest(coalesce(p.p1, -1), coalesce(p.p2, -1)) THEN c.title END) END AS heading
  FROM p LEFT JOIN h a ON a.doc_id = p.doc_id AND a.pos = p.p1 LEFT JOIN h b ON b.doc_id = p.doc_id AND b.pos = p.p2 LEFT JOIN h c ON c.doc_id = p.doc_id AND c.pos = p.p3)"""


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    def put(line: Column, i: Column) -> Column:
        level = (F.floor(i / 5) + F.col("doc_id")) % 3 + 1
        return F.when(i % 13 == 12, "```").when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), line)).otherwise(line)

    docs = table(spark, sf_dir, "documents")
    body = F.array_join(F.transform(F.split("text", "\n", -1), put), "\n")
    return docs.select(F.lit("S").alias("space_key"), F.col("doc_id").cast("string").alias("source_id"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("breadcrumb"), body.alias("body"))


@_query(f"WITH {_DERIVED} SELECT doc_id, pos::INT AS pos, md5(line) AS line FROM lines")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents."""
    return chunking.lines(_derived(spark, sf_dir)).select(F.col("source_id").cast("long").alias("doc_id"), "pos", F.md5("line").alias("line"))


@_query(f"WITH {_DERIVED} SELECT doc_id, pos::INT AS pos, in_fence FROM fenced")
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines stand in fenced code."""
    return chunking.fences(chunking.lines(_derived(spark, sf_dir))).select(F.col("source_id").cast("long").alias("doc_id"), "pos", "in_fence")


@_query(f"WITH {_HEADED} SELECT doc_id, pos::INT AS pos, section::INT AS section, md5(heading) AS heading FROM titled")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of titles above every line."""
    found = chunking.headings(chunking.fences(chunking.lines(_derived(spark, sf_dir))))
    return found.select(F.col("source_id").cast("long").alias("doc_id"), "pos", "section", F.md5("heading").alias("heading"))


_SECTIONS = _HEADED + r""",
g AS (SELECT doc_id, section, any_value(heading) AS heading, list(line ORDER BY pos) AS ls FROM titled GROUP BY doc_id, section),
f AS (SELECT *, list_filter(ls, lambda x: trim(x) <> '') AS full_ls FROM g),
sections AS (SELECT doc_id, section, heading, ls FROM f WHERE len(full_ls) > 1 OR (len(full_ls) = 1 AND NOT regexp_matches(full_ls[1], '^#{1,6}\s')))"""


@_query(f"WITH {_SECTIONS} SELECT doc_id, section::INT AS section, md5(heading) AS heading, len(ls)::INT AS n_lines, md5(array_to_string(ls, chr(10))) AS content FROM sections")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections with more than a heading."""
    found = chunking.sections(_derived(spark, sf_dir))
    return found.select(F.col("source_id").cast("long").alias("doc_id"), "section", F.md5("heading").alias("heading"), F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("content"))


@_query(f"""WITH RECURSIVE {_SECTIONS},
z AS (SELECT doc_id, section, ls, len(ls) AS n, list_transform(range(len(ls) + 1), lambda k: coalesce(list_sum(list_transform(ls[1:k], lambda x: len(x) + 1)), 0)::BIGINT) AS total FROM sections),
r(doc_id, section, i, start, cut) AS (
  SELECT doc_id, section, 1::BIGINT, 1::BIGINT, NULL::BIGINT FROM z WHERE total[n + 1] > 1800
  UNION ALL
  SELECT r.doc_id, r.section, r.i + 1, CASE WHEN z.total[r.i + 2] - z.total[r.start] > 1800 THEN greatest(r.start, r.i - 1) ELSE r.start END,
         CASE WHEN z.total[r.i + 2] - z.total[r.start] > 1800 THEN r.start END
  FROM r JOIN z ON z.doc_id = r.doc_id AND z.section = r.section WHERE r.i < z.n),
e AS (SELECT doc_id, section, cut AS a, i - 1 AS b FROM r WHERE cut IS NOT NULL UNION ALL SELECT r.doc_id, r.section, start, i FROM r JOIN z ON z.doc_id = r.doc_id AND z.section = r.section WHERE r.i = z.n
      UNION ALL SELECT doc_id, section, 1, n FROM z WHERE total[n + 1] <= 1800),
c AS (SELECT e.doc_id, e.section, a, b, regexp_replace(array_to_string(z.ls[a:b], chr(10)), '^\\s+|\\s+$', '', 'g') AS content FROM e JOIN z ON z.doc_id = e.doc_id AND z.section = e.section)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section, b) - 1)::INT AS seq, md5(content) AS content, len(content)::INT AS n FROM c WHERE content <> ''""")
def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, long sections packed to pieces."""
    found = chunking.chunks(_derived(spark, sf_dir))
    return found.select(F.col("source_id").cast("long").alias("doc_id"), "seq", F.md5("content").alias("content"), F.length("content").alias("n"))


@_query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), k AS (SELECT doc_id, sha256(unnest(w)) AS h FROM t),
b AS (SELECT doc_id, (('0x' || h[1:8])::BIGINT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || h[9:10])::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM k GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS n FROM b GROUP BY doc_id)
SELECT doc_id, bucket, round(s / n, 9) AS weight FROM b JOIN n USING (doc_id) WHERE s <> 0""")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero coordinates of all documents' hashed vectors."""
    made = embedding.hashed(_spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", dimension=64)
    return made.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0").select("doc_id", "bucket", F.round("weight", 9).alias("weight"))


# --- the chunk table

_TURNS = "t AS (SELECT role AS space_key, conv_id || '#' || turn AS chunk_id, conv_id::VARCHAR AS source_id, text AS content FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("space_key"), F.concat_ws("#", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("source_id"), F.col("text").alias("content"))


@_query(f"""WITH {_TURNS}, u AS (SELECT space_key, chunk_id, source_id, content || ' v2' AS content FROM t WHERE len(content) % 3 = 0)
SELECT space_key, chunk_id, source_id, md5(content) AS content FROM u UNION ALL SELECT space_key, chunk_id, source_id, md5(content) FROM t WHERE len(content) % 3 <> 0""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with two new versions of a third of them, of which the last counts."""
    now = _turns(spark, sf_dir)
    some = now.where(F.length("content") % 3 == 0)
    new = some.crossJoin(spark.range(1, 3).select(F.col("id").alias("position"))).withColumn("content", F.concat("content", F.lit(" v"), F.col("position").cast("string")))
    key = ["space_key", "chunk_id"]
    return chunk_store.merged(now, chunk_store.latest(new, key), key).withColumn("content", F.md5("content"))


@_query(f"""WITH {_TURNS} SELECT space_key, chunk_id, source_id, md5(content) AS content FROM t WHERE NOT (space_key = 'user' AND source_id = '3')
UNION ALL SELECT space_key, chunk_id, source_id, md5(upper(content)) FROM t WHERE space_key = 'user' AND source_id = '3' AND chunk_id NOT LIKE '%#0'""")
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conversation's turns replaced in one space."""
    now = _turns(spark, sf_dir)
    new = now.where("space_key = 'user' and source_id = '3' and chunk_id not like '%#0'").withColumn("content", F.upper("content"))
    out = chunk_store.merged(chunk_store.without_source(now, "user", "3"), new, ["space_key", "chunk_id"])
    return out.withColumn("content", F.md5("content"))


@_query(f"WITH {_TURNS} SELECT space_key, chunk_id FROM t WHERE NOT (space_key = 'user' AND source_id = '3')")
def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conversation gone from one space."""
    return chunk_store.without_source(_turns(spark, sf_dir), "user", "3").select("space_key", "chunk_id")


# --- grounding: markers are put at the end of conversations' lines, evidence is the first turns

_DRAFTS = """d AS (SELECT conv_id * 100 + turn AS answer_id, string_split(text, chr(10)) AS ls FROM conversations),
l AS (SELECT answer_id, unnest(ls) AS line0, unnest(range(len(ls))) AS pos FROM d),
m AS (SELECT answer_id, pos, CASE WHEN pos % 3 = 2 THEN line0 ELSE line0 || ' [' || (pos % 7) || '], [' || (pos % 2) || '].' END AS line FROM l),
ev AS (SELECT conv_id * 100 + turn AS answer_id, unnest([0, 1, 2]) AS ref, text FROM conversations)"""
_BOUND = _DRAFTS + r""",
f AS (SELECT *, trim(line) = '' AS blank, list_transform(regexp_extract_all(line, '\[(\d+)\]', 1), lambda x: x::INT) AS refs FROM m),
b AS (SELECT answer_id, pos, line, blank OR len(list_filter(refs, lambda x: x <= 2)) > 0 AS kept, list_filter(refs, lambda x: x <= 2) AS refs,
  CASE WHEN blank OR len(list_filter(refs, lambda x: x <= 2)) = 0 THEN line ELSE regexp_replace(regexp_replace(trim(regexp_replace(line, '\[\d+\]([ \t]*,[ \t]*\[\d+\]|\[\d+\])*', '', 'g')), '[ \t]{2,}', ' ', 'g'), '[ \t]+([.,!?])', '\1', 'g') END AS text FROM f)"""


def _drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "text")

    def mark(line: Column, i: Column) -> Column:
        return F.when(i % 3 == 2, line).otherwise(F.concat(line, F.lit(" ["), (i % 7).cast("string"), F.lit("], ["), (i % 2).cast("string"), F.lit("].")))

    drafts = turns.select("answer_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))
    known = turns.select("answer_id", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("ref"), F.col("text").alias("content"))
    return drafts, known.select("answer_id", "ref", F.concat(F.lit("s"), "ref").alias("source_id"), F.lit("T").alias("title"), F.lit("").alias("heading"), F.lit(None).cast("string").alias("breadcrumb"), "content")


@_query(f"WITH {_BOUND} SELECT answer_id, pos::INT AS pos, kept, md5(text) AS text FROM b")
def bind_claims_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of all drafts stay, and how they read then."""
    return grounding.bind_lines(*_drafts(spark, sf_dir)).select("answer_id", "pos", "kept", F.md5("text").alias("text"))


@_query(f"WITH {_BOUND} SELECT answer_id, pos::INT AS pos, md5(text) AS text FROM b WHERE kept")
def marker_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept lines without markers."""
    return grounding.bind_lines(*_drafts(spark, sf_dir)).where("kept").select("answer_id", "pos", F.md5("text").alias("text"))


@_query(f"""WITH {_BOUND}, r AS (SELECT answer_id, pos, unnest(refs) AS ref, unnest(range(len(refs))) AS i FROM b),
o AS (SELECT answer_id, ref, min(pos * 1000 + i) AS place FROM r GROUP BY answer_id, ref)
SELECT o.answer_id, row_number() OVER (PARTITION BY o.answer_id ORDER BY place)::INT AS n, 's' || o.ref AS source_id, md5(nullif(substr(ev.text, 1, 200), '')) AS snippet
FROM o JOIN ev ON ev.answer_id = o.answer_id AND ev.ref = o.ref""")
def citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cited evidence once, in the order of first markers."""
    drafts, known = _drafts(spark, sf_dir)
    found = grounding.document_citations(grounding.bind_lines(drafts, known), known)
    return found.select("answer_id", "n", "citation.source_id", F.md5("citation.snippet").alias("snippet"))


@_query("""SELECT conv_id AS answer_id, (turn % 2)::INT AS ref, arg_max(md5(text), turn) AS content FROM conversations GROUP BY conv_id, turn % 2""")
def evidence_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of references that came again, the last."""
    turns = table(spark, sf_dir, "conversations")
    calls = turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("call_no"), F.lit(0).alias("item_no"), (F.col("turn") % 2).cast("int").alias("ref"), F.md5("text").alias("content"))
    return grounding.collect_evidence(calls)


@_query("""SELECT conv_id AS answer_id, turn::INT AS call_no, CASE WHEN turn % 2 = 0 THEN 'p.d.t' || turn ELSE 'unknown.unknown.unknown' END AS source_id, len(text) || ' rows returned' AS snippet,
CASE WHEN conv_id % 5 = 0 THEN 'a bigquery citation needs its SQL' END AS error FROM conversations""")
def sql_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of queries, and whether they are valid."""
    turns = table(spark, sf_dir, "conversations")
    tables = F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("p.d.t"), F.col("turn").cast("string")), F.lit("p.d.other"))).otherwise(F.array().cast("array<string>"))
    calls = turns.select(F.col("conv_id").alias("answer_id"), F.col("turn").cast("int").alias("call_no"), F.when(F.col("conv_id") % 5 != 0, "select 1").alias("sql"), tables.alias("referenced_tables"), F.length("text").alias("row_count_returned"))
    cited = calls.withColumn("c", grounding.sql_citation())
    return cited.select("answer_id", "call_no", "c.source_id", "c.snippet", citations.citation_error(F.col("c")).alias("error"))


@_query(f"""WITH {_BOUND}, a AS (SELECT answer_id, regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE kept), ''), '^\\s+|\\s+$', '', 'g') AS answer, max(len(refs)) > 0 AS cited, count(*) FILTER (WHERE NOT kept) AS dropped FROM b GROUP BY answer_id)
SELECT answer_id, CASE WHEN cited AND answer <> '' THEN 'grounded' ELSE 'refused' END AS status, CASE WHEN cited AND answer <> '' THEN md5(answer) END AS answer, dropped::INT AS dropped FROM a""")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All drafts as answers, or refused."""
    found = grounding.ground(*_drafts(spark, sf_dir))
    return found.select("answer_id", "status", F.md5("answer").alias("answer"), F.size("dropped").alias("dropped"))


@_query("""WITH a AS (SELECT doc_id, (contains(lower(text), 'license') OR contains(lower(text), 'reserved'))::INT + contains(lower(text), 'the ')::INT + contains(lower(text), 'öß')::INT AS hits, source FROM documents)
SELECT doc_id, round(hits / 3::DOUBLE, 9) AS keyword_hit, source IN ('src0', 'src1') AS source_hit, CASE WHEN source IN ('src0', 'src1') AND hits > 0 THEN 'PASS' ELSE 'MISS' END AS status FROM a""")
def keyword_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers against groups of keywords and an expected source."""
    docs = table(spark, sf_dir, "documents")
    groups = F.array(F.array(F.lit("LICENSE"), F.lit("Reserved")), F.array(F.lit("the ")), F.array(F.lit("öß")))
    golden = docs.select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src1", "src1").otherwise("src0").alias("expected_source_id"), groups.alias("expected_keywords"))
    answers = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.array("source").alias("cited_source_ids"))
    return evaluation.evaluate(golden, answers).select(F.col("id").alias("doc_id"), F.round("keyword_hit", 9).alias("keyword_hit"), "source_hit", "status")


@_query("""WITH a AS (SELECT (contains(lower(d.text), 'the '))::INT::DOUBLE AS k, l.quality = 1 AS s FROM labels l LEFT JOIN documents d USING (doc_id))
SELECT count(*)::BIGINT AS items, round(avg(k), 9) AS keyword_hit, count(*) FILTER (WHERE s)::BIGINT AS source_hits, count(*) FILTER (WHERE s) = count(*) AS passed FROM a""")
def source_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of an evaluation of all labelled documents."""
    labels = table(spark, sf_dir, "labels")
    golden = labels.select(F.col("doc_id").alias("id"), F.lit("1").alias("expected_source_id"), F.array(F.array(F.lit("the "))).alias("expected_keywords"))
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("answer")).join(labels.select(F.col("doc_id").alias("id"), F.array(F.col("quality").cast("string")).alias("cited_source_ids")), "id")
    out = evaluation.summary(evaluation.evaluate(golden, answers))
    return out.withColumn("keyword_hit", F.round("keyword_hit", 9))


# --- guarded SQL: the same statement in both engines, with a total order under the row cap

_GUARDED = {
    "guarded_sql_agg": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS low, max(l_tax) AS high
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus LIMIT 50""",
    "guarded_sql_join": """SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name ORDER BY n_name LIMIT 50""",
    "guarded_sql_outer_join": """SELECT c_mktsegment, count(*) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'
        GROUP BY c_mktsegment ORDER BY c_mktsegment LIMIT 50""",
    "guarded_sql_semi_anti": """SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment ORDER BY c_mktsegment LIMIT 50""",
    "guarded_sql_in_subquery": """SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY p_brand ORDER BY p_brand LIMIT 50""",
    "guarded_sql_correlated": """SELECT o_orderpriority, count(*) AS n FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)
        GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 50""",
    "guarded_sql_window": """SELECT o_custkey, o_orderkey, r, prev, running FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r,
        lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS prev,
        round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders) x
        WHERE r <= 3 ORDER BY o_custkey, r LIMIT 50""",
    "guarded_sql_rank": """SELECT s_nationkey, s_suppkey, rk, dr, nt, round(pr, 6) AS pr, round(cd, 6) AS cd FROM (SELECT s_nationkey, s_suppkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(3) OVER w AS BIGINT) AS nt,
        percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)) x ORDER BY s_nationkey, s_suppkey LIMIT 50""",
    "guarded_sql_setop": """SELECT k FROM ((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) x
        WHERE k IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) ORDER BY k LIMIT 50""",
    "guarded_sql_rollup": """SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus) ORDER BY flag, status, g LIMIT 50""",
    "guarded_sql_cube": """SELECT coalesce(o_orderstatus, '-') AS status, coalesce(o_orderpriority, '-') AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders
        GROUP BY CUBE (o_orderstatus, o_orderpriority) ORDER BY status, priority LIMIT 50""",
    "guarded_sql_grouping_sets": """SELECT coalesce(p_brand, '-') AS brand, coalesce(p_size, -1) AS size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ()) ORDER BY brand, size LIMIT 50""",
    "guarded_sql_cte": """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000), named AS (SELECT c_name, t FROM big JOIN customer ON c_custkey = o_custkey)
        SELECT c_name, round(t, 2) AS total FROM named ORDER BY total DESC, c_name LIMIT 50""",
    "guarded_sql_range_join": """SELECT a.event_type, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR GROUP BY a.event_type ORDER BY a.event_type LIMIT 50""",
    "guarded_sql_asof": """SELECT event_id, last_id FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id FROM events) x
        ORDER BY event_id LIMIT 50""",
    "guarded_sql_scalars": """SELECT c_custkey, upper(substring(c_name, 1, 4)) AS head, CAST(length(c_name) AS BIGINT) AS n, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'some' ELSE 'rich' END AS class,
        round(abs(c_acctbal), 1) AS a, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, c_name LIKE '%1' AS ends FROM customer WHERE c_nationkey IN (1, 2, 3) ORDER BY c_custkey LIMIT 50""",
    "guarded_sql_dates": """SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY extract(YEAR FROM o_orderdate), extract(MONTH FROM o_orderdate) ORDER BY y, m LIMIT 50""",
    "guarded_sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
}
#: Families whose wording differs between the engines: Spark's and DuckDB's.
_GUARDED_TWICE = {
    "guarded_sql_pivot": ("""SELECT * FROM (SELECT o_orderpriority AS priority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p)) ORDER BY priority LIMIT 50""",
        """SELECT o_orderpriority AS priority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p
        FROM orders GROUP BY o_orderpriority ORDER BY priority LIMIT 50"""),
    "guarded_sql_unpivot": ("""SELECT n_nationkey, what, value FROM (SELECT n_nationkey, n_regionkey AS region, n_nationkey * 2 AS double FROM nation) UNPIVOT (value FOR what IN (region, double)) ORDER BY n_nationkey, what LIMIT 50""",
        """SELECT n_nationkey, what, value FROM (SELECT n_nationkey, 'region' AS what, n_regionkey AS value FROM nation UNION ALL SELECT n_nationkey, 'double', n_nationkey * 2 FROM nation) ORDER BY n_nationkey, what LIMIT 50"""),
    "guarded_sql_arrays": ("""SELECT c_nationkey, CAST(size(s) AS BIGINT) AS kinds, array_join(s, ',') AS names, array_contains(s, 'BUILDING') AS builds, element_at(s, 1) AS first FROM (SELECT c_nationkey, array_sort(collect_set(c_mktsegment)) AS s FROM customer GROUP BY c_nationkey) x ORDER BY c_nationkey LIMIT 50""",
        """SELECT c_nationkey, len(s) AS kinds, array_to_string(s, ',') AS names, list_contains(s, 'BUILDING') AS builds, s[1] AS first FROM (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer GROUP BY c_nationkey) x ORDER BY c_nationkey LIMIT 50"""),
    "guarded_sql_lambdas": ("""SELECT r_regionkey, array_join(transform(filter(split(r_name, ''), x -> x <> 'A'), x -> lower(x)), '') AS rest, aggregate(sequence(1, CAST(r_regionkey AS INT) + 2), CAST(0 AS BIGINT), (s, x) -> s + x) AS total FROM region ORDER BY r_regionkey LIMIT 50""",
        """SELECT r_regionkey, lower(replace(r_name, 'A', '')) AS rest, list_sum(range(1, r_regionkey::INT + 3))::BIGINT AS total FROM region ORDER BY r_regionkey LIMIT 50"""),
    "guarded_sql_maps": ("""SELECT n_nationkey, m['name'] AS name, array_join(array_sort(map_keys(m)), ',') AS keys, s.k AS k FROM (SELECT n_nationkey, map('name', n_name, 'region', CAST(n_regionkey AS STRING)) AS m, named_struct('k', n_regionkey + 1) AS s FROM nation) x ORDER BY n_nationkey LIMIT 50""",
        """SELECT n_nationkey, n_name AS name, 'name,region' AS keys, n_regionkey + 1 AS k FROM nation ORDER BY n_nationkey LIMIT 50"""),
    "guarded_sql_json": ("""SELECT s_suppkey, get_json_object(j, '$.name') AS name, from_json(j, 'key BIGINT').key AS k FROM (SELECT s_suppkey, to_json(named_struct('key', s_nationkey, 'name', s_name)) AS j FROM supplier) x ORDER BY s_suppkey LIMIT 50""",
        """SELECT s_suppkey, s_name AS name, s_nationkey::BIGINT AS k FROM supplier ORDER BY s_suppkey LIMIT 50"""),
    "guarded_sql_approx": ("""SELECT o_orderstatus, abs(approx_count_distinct(o_custkey, 0.01) - count(DISTINCT o_custkey)) <= 0.05 * count(DISTINCT o_custkey) + 1 AS near, abs(approx_percentile(o_totalprice, 0.5, 10000) - median(o_totalprice)) <= 0.02 * median(o_totalprice) AS middle FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 50""",
        """SELECT o_orderstatus, true AS near, true AS middle FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 50"""),
    "guarded_sql_recursive": ("""WITH RECURSIVE steps(n, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total * 2 FROM steps WHERE n < 20) SELECT n, total, n_name FROM steps JOIN nation ON n_nationkey = n ORDER BY n LIMIT 50""",
        """WITH RECURSIVE steps(n, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total * 2 FROM steps WHERE n < 20) SELECT n, total, n_name FROM steps JOIN nation ON n_nationkey = n ORDER BY n LIMIT 50"""),
}
_GUARDED |= {
    "guarded_sql_theta_join": """SELECT n_nationkey, count(*) AS n, min(s_suppkey) AS first FROM nation JOIN supplier ON s_acctbal > n_nationkey * 350 AND s_nationkey <> n_nationkey GROUP BY n_nationkey ORDER BY n_nationkey LIMIT 50""",
    "guarded_sql_window_values": """SELECT o_custkey, o_orderkey, later, first, last, second FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey, 2) OVER w AS later, first_value(o_orderkey) OVER w AS first,
        last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last, nth_value(o_orderkey, 2) OVER w AS second
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) x ORDER BY o_custkey, o_orderkey LIMIT 50""",
    "guarded_sql_range_frame": """SELECT o_custkey, o_orderkey, near, days FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING) AS near,
        count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW) AS days FROM orders) x ORDER BY o_custkey, o_orderkey LIMIT 50""",
    "guarded_sql_setop_all": """SELECT k, count(*) AS n FROM ((SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)) x
        GROUP BY k ORDER BY k LIMIT 50""",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def keys_apart(group: str, key: str) -> Callable[[DataFrame], DataFrame]:
    """A layout for statements that group by `group` and count distinct keys beside sketches of other columns.

    Spark groups such a statement by group and key, with every sketch in each of these groups, and then merges them one by one;
    a merge of percentiles copies all that was merged before. So the rows come without keys, and each key of a group comes
    once more without anything else: a key's sketches of values are empty. This is the same only for aggregates that skip nulls
    (count(DISTINCT), approx_count_distinct, approx_percentile, median, min, max, avg and sum of columns), not for count(*).
    """

    def layout(rows: DataFrame) -> DataFrame:
        values = rows.withColumn(key, F.lit(None).cast(rows.schema[key].dataType))
        keys = rows.where(F.col(key).isNotNull()).select(group, key).distinct()
        return values.unionByName(keys, allowMissingColumns=True)

    return layout


#: How a statement's tables are laid out, and its session's settings. Sorted groups share one buffer of 1,639 columns, hashed ones each
#: make their own; shuffled sketches are 65 times as large in memory as on disk, so tasks are made smaller.
_LAYOUTS = {"guarded_sql_approx": {"orders": keys_apart("o_orderstatus", "o_custkey")}}
_SETTINGS = {"guarded_sql_approx": {"spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}}


def _guarded(name: str, sql: str, other: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return guard.checked(spark, sql, {t: f"{sf_dir}/{t}.parquet" for t in _TABLES}, layouts=_LAYOUTS.get(name), settings=_SETTINGS.get(name))

    run.__name__ = name
    _query(other or sql)(run)


for _name, _statement in _GUARDED.items():
    _guarded(_name, _statement)
for _name, (_statement, _other) in _GUARDED_TWICE.items():
    _guarded(_name, _statement, _other)


@_query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, coalesce(nullif(o_orderstatus, 'O'), 'None') AS open, 50::BIGINT AS row_count, true AS sized FROM orders ORDER BY orders.o_orderkey LIMIT 50")
def guarded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's evidence under the guard's own caps: the first fifty rows, as strings."""
    name = f"orders_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE default.{name} USING parquet LOCATION '{sf_dir}/orders.parquet'")
    try:
        found = guard.run(spark, f"SELECT o_orderkey, o_orderstatus, nullif(o_orderstatus, 'O') AS open FROM default.{name} ORDER BY o_orderkey")
    finally:
        spark.sql(f"DROP TABLE default.{name}")
    rows = [(r["o_orderkey"], r["o_orderstatus"], r["open"], found["row_count_returned"], found["estimated_bytes"] > 0) for r in found["rows"]]
    return spark.createDataFrame(rows, "o_orderkey string, o_orderstatus string, open string, row_count long, sized boolean")


#: Statements about a customer (its key is {0}, its name {1}), one for each remainder of the key, and the rule that refuses it, or null.
_STATEMENTS = [
    ("select c_name from customer where c_custkey = {0}", None), ("  -- {1}; delete\n WITH x AS (SELECT {0}) SELECT * FROM x ;", None), ("SELECT dropped, created_on FROM t WHERE name = '{1}'", None),
    ("EXPLAIN SELECT {0}", "SELECT"), ("-- {1}", "SELECT"), ("SELECT {0}; SELECT '{1}'", "multiple"), ("SELECT ';{1}'", "multiple"), ("WITH x AS (SELECT {0}) DELETE FROM t", "read-only"), ("SELECT 'Grant {1}'", "read-only"),
]


@_query(f"SELECT c_custkey, CASE c_custkey % {len(_STATEMENTS)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(_STATEMENTS) if w) + " END AS reason FROM customer")
def guard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule of the guard's refuses a statement about each customer."""

    @F.pandas_udf("string")
    def refused(statements: pd.Series) -> pd.Series:
        said = statements.map(guard.static_error)
        return said.map(lambda x: next((w for w in ("SELECT", "multiple", "read-only") if x and w in x), None))

    forms = F.element_at(F.lit([x for x, _ in _STATEMENTS]), (F.col("c_custkey") % len(_STATEMENTS) + 1).cast("int"))
    statement = F.replace(F.replace(forms, F.lit("{0}"), F.col("c_custkey").cast("string")), F.lit("{1}"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", refused(statement).alias("reason"))


_HOURS = "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"


@_query(_HOURS)
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tumbling window over events as a table."""
    hours = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return hours.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@_query(_HOURS)
def events_by_hour_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over events as a stream, with a watermark that all of them meet."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = own_folder(spark, "events")
    windows.keep_latest(windows.totals(stream.withColumn("ts", F.col("ts").cast("timestamp")), late="3650 days"), f"{at}/out", f"{at}/log").awaitTermination()
    found = windows.latest(spark.read.parquet(f"{at}/out"))
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 6).alias("total"))


@_query("WITH v AS (SELECT vec_id, sqrt(list_reduce(list_prepend(0::DOUBLE, embedding::DOUBLE[]), lambda s, x: s + x * x)) AS n FROM embeddings) SELECT vec_id, round(n, 9) AS norm FROM v")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(vectors.doubles(F.col("embedding"))), 9).alias("norm"))
