"""Vector, full-text and trigram retrieval, and their fusion by reciprocal ranks.

Every operator takes a DataFrame of queries; a single question is one row. Candidates are cut to
candidate_k for each query and signal by window limits, before anything else is joined; content is not
carried along but joined back to what is left.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import fulltext as FT
from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.operators import blocks, postings

# The search's defaults.
TOP_K, CANDIDATE_K, RRF_K, TRGM_THRESHOLD = 5, 20, 60, 0.2

#: The most queries that go to every task as one table; more are searched in blocks.
MOST_QUERIES = 10_000
#: The most short rows (terms, trigrams, candidates) that go to every task as one table; more are joined by shuffles.
MOST_SENT = 1_000_000
#: The most trigrams of queries that texts are searched for one by one; for more, all trigrams of the texts are listed.
MOST_LISTED = 2000
KEY = ["space_key", "chunk_id"]


class Index(NamedTuple):
    """Inverted tables of segments of chunks, sorted by bucket(): terms(segment, bucket, term, key, positions, n: their number) and trigrams(segment, bucket, trigram, key).

    gone(segment, key) are the rows of segments that are dead.
    """

    terms: DataFrame
    trigrams: DataFrame
    buckets: int
    gone: DataFrame | None = None

    @staticmethod
    def bucket(name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")

    def joined(self, table: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
        """table's live rows with what wanted has of the column `name`; ranges of files without a wanted bucket are not read."""
        wanted = wanted.withColumn("bucket", self.bucket(name, self.buckets))
        some = [r[0] for r in wanted.select("bucket").distinct().collect()]  # no more than there are buckets
        rows = table.where(F.col("bucket").isin(some)).join(wanted, ["bucket", name]).drop("bucket")
        if self.gone is not None:
            rows = rows.join(self.gone, ["segment", *KEY], "left_anti")
        return rows.drop("segment")


def check_arguments(top_k: int = TOP_K, candidate_k: int | None = None, rrf_k: int = RRF_K, trgm_threshold: float = TRGM_THRESHOLD, vector: Sequence[float] | None = None, dimension: int | None = None) -> None:
    """Raises ValueError, naming the argument."""
    if vector is not None and dimension is not None and len(vector) != dimension:
        raise ValueError(f"query embedding dimension {len(vector)} is not {dimension}")
    if top_k < 1:
        raise ValueError(f"top_k must be at least 1, got {top_k}")
    if candidate_k is not None and candidate_k < top_k:
        raise ValueError(f"candidate_k must be at least top_k, got {candidate_k} and {top_k}")
    if rrf_k <= 0:
        raise ValueError(f"rrf_k must be positive, got {rrf_k}")
    if not 0 <= trgm_threshold <= 1:
        raise ValueError(f"trgm_threshold must be in [0, 1], got {trgm_threshold}")


def in_space(chunks: DataFrame, space_key: str | None) -> DataFrame:
    """The chunks of one space; of all spaces for None or an empty name. On a partitioned table this prunes."""
    return chunks.where(F.col("space_key") == space_key) if space_key else chunks


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """Queries by blocks that go to every task, one after the other; a block has about half of MOST_QUERIES at most."""
    n = queries.count()
    if n <= MOST_QUERIES:
        return [F.broadcast(queries)]
    parts = -(-2 * n // MOST_QUERIES)
    return [F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)) for i in range(parts)]


def _if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, as a table for every task where it has at most MOST_SENT rows, of which the caller knows the number."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def _ranked(scored: DataFrame, order: list[Column], k: int, rank: str) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(*order, *(F.col(c).asc() for c in KEY))
    return scored.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def vector_candidates(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, space_key, chunk_id, distance, vector_rank: the k nearest of each query by (distance, key); NaN comes last.

    Queries meet all chunks in blocks of MOST_QUERIES; a task keeps the k best of each query of what it reads.
    """
    base = chunks.select(*KEY, V.doubles(F.col("embedding")).alias("v"))
    base = base.withColumn("n", V.norm(F.col("v"))) if "norm" not in chunks.columns else chunks.select(*KEY, V.doubles(F.col("embedding")).alias("v"), F.col("norm").alias("n"))
    asked = queries.select("query_id", V.doubles(F.col("query_embedding")).alias("q")).withColumn("m", V.norm(F.col("q")))
    found = [_ranked(blocks.nearest(base, some, k), [F.col("distance").asc()], k, "vector_rank") for some in _blocks(asked)]
    return functools.reduce(DataFrame.unionByName, found)


def search(chunks: DataFrame, query_embedding: Sequence[float], space_key: str | None = None, top_k: int = TOP_K, dimension: int | None = None) -> DataFrame:
    """The top_k chunks nearest to one vector, with distance, nearest first; ties by key."""
    check_arguments(top_k, vector=query_embedding, dimension=dimension)
    q = F.array(*(F.lit(float(x)) for x in query_embedding))
    near = V.cosine_distance(V.doubles(F.col("embedding")), q)
    return in_space(chunks, space_key).withColumn("distance", near).drop("embedding", "norm").orderBy("distance", *KEY).limit(top_k)


def fulltext_matches(chunks: DataFrame, queries: DataFrame, analyzer: str = "english", index: Index | None = None, only: DataFrame | None = None) -> DataFrame:
    """query_id, space_key, chunk_id, text_score of all chunks that satisfy queries(query_id, query_text), or of those of only(query_id, key).

    Terms of queries meet the chunks' terms by an equi-join: those of an index, of which only the queries'
    buckets are read, stored ones (`terms`, maps of positions), or the words of `content`. Only matching terms' positions move: they make phrases, phrases alternatives.
    """
    asked = FT.query_terms(queries, analyzer)
    terms = asked.select("term").distinct()
    terms = _if_small(terms, terms.limit(MOST_SENT + 1).count())
    if index:
        rows = index.joined(index.terms, "term", terms)
    elif "terms" in chunks.columns:
        rows = chunks.select(*KEY, F.explode("terms").alias("term", "positions")).join(terms, "term")
    else:
        rows = FT.word_rows(chunks, KEY, "content", terms, analyzer)
    asked = _if_small(asked, asked.limit(MOST_SENT + 1).count())
    begin = F.transform("positions", lambda p: p - F.col("shift")).alias("begin")
    found = rows.join(asked, "term").select("query_id", *KEY, "alt", "phrase", "wanted", "size", "needed", begin)
    if only is not None:  # before positions move
        found = found.join(only, ["query_id", *KEY], "left_semi")
    phrases = found.groupBy("query_id", *KEY, "alt", "phrase", "wanted", "size", "needed").agg(F.collect_list("begin").alias("all")).where(F.size("all") == F.col("size"))
    starts = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.element_at("all", 1), F.array_intersect)
    phrases = phrases.withColumn("starts", starts).where(F.size("starts") > 0)
    alternatives = phrases.groupBy("query_id", *KEY, "alt", "needed").agg(F.count_if(~F.col("wanted")).alias("unwanted"), F.collect_list(F.when(F.col("wanted"), F.col("starts"))).alias("places"))
    good = alternatives.where((F.col("unwanted") == 0) & (F.size("places") == F.col("needed")))
    return good.select("query_id", *KEY, FT.density(F.col("places")).alias("score")).groupBy("query_id", *KEY).agg(F.max("score").alias("text_score"))


def fulltext_bounds(queries: DataFrame, analyzer: str, index: Index) -> DataFrame:
    """query_id, key, bound: the chunks that have all wanted terms of an alternative, and what their scores can't exceed.

    A score sums 1 / length over minimal stretches. Each starts at another place of a term, and a place of the rarest term lies in no
    more of them than there are phrases; a stretch that holds so many different words is at least as long. Positions
    are not read for it, only their numbers.
    """
    wanted = FT.query_terms(queries, analyzer).where("wanted")
    words = F.count_distinct("term")
    need = wanted.groupBy("query_id", "alt").agg(words.alias("total"), F.when(F.max("size") == 1, words).otherwise(1).alias("length"), F.max("needed").alias("phrases"))
    terms = wanted.select("query_id", "alt", "term").distinct().join(need, ["query_id", "alt"])
    found = index.joined(index.terms.drop("positions"), "term", _if_small(terms, terms.limit(MOST_SENT + 1).count()))
    least = found.groupBy("query_id", *KEY, "alt", "total", "length", "phrases").agg(F.count("*").alias("held"), F.min("n").alias("n"), F.sum("n").alias("places")).where("held = total")
    stretches = F.least(F.col("n") * F.col("phrases"), F.when(F.col("phrases") == F.col("total"), F.col("places")))
    return least.groupBy("query_id", *KEY).agg(F.max(stretches / F.col("length")).alias("bound"))


def fulltext_candidates(chunks: DataFrame, queries: DataFrame, k: int, analyzer: str = "english", index: Index | None = None) -> DataFrame:
    """query_id, space_key, chunk_id, text_score, fts_rank: the k best matches of each query by (score, key).

    With an index, positions move for few chunks only: those with the largest bounds first, and others where the bound
    reaches the k-th best score of these.
    """
    order = [F.col("text_score").desc()]
    if index is None:
        return _ranked(fulltext_matches(chunks, queries, analyzer), order, k, "fts_rank")
    bounds = fulltext_bounds(queries, analyzer, index)
    first = _ranked(bounds, [F.col("bound").desc()], 2 * k, "first").select("query_id", *KEY)
    kth = _ranked(fulltext_matches(chunks, queries, analyzer, index, first), order, k, "r").where(F.col("r") == k).select("query_id", F.col("text_score").alias("kth"))
    rest = bounds.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 1e-9)).select("query_id", *KEY)
    return _ranked(fulltext_matches(chunks, queries, analyzer, index, rest), order, k, "fts_rank")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


#: After all positions.
_NEVER = (1 << 31) - 1


def best_stretch(q: Column, t: Column, least: Column) -> Column:
    """The largest similarity, above least, of a query's distinct trigrams q to those of any stretch of a text's trigrams t; least if none is larger.

    A best stretch starts at a trigram of the query, does not hold that again, and ends at its first sight of another one. So
    the query's trigrams in the text are swept from the last to the first, with the next place of each: sorted,
    these are the ends to be tried, of which the n-th shares n trigrams. An end is tried only if that many could do. Far ends are not
    tried where the first stretch of three times the largest useful length has too many distinct trigrams already.
    """
    m = F.size(q)

    def found(joined: Column) -> Column:
        """Places and numbers of the query's trigrams; most others are told by one search in all of them instead of a comparison with each."""
        places = F.filter(F.transform(t, lambda x, i: F.when(F.contains(joined, x), i)), lambda i: i.isNotNull())
        return F.filter(F.transform(places, lambda i: F.struct(i.alias("p"), F.array_position(q, F.get(t, i)).cast("int").alias("k"))), lambda h: h["k"] > 0)

    hits = _let(F.array_join(q, "\n"), found)

    def distinct(start: Column, size: Column) -> Column:
        return F.size(F.array_distinct(F.slice(t, start + 1, size)))

    def tried(state: Column, h: Column) -> Column:
        best, p = state["best"], h["p"]
        most = F.ceil(m / F.greatest(best, F.lit(1e-6)))  # distinct trigrams of a better stretch

        def near(ends: Column) -> Column:
            wide = F.least(3 * most, F.lit(_NEVER >> 1).cast("long")).cast("int")
            return F.when(F.element_at(ends, -1) < p + wide, ends).when(distinct(p, wide) > most, F.filter(ends, lambda v: v < p + wide)).otherwise(ends)

        def values(ends: Column) -> Column:
            own = F.transform(ends, lambda v, i: F.when(i + 1 > best * m, (i + 1) / (m + distinct(p, v - p + 1) - (i + 1))).otherwise(F.lit(0.0)))
            return F.coalesce(F.array_max(own), F.lit(0.0))

        def of(ends: Column) -> Column:
            return F.when(F.size(ends) > best * m, _let(near(ends), lambda e: F.when(F.size(e) > best * m, values(e)).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))

        return F.greatest(best, _let(F.array_sort(F.filter(state["next"], lambda v: v < state["until"])), of))

    def step(state: Column, h: Column) -> Column:
        moved = F.struct(F.transform(state["next"], lambda v, i: F.when(i + 1 == h["k"], h["p"]).otherwise(v)).alias("next"), F.element_at(state["next"], h["k"]).alias("until"), state["best"].alias("best"))
        return _let(moved, lambda x: F.struct(x["next"].alias("next"), tried(x, h).alias("best")))

    start = F.struct(F.array_repeat(F.lit(_NEVER), m).alias("next"), least.cast("double").alias("best"))
    return F.aggregate(F.reverse(hits), start, step, lambda s: s["best"])


def word_similarity(query: Column, content: Column) -> Column:
    """The similarity of a text's trigrams to the most similar contiguous stretch of a content's, from 0 to 1; 0 for a null."""
    q, t = T.trigram_set(query), T.trigrams(content)
    found = F.when(F.size(q) > 0, _let(F.struct(q.alias("q"), t.alias("t")), lambda x: best_stretch(x["q"], x["t"], F.lit(0.0))))
    return F.coalesce(found, F.lit(0.0))


def trigram_candidates(chunks: DataFrame, queries: DataFrame, k: int, threshold: float = TRGM_THRESHOLD, index: Index | None = None) -> DataFrame:
    """query_id, space_key, chunk_id, trgm_score, trgm_rank: the k chunks most similar to each query, with a word similarity of threshold or more.

    The share of a query's trigrams that a chunk has at all bounds the similarity. Trigrams of chunks meet
    those of queries by an equi-join, through an index where there is one, and are counted. Chunks that hold a query word for
    word (known without an index only) and those with the largest shares are looked at first; contents of others come only where
    the share could reach the k-th best similarity of these, or with a smaller key be as large. A content's trigrams
    are made once for all queries that it is looked at for.
    """
    asked = queries.select("query_id", T.trigram_set(F.col("query_text")).alias("q"), T.spaced(F.col("query_text")).alias("whole")).withColumn("m", F.size("q")).where("m > 0")
    wanted = asked.select("query_id", "m", F.explode(F.array_append("q", F.col("whole"))).alias("trigram"))
    listed = [r[0] for r in wanted.select("trigram").distinct().limit(MOST_LISTED + 1).collect()]
    wanted = _if_small(wanted, wanted.limit(MOST_SENT + 1).count())
    if index:
        found = index.joined(index.trigrams, "trigram", wanted)
    elif len(listed) <= MOST_LISTED:  # only these are looked for
        has = _let(T.spaced(F.col("content")), lambda x: F.filter(F.lit(listed), lambda w: x.contains(w)))
        found = chunks.select(*KEY, F.explode(has).alias("trigram")).join(wanted, "trigram")
    else:
        found = chunks.select(*KEY, F.explode(T.trigram_set(F.col("content"))).alias("trigram")).join(wanted, "trigram")
    single = F.length("trigram") == 3
    for c in ("query_id", *KEY):  # as the joins below ask; said here, so that shares are counted once for both uses
        found = found.where(F.col(c).isNotNull())
    shares = found.groupBy("query_id", *KEY, "m").agg(F.count_if(single).alias("n"), F.count_if(~single).alias("whole")).where((F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("n") > 0))
    asked = _if_small(asked.select("query_id", "q"), asked.limit(MOST_SENT + 1).count())
    texts = chunks.select(*KEY, "content")
    tasks = chunks.sparkSession.sparkContext.defaultParallelism

    def scored(some: DataFrame, least: Column) -> DataFrame:
        looked = some.select("query_id", *KEY, least.cast("double").alias("least")).join(asked, "query_id").groupBy(*KEY).agg(F.collect_list(F.struct("query_id", "q", "least")).alias("for"))
        near = looked.join(texts, KEY).repartition(tasks, *KEY)  # few bytes, much work
        reached = lambda x: F.greatest(x["least"] - 1e-9, F.lit(0.0))  # noqa: E731 - what reaches least counts
        scores = _let(T.trigrams(F.col("content")), lambda t: F.transform("for", lambda x: F.struct(x["query_id"].alias("query_id"), x["least"].alias("least"), best_stretch(x["q"], t, reached(x)).alias("trgm_score"))))
        each = near.select(*KEY, F.explode(scores).alias("x")).select("x.query_id", *KEY, "x.least", "x.trgm_score")
        return each.where((F.col("trgm_score") >= F.greatest(F.col("least") - 1e-12, F.lit(threshold))) & (F.col("trgm_score") > 0)).drop("least")

    first = _ranked(shares, [F.col("whole").desc(), F.col("n").desc()], 10 * k, "first")
    last = F.struct(*(F.col(c).alias(f"{c}_k") for c in KEY)).alias("last")
    kth = _ranked(scored(first, F.lit(threshold)), [F.col("trgm_score").desc()], k, "r").where(F.col("r") == k).select("query_id", F.col("trgm_score").alias("kth"), last)
    bound, after = F.col("n") / F.col("m"), F.struct(*KEY) > F.col("last")  # by a share that is no larger and a later key a chunk stays behind k others
    rest = shares.where("whole >= 0").join(kth, "query_id", "left").withColumn("least", F.coalesce("kth", F.lit(threshold)))  # with the same columns the same counts serve again
    rest = rest.where((F.col("n") >= F.col("least") * F.col("m") - 1e-9) & ~F.coalesce((bound <= F.col("kth")) & after, F.lit(False)))
    return _ranked(scored(rest, F.col("least")), [F.col("trgm_score").desc()], k, "trgm_rank")


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left_id, right_id, similarity of all pairs of left(left_id, trigrams) and right(right_id, trigrams) with a Jaccard similarity of least or more.

    Shared trigrams are counted through lists of the right sets that hold a trigram. Ids must be unique; empty sets pair with nothing.
    """
    pairs = postings.shared(left, right, lambda n, m, both: both >= least * (n + m - both) - 1e-6)
    similarity = F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared"))
    return pairs.select("left_id", "right_id", similarity.alias("similarity")).where(F.col("similarity") >= least)


def holding_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left_id, right_id of all pairs where left's trigrams hold at least the share `least` of right's; inputs as in similar_sets()."""
    return postings.shared(left, right, lambda n, m, both: both >= least * m).select("left_id", "right_id")


def fuse(vector: DataFrame, fts: DataFrame, trgm: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, space_key, chunk_id, vector_rank, fts_rank, trgm_rank, rrf_score of all candidates, each once.

    A score is the sum of 1 / (rrf_k + rank) over the lists that hold the chunk, in this order of lists.
    """
    ranks = ("vector_rank", "fts_rank", "trgm_rank")

    def only(df: DataFrame, rank: str) -> DataFrame:
        return df.select("query_id", *KEY, *(F.col(r).cast("int").alias(r) if r == rank else F.lit(None).cast("int").alias(r) for r in ranks))

    every = only(vector, ranks[0]).unionByName(only(fts, ranks[1])).unionByName(only(trgm, ranks[2]))
    merged = every.groupBy("query_id", *KEY).agg(*(F.max(r).alias(r) for r in ranks))
    score = F.lit(0.0)
    for r in ranks:
        score = score + F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    return merged.withColumn("rrf_score", score)


def hybrid(chunks: DataFrame, queries: DataFrame, space_key: str | None = None, top_k: int = TOP_K, candidate_k: int = CANDIDATE_K, rrf_k: int = RRF_K, trgm_threshold: float = TRGM_THRESHOLD, analyzer: str = "english", index: Index | None = None, nearest: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Of each query the top_k chunks by fused ranks: query_id, ref, the chunk's columns, distance, rrf_score and ranks.

    queries has query_id, query_text and query_embedding. ref is 1 for the best; ties in rrf_score go by
    distance, then key. Distances and contents are looked up for the few chunks that are left only. An index
    must be of the same chunks, and so must `nearest`, which gives the vector candidates of queries (as cells.candidates() does).
    """
    check_arguments(top_k, candidate_k, rrf_k, trgm_threshold)
    found = in_space(chunks, space_key)
    if index:
        index = index._replace(terms=in_space(index.terms, space_key), trigrams=in_space(index.trigrams, space_key))
    close = nearest(queries, candidate_k) if nearest else vector_candidates(found, queries, candidate_k)
    fused = fuse(close, fulltext_candidates(found, queries, candidate_k, analyzer, index), trigram_candidates(found, queries, candidate_k, trgm_threshold, index), rrf_k)
    n = queries.count()
    kept = [c for c in found.columns if c not in ("embedding", "terms", "norm", *KEY)]
    full = found.select(*KEY, *kept, V.doubles(F.col("embedding")).alias("v")).join(_if_small(fused, 3 * candidate_k * n), KEY)
    asked = queries.select("query_id", V.doubles(F.col("query_embedding")).alias("q"))
    near = full.join(F.broadcast(asked) if n <= MOST_QUERIES else asked, "query_id").withColumn("distance", V.cosine_distance(F.col("v"), F.col("q")))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc("distance"), *(F.asc(c) for c in KEY))
    return near.withColumn("ref", F.row_number().over(order)).where(F.col("ref") <= top_k).select("query_id", "ref", *KEY, *kept, "distance", "rrf_score", "vector_rank", "fts_rank", "trgm_rank")


def evidence(hits: DataFrame) -> DataFrame:
    """What an answer may cite: query_id, ref, source_id, title, heading, breadcrumb, content."""
    return hits.select("query_id", "ref", "source_id", "title", "heading", "breadcrumb", "content")


def one_query(spark: SparkSession, text: str, embedding: Sequence[float]) -> DataFrame:
    """A DataFrame of a single query."""
    if any(math.isnan(x) for x in embedding):
        raise ValueError("query embedding holds NaN")
    return spark.createDataFrame([("q", text, [float(x) for x in embedding])], "query_id string, query_text string, query_embedding array<double>")
