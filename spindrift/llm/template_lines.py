"""Line dedup by a fixed-depth tree of log templates.

A line's tokens are its runs of bytes other than white space; tokens with a digit are variable fields.
The tree has one level for the token count and one for each of the first LEAD tokens, variable fields
alike. A leaf holds groups of lines: at each later position a token that min_docs of the leaf's lines have there
is constant, any other is a variable field, and lines that are alike after that are a group. A group with
enough constant positions is a template, so a few other lines in a leaf change nothing and a leaf may have
several templates. Lines with fewer tokens than a leaf asks for are templates as they are, variable fields alike.

A template that recurs in at least min_docs documents is dropped everywhere but at its first place. For lines of LONG
tokens or more FEW_DOCS take the place of min_docs: short lines recur by chance, passages don't.
Templates and leaves are counted inside each task before anything moves, so a frequent line is one row from
each; of leaves below min_docs documents no line moves at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm._shared import saved, scratch
from spindrift.llm._words import U64, chunks, mix, word_hashes

LEAD, AGREE, SHORTEST, MIN_DOCS = 3, 0.7, 6, 10
LONG, FEW_DOCS = 20, 3
#: Templates that a task counts before it sends them, some 200 bytes each.
HELD = 150_000
_FIELD = U64(0x5DEECE66D1234567)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


class Lines:
    """The lines of some texts: the document of each, its number there, its token bounds; all tokens' hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        base = int(at[0])
        raw, rel = data[base : int(at[-1])], at - base
        breaks = np.flatnonzero(raw == 10)
        rows = len(at) - 1
        # a line starts at each text's start and after each line feed
        lines = 1 + np.diff(np.searchsorted(breaks, rel))
        first = np.cumsum(lines) - lines
        after = np.ones(int(lines.sum()), bool)
        after[first] = False
        self.starts = np.empty(len(after), np.int64)
        self.starts[first], self.starts[after] = rel[:-1], breaks + 1
        self.of = np.repeat(np.arange(rows), lines)
        self.number = np.arange(len(after)) - first[self.of]
        h, _, word_starts, word_ends = word_hashes(data, at, lower=False)
        word_starts, word_ends = word_starts - base, word_ends - base
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        h = np.where(digits[word_ends] > digits[word_starts], _FIELD, h)
        self.tokens = h
        self.bounds = np.concatenate([np.searchsorted(word_starts, self.starts), [len(h)]])
        self.counts = np.diff(self.bounds)

    def templates(self, lead: int, shortest: int) -> np.ndarray:
        """Each line's leaf or, below `shortest` tokens, its sequence of tokens, as a hash; that of a line without tokens is of no use."""
        place = np.arange(len(self.tokens)) - np.repeat(self.bounds[:-1], self.counts)
        salted = mix(self.tokens + place.astype(U64) * U64(0x9E3779B97F4A7C15), 101)
        used = (place < lead) | np.repeat(self.counts < shortest, self.counts)
        total = np.zeros(len(salted) + 1, U64)
        np.cumsum(np.where(used, salted, U64(0)), out=total[1:])
        return mix((total[self.bounds[1:]] - total[self.bounds[:-1]]) ^ mix(self.counts.astype(U64), 102), 103).view(np.int64)


def _lines(column: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    for i, j, data, at in chunks(column):
        yield i, j, Lines(data, at)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_SUMS = "template long, n int, docs long, first_doc long"


def _least(n: Column, min_docs: int, few_docs: int) -> Column:
    """How many documents make a template of lines of n tokens recurring."""
    return F.when(n >= LONG, min(few_docs, min_docs)).otherwise(min_docs)


def _summed(docs: DataFrame, lead: int, shortest: int) -> DataFrame:
    """template long, n int, docs long, first_doc long: tokens of each leaf and short template, documents with it, and their smallest doc_id, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def take() -> pa.RecordBatch:
            columns = [pa.array([v[k] for v in held.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            out = _batch(template=pa.array(held, pa.int64()), n=columns[2], docs=columns[0], first_doc=columns[1])
            held.clear()
            return out

        for batch in batches:
            for i, j, x in _lines(batch.column(1)):
                ids = batch.column(0).slice(i, j - i).to_pylist()
                templates, of = x.templates(lead, shortest), x.of
                some = np.flatnonzero(x.counts > 0)
                if not len(some):
                    continue
                triples = np.unique(np.stack([of[some], templates[some], x.counts[some]]), axis=1)  # a document's template once
                for doc, t, n in zip(*(p.tolist() for p in triples)):
                    got, first = held.get(t), ids[doc]
                    if got is None:
                        held[t] = [1, first, n]
                    else:
                        got[0] += 1
                        if first is not None and (got[1] is None or first < got[1]):
                            got[1] = first
                if len(held) > HELD:
                    yield take()
        if held:
            yield take()

    return docs.select("doc_id", "text").mapInArrow(run, _SUMS)


def recurring(docs: DataFrame, min_docs: int, few_docs: int, lead: int, shortest: int) -> DataFrame:
    """template long, first_doc long: leaves and short templates in as many documents as it takes."""
    sums = _summed(docs, lead, shortest).groupBy("template").agg(F.first("n").alias("n"), F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"))
    return sums.where(F.col("docs") >= _least(F.col("n"), min_docs, few_docs)).select("template", "first_doc")


def _places(docs: DataFrame, lead: int, shortest: int) -> DataFrame:
    """row long, key long, doc_id long, line int, template long, tokens array<int>: every line with tokens; a leaf's with its later ones.

    row is the number of a row of docs: of its task and in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            for i, j, x in _lines(batch.column(2)):
                keys, ids = (batch.column(k).slice(i, j - i) for k in (0, 1))
                line = np.flatnonzero(x.counts > 0)
                of = pa.array(x.of[line])
                later = np.where(x.counts[line] >= shortest, x.counts[line] - lead, 0)
                ends = np.cumsum(later)
                take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(x.bounds[line] + lead - (ends - later), later)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array((x.tokens[take] >> U64(32)).astype(np.uint32).view(np.int32)))
                yield _batch(row=pa.array(row + x.of[line]), key=keys.take(of), doc_id=ids.take(of), line=pa.array(x.number[line].astype(np.int32)), template=pa.array(x.templates(lead, shortest)[line]), tokens=tokens)
                row += j - i

    return docs.select("key", "doc_id", "text").mapInArrow(run, "row long, key long, doc_id long, line int, template long, tokens array<int>")


def _hits(docs: DataFrame, min_docs: int, few_docs: int, lead: int, agree: float, shortest: int) -> DataFrame:
    """key long, doc_id long, line int, template long, first_doc long: the lines of recurring templates.

    Joins are by template, token and row; where one of them is frequent, adaptive execution splits it. Both sides
    of all of them grow with the corpus, so they are merge joins at every size.
    """
    found = saved(recurring(docs, min_docs, few_docs, lead, shortest), "templates")
    hits = saved(_places(docs, lead, shortest).join(found.hint("merge"), "template"), "hits")
    short = hits.where(F.size("tokens") == 0).select("key", "doc_id", "line", "template", "first_doc")
    wide = hits.where(F.size("tokens") > 0).select("row", "key", "doc_id", "line", "template", F.size("tokens").alias("later"), F.posexplode("tokens").alias("place", "token"))
    wide = wide.select("row", "key", "doc_id", "line", "template", "later", F.xxhash64("template", "place", "token").alias("cell"))
    least = _least(F.col("later") + lead, min_docs, few_docs)
    common = saved(wide.groupBy("cell").agg(F.count("*").alias("n"), F.first("later").alias("later")).where(F.col("n") >= least).select("cell"), "common")
    masks = wide.join(common.hint("merge"), "cell").groupBy("row", "line", "key", "doc_id", "template", "later").agg(F.count("*").alias("constant"), F.bit_xor("cell").alias("mask"))
    full = masks.where(F.col("constant") >= F.col("later") * agree)
    groups = saved(full.select("row", "line", "key", "doc_id", "later", F.xxhash64("template", "constant", "mask").alias("template")), "groups")
    once = groups.groupBy("template", "row").agg(F.first("doc_id").alias("doc_id"), F.first("later").alias("later"))
    firsts = once.groupBy("template").agg(F.first("later").alias("later"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    firsts = firsts.where(F.col("docs") >= least).select("template", "first_doc")
    return short.unionByName(groups.join(firsts.hint("merge"), "template").select("key", "doc_id", "line", "template", "first_doc"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, lead: int = LEAD, agree: float = AGREE, shortest: int = SHORTEST, few_docs: int = FEW_DOCS) -> DataFrame:
    """docs with the recurring lines out of text, and n_lines int, n_dropped int beside its own columns.

    A line is what stands between line feeds. It goes if its template recurs in min_docs rows or more
    (in few_docs, where it has LONG tokens or more), unless it is the template's first line in the rows with the smallest doc_id that have it; so no template is lost
    altogether. The template of a line of `shortest` tokens or more is its group in its leaf, if that has the
    share `agree` of constant positions after the first `lead` ones; that of a shorter line is the line.
    Lines without tokens stay. Kept lines are joined by line feeds; a text that loses all its
    lines is empty. A null text stays null, with no lines; a null doc_id is never a smallest one, so if all
    are null, all lines of the template go. Every row counts as a document; rows alike in doc_id and text
    fare alike. Other columns stay as they are, but for n_lines and n_dropped, which are replaced. No rows
    give no rows.
    """
    if not 0 < lead < shortest:
        raise ValueError(f"lead must be from 1 to below shortest, got {lead} and {shortest}")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the caller's columns travel as one, so none of their names meets one from here
    own = F.struct(*(docs[f"`{c}`"].alias(c) for c in names)).alias("own")
    keyed = docs.select(own, docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    plain = keyed.select("doc_id", "text", "key").where("text is not null")
    with scratch() as kept_tables:
        hits = saved(_hits(plain, min_docs, few_docs, lead, agree, shortest), "recurring")
        kept_tables.append(hits)
    first = hits.where("doc_id = first_doc").groupBy("key", "doc_id", "template").agg(F.min("line").alias("line"))
    gone = hits.join(first.withColumn("first", F.lit(True)), ["key", "doc_id", "template", "line"], "left").where("first is null")
    gone = gone.groupBy(F.col("key").alias("gone_key"), F.col("doc_id").alias("gone_id")).agg(F.collect_set("line").alias("gone"))  # of one text's lines
    joined = keyed.join(gone, (F.col("key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i.cast("int")))
    text = F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias("text") if c == "text" else F.col("own").getField(c).alias(c) for c in names]
    size = F.coalesce(F.size("gone"), F.lit(0))
    return joined.select(*out, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.greatest(size, F.lit(0)).alias("n_dropped"))


#: The same by explicit tokens, for tables that are small enough and have distinct doc_ids.
ORACLE_SQL = r"""
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
tokens AS (SELECT doc_id, line, s, list_transform(regexp_extract_all(s, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM lines),
filled AS (SELECT *, len(t) AS n FROM tokens WHERE len(t) > 0),
short AS (SELECT t, min(doc_id) AS first_doc FROM filled WHERE n < 6 GROUP BY t HAVING count(DISTINCT doc_id) >= 10),
wide AS (SELECT doc_id, line, n, t[1:3] AS lead, unnest(t[4:]) AS token, unnest(range(n - 3)) AS i FROM filled WHERE n >= 6),
common AS (SELECT n, lead, i, token FROM wide GROUP BY ALL HAVING count(*) >= CASE WHEN n >= 20 THEN 3 ELSE 10 END),
masks AS (SELECT doc_id, line, n, lead, list([i::VARCHAR, token] ORDER BY i) AS mask FROM wide JOIN common USING (n, lead, i, token) GROUP BY doc_id, line, n, lead HAVING count(*) >= 0.7 * (n - 3)),
wanted AS (SELECT n, lead, mask, min(doc_id) AS first_doc FROM masks GROUP BY n, lead, mask HAVING count(DISTINCT doc_id) >= CASE WHEN n >= 20 THEN 3 ELSE 10 END),
found AS (SELECT doc_id, line, ['='] || t AS template, first_doc FROM filled JOIN short USING (t)
  UNION ALL SELECT doc_id, line, [n::VARCHAR] || lead || flatten(mask), first_doc FROM masks JOIN wanted USING (n, lead, mask)),
gone AS (SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY template, doc_id ORDER BY line) AS k FROM found) WHERE doc_id <> first_doc OR k > 1),
kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL) AS text, count(g.line) AS gone, count(*) AS n FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT doc_id, n::INT AS n_lines, gone::INT AS n_dropped, sha256(coalesce(text, '')) AS text_sha256 FROM kept
"""
