"""Documents to chunks along their headings, as one DataFrame plan.

Lines are exploded once; fences and heading paths are running window states of a document, sections are
grouped back, long sections are packed by a fold over their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import text as T

# The longest chunk in characters, the lines that two pieces of a section share, a heading.
MAX_CHARS, OVERLAP = 1800, 2
HEADING = r"(?U)^(#{1,6})[\s\x1c-\x1f]+(.*)$"

_DOC = ["space_key", "source_id"]


def lines(docs: DataFrame) -> DataFrame:
    """docs exploded to pos int, line string, by Unicode line boundaries."""
    return docs.select(*[c for c in docs.columns if c != "body"], F.posexplode(T.split_lines(F.col("body"))).alias("pos", "line"))


def fences(numbered: DataFrame, key: list[str] = _DOC) -> DataFrame:
    """numbered lines with in_fence boolean: after a line that opens a fence, up to the one that closes it."""
    start = T.lstrip(F.col("line"))
    toggles = (start.startswith("```") | start.startswith("~~~")).cast("int")
    order = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("in_fence", F.sum(toggles).over(order) % 2 == 1)


def headings(fenced: DataFrame, key: list[str] = _DOC) -> DataFrame:
    """Lines with level int (null for none), title string, section int and heading string, the path of titles.

    For each of the six levels the last title so far is known; it is part of the path while its line comes
    after those of all levels above.
    """
    # a heading's line has no line feed, so `.` reaches its end
    found = F.col("line").rlike(HEADING) & ~F.col("in_fence")
    level = F.when(found, F.length(F.regexp_extract("line", HEADING, 1)))
    titled = fenced.withColumn("level", level).withColumn("title_here", F.when(found, T.strip(F.regexp_extract("line", HEADING, 2))))
    order = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct(F.col("pos").alias("p"), F.col("title_here").alias("t"))), ignorenulls=True).over(order) for k in range(1, 7)}
    named = titled.withColumns({f"__h{k}": c for k, c in last.items()} | {"section": F.count("level").over(order).cast("int")})
    parts = []
    for k in range(1, 7):
        after = F.lit(True)
        for j in range(1, k):
            after = after & (F.col(f"__h{j}").isNull() | (F.col(f"__h{j}.p") < F.col(f"__h{k}.p")))
        parts.append(F.when(F.col(f"__h{k}").isNotNull() & after, F.col(f"__h{k}.t")))
    path = F.when(F.col("section") > 0, F.concat_ws(" > ", *parts))
    return named.withColumn("heading", path).drop(*(f"__h{k}" for k in range(1, 7)), "title_here")


def last_of_each(docs: DataFrame) -> DataFrame:
    """space_key, source_id, title, breadcrumb, body: of documents with one key, the one with the largest position.

    position is a column of docs, if there is one; among equals, and without it, the largest by body, title
    and breadcrumb counts, nulls being smallest.
    """
    order = [F.desc(c) for c in (["position"] if "position" in docs.columns else []) + ["body", "title", "breadcrumb"]]
    turn = F.row_number().over(Window.partitionBy(*_DOC).orderBy(*order))
    return docs.withColumn("__turn", turn).where("__turn = 1").select(*_DOC, "title", "breadcrumb", "body")


def sections(docs: DataFrame) -> DataFrame:
    """space_key, source_id, title, breadcrumb, section int, heading string, lines array<string>.

    A section runs from a heading to the next; those with nothing but a heading, or nothing at all, go. Of
    documents with one key only the last counts. All windows and groups here share one shuffle, by key.
    """
    named = headings(fences(lines(last_of_each(docs))))
    grouped = named.groupBy(*_DOC, "section").agg(
        F.first("title").alias("title"), F.first("breadcrumb").alias("breadcrumb"), F.first("heading").alias("heading"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"),
    )
    full = F.filter("lines", lambda x: T.strip(x) != "")
    only_heading = (F.size(full) == 1) & F.element_at(full, 1).rlike(HEADING)
    return grouped.where((F.size(full) > 0) & ~F.coalesce(only_heading, F.lit(False)))


def pieces(parts: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """array<array<string>>: lines packed to pieces of at most max_chars characters, line feeds counted.

    Lines that fit are one piece. Else a line that doesn't fit closes the piece, and the next one starts with
    the last lines of it. A single line is never cut, and the shared lines come even if they are too long.
    """
    none = F.array().cast("array<string>")
    size = F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x) + 1)
    start = F.struct(F.lit(0).alias("size"), none.alias("held"), F.array().cast("array<array<string>>").alias("out"))

    def add(state: Column, line: Column) -> Column:
        full = (state["size"] + F.length(line) + 1 > max_chars) & (F.size(state["held"]) > 0)
        tail = F.slice(state["held"], F.greatest(F.lit(1), F.size(state["held"]) - (overlap - 1)), F.lit(overlap)) if overlap else none
        held = F.when(full, tail).otherwise(state["held"])
        before = F.when(full, F.aggregate(tail, F.lit(0), lambda s, x: s + F.length(x) + 1)).otherwise(state["size"])
        out = F.when(full, F.concat(state["out"], F.array(state["held"]))).otherwise(state["out"])
        return F.struct((before + F.length(line) + 1).alias("size"), F.concat(held, F.array(line)).alias("held"), out.alias("out"))

    packed = F.aggregate(parts, start, add, lambda s: F.concat(s["out"], F.when(F.size(s["held"]) > 0, F.array(s["held"])).otherwise(F.array().cast("array<array<string>>"))))
    return F.when(size <= max_chars, F.array(parts)).otherwise(packed)


def embedding_text(breadcrumb: Column, title: Column, heading: Column, content: Column) -> Column:
    """`[breadcrumb > title > heading]`, empty parts left out, on a line above the content; content alone without any."""
    header = F.concat_ws(" > ", *(T.blank_to_null(x) for x in (breadcrumb, title, heading)))
    return F.when(header == "", content).otherwise(F.concat(F.lit("["), header, F.lit("]\n"), content))


def chunks(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """chunk_id, source_id, space_key, title, heading, breadcrumb, content, seq int, embedding_text.

    docs has space_key, source_id, title, breadcrumb and body. Chunks of a document count from 0 in the order
    of the text; chunk_id is source_id, `#` and that number. Pieces without content count nothing.
    """
    found = sections(docs).select(*_DOC, "title", "breadcrumb", "heading", "section", F.posexplode(pieces(F.col("lines"), max_chars)).alias("piece", "held"))
    filled = found.withColumn("content", T.strip(F.array_join("held", "\n"))).where("content <> ''")
    order = Window.partitionBy(*_DOC).orderBy("section", "piece")
    numbered = filled.withColumn("seq", F.row_number().over(order) - 1)
    return numbered.select(
        F.concat("source_id", F.lit("#"), F.col("seq").cast("string")).alias("chunk_id"), "source_id", "space_key", "title", "heading", "breadcrumb", "content", "seq",
        embedding_text(F.col("breadcrumb"), F.col("title"), F.col("heading"), F.col("content")).alias("embedding_text"),
    )
