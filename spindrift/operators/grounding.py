"""Grounding of drafted answers: lines are kept for the evidence that they cite, or dropped.

drafts(answer_id, text) are exploded to lines; which lines are structure is window state; markers are
found, resolved against evidence and removed by expressions; answers are grouped back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The line shapes that grounding tells apart. White space is Unicode's.
_S = r"[\s\x1c-\x1f]"
FENCE = rf"(?U)^{_S}{{0,3}}`{{3,}}"
HEADING = rf"(?U)^{_S}{{0,3}}#{{1,6}}({_S}|$)"
RULE = rf"(?U)^{_S}{{0,3}}(-{{3,}}|\*{{3,}}|_{{3,}}){_S}*$"
TABLE_SEPARATOR = rf"(?U)^{_S}*\|?{_S}*:?-{{3,}}:?{_S}*(\|{_S}*:?-{{3,}}:?{_S}*)+\|?{_S}*$"
TABLE_ROW = rf"(?U)^({_S}*\|.*\|)([^|]*)(\|{_S}*)$"
MARKER = r"(?U)\[(\d+)\]"
HANGUL = "[가-힣]"
SNIPPET, TRACE_DETAIL = 200, 80
UNKNOWN_TABLE = "unknown.unknown.unknown"

CITATION = "struct<kind:string,source_id:string,title:string,heading:string,breadcrumb:string,sql:string,snippet:string>"


def remove_markers(text: Column) -> Column:
    """Without `[n]` markers and the commas between neighbouring ones, then tidied.

    A run of markers before a Hangul syllable also loses the blanks before it, so that a particle meets its
    word. The text then starts again with the blanks that it started with; as many characters are taken off
    the rest as those were, even where a removal has already taken them.
    """
    run = r"\[\d+\](?:(?:[ \t]*,[ \t]*)?\[\d+\])*"
    indent = F.regexp_extract(text, r"^([ \t]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(text, rf"(?:[ \t]*{run})+(?={HANGUL})", ""), run, "")
    body = F.substring(bare, F.length(indent) + 1, F.length(bare))
    body = F.regexp_replace(body, r"^[ \t]+|[ \t]+$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t]{2,}", " "), r"[ \t]+([.,!?])", "$1")
    return F.concat(indent, body)


def draft_lines(drafts: DataFrame) -> DataFrame:
    """answer_id, pos, line, structural, is_table, target: a draft's lines, and the part of each that may hold markers.

    Structure is: blank lines, fences and what they enclose, headings, rules, table separators and the row
    above one. A table row's markers are in its last cell.
    """
    lines = drafts.select("answer_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy("answer_id").orderBy("pos")
    fence = F.col("line").rlike(FENCE)
    seen = F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("fence", fence).withColumn("inside", (F.col("fence")) | (seen % 2 == 1))
    outside = ~F.col("inside")
    separator = outside & F.col("line").rlike(TABLE_SEPARATOR)
    table_row = F.col("line").rlike(TABLE_ROW)
    lines = lines.withColumn("separator", separator)
    heads = table_row & F.coalesce(F.lead("separator").over(order), F.lit(False))
    blank = ~F.col("line").rlike(r"(?U)[^\s\x1c-\x1f]")
    structural = blank | F.col("inside") | (outside & (F.col("line").rlike(HEADING) | F.col("line").rlike(RULE))) | F.col("separator") | heads
    target = F.when(table_row, F.regexp_extract("line", TABLE_ROW, 2)).otherwise(F.col("line"))
    return lines.select("answer_id", "pos", "line", structural.alias("structural"), table_row.alias("is_table"), target.alias("target"))


def bind_lines(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, pos, line, kept boolean, text: each line's fate; and refs array<decimal(38,0)>, the resolving ones in order.

    A line with a marker that names evidence stays, without its markers; a line without markers stays only
    if the answer has no document evidence at all; structure always stays as it is.
    """
    known = evidence.groupBy("answer_id").agg(F.collect_set(F.col("ref").cast("decimal(38,0)")).alias("known"))
    lines = draft_lines(drafts).join(known, "answer_id", "left")
    found = F.transform(F.regexp_extract_all("target", F.lit(MARKER), 1), lambda x: x.try_cast("decimal(38,0)"))
    lines = lines.withColumn("found", found).withColumn("refs", F.filter("found", lambda x: F.coalesce(F.array_contains("known", x), F.lit(False))))
    resolves = F.size("refs") > 0
    unmarked = (F.size("found") == 0) & F.col("known").isNull()
    clean = remove_markers(F.col("target"))
    rebuilt = F.when(F.col("is_table"), F.concat(F.regexp_extract("line", TABLE_ROW, 1), clean, F.lit(" "), F.regexp_extract("line", TABLE_ROW, 3))).otherwise(clean)
    text = F.when(~F.col("structural") & resolves, rebuilt).otherwise(F.col("line"))
    none = F.array().cast("array<decimal(38,0)>")
    return lines.select("answer_id", "pos", "line", (F.col("structural") | resolves | unmarked).alias("kept"), text.alias("text"), F.when(~F.col("structural"), F.col("refs")).otherwise(none).alias("refs"))


def collect_evidence(calls: DataFrame) -> DataFrame:
    """answer_id, ref and the fields of calls(answer_id, call_no, item_no, ref, ...): of a ref that came again, the last."""
    fields = [c for c in calls.columns if c not in ("answer_id", "ref")]
    last = F.max_by(F.struct(*fields), F.struct("call_no", "item_no"))
    kept = [c for c in fields if c not in ("call_no", "item_no")]
    return calls.where("ref is not null").groupBy("answer_id", "ref").agg(last.alias("x")).select("answer_id", "ref", *(F.col(f"x.{c}").alias(c) for c in kept))


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def document_citation(prefix: str = "") -> Column:
    """A citation of an evidence row's columns."""
    at = lambda name: F.col(f"{prefix}{name}")
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit("document").alias("kind"), at("source_id").alias("source_id"), at("title").alias("title"), _or_null(at("heading")).alias("heading"),
        at("breadcrumb").alias("breadcrumb"), null.alias("sql"), _or_null(F.substring(F.coalesce(at("content"), F.lit("")), 1, SNIPPET)).alias("snippet"),
    ).cast(CITATION)


def sql_citation() -> Column:
    """A citation of a query's evidence: its first table, its SQL and its number of rows."""
    null = F.lit(None).cast("string")
    table = F.coalesce(F.try_element_at("referenced_tables", F.lit(1)), F.lit(UNKNOWN_TABLE))
    rows = F.concat(F.coalesce(F.col("row_count_returned").cast("string"), F.lit("?")), F.lit(" rows returned"))
    return F.struct(F.lit("bigquery").alias("kind"), table.alias("source_id"), null.alias("title"), null.alias("heading"), null.alias("breadcrumb"), F.col("sql"), rows.alias("snippet")).cast(CITATION)


def document_citations(bound: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, n int, citation: each cited evidence once, by its first marker."""
    refs = bound.select("answer_id", "pos", F.posexplode("refs").alias("i", "ref"))
    first = refs.groupBy("answer_id", "ref").agg(F.min(F.struct("pos", "i")).alias("at"))
    joined = first.join(evidence.withColumn("ref", F.col("ref").cast("decimal(38,0)")), ["answer_id", "ref"])
    order = Window.partitionBy("answer_id").orderBy("at")
    return joined.select("answer_id", F.row_number().over(order).alias("n"), document_citation().alias("citation"))


def ground(drafts: DataFrame, evidence: DataFrame, sql_evidence: DataFrame | None = None) -> DataFrame:
    """answer_id, status, answer, citations, dropped of every draft.

    evidence has answer_id, ref, source_id, title, heading, breadcrumb, content; sql_evidence has answer_id,
    call_no, sql, referenced_tables, row_count_returned, of which rows without sql don't count. Citations of
    SQL come first. An answer without any citation or any text is `refused`, with nulls; else `grounded`.
    """
    bound = bind_lines(drafts, evidence)
    ordered = lambda keep, value: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", value)))), lambda x: x[value])
    texts = bound.groupBy("answer_id").agg(ordered(F.col("kept"), "text").alias("lines"), ordered(~F.col("kept"), "line").alias("dropped"))
    answer = F.regexp_replace(F.array_join("lines", "\n"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    cited = document_citations(bound, evidence).select("answer_id", F.lit(1).alias("part"), "n", "citation")
    if sql_evidence is not None:
        cited = cited.unionByName(sql_evidence.where("sql <> ''").select("answer_id", F.lit(0).alias("part"), F.col("call_no").cast("int").alias("n"), sql_citation().alias("citation")))
    lists = cited.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "citation"))), lambda x: x["citation"]).alias("citations"))
    out = drafts.select("answer_id").join(texts, "answer_id", "left").join(lists, "answer_id", "left").withColumn("answer", answer)
    good = F.col("citations").isNotNull() & (F.col("answer") != "")
    return out.select("answer_id", F.when(good, "grounded").otherwise("refused").alias("status"), F.when(good, F.col("answer")).alias("answer"), F.when(good, F.col("citations")).alias("citations"), F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped"))


REFUSAL = "no supporting evidence was found, so there is no grounded answer"


class NoEvidenceError(RuntimeError):
    """An answer had nothing to cite."""


def ground_one(drafts: DataFrame, evidence: DataFrame, sql_evidence: DataFrame | None = None) -> dict:
    """The single draft's answer, citations and dropped lines; raises NoEvidenceError for a refusal."""
    row = ground(drafts, evidence, sql_evidence).first()
    if row is None or row["status"] == "refused":
        raise NoEvidenceError(REFUSAL)
    return {"answer": row["answer"], "citations": [c.asDict() for c in row["citations"]], "dropped": list(row["dropped"])}


def trace(events: DataFrame) -> DataFrame:
    """answer_id, step, agent, kind, detail of events(answer_id, event_no, agent, kind, detail): calls, results and finals, in order.

    A final's detail is cut; an unnamed agent is `unknown`.
    """
    order = Window.partitionBy("answer_id").orderBy("event_no")
    kept = events.where(F.col("kind").isin("tool_call", "tool_result", "final"))
    detail = F.when(F.col("kind") == "final", F.substring("detail", 1, TRACE_DETAIL)).otherwise(F.col("detail"))
    agent = F.coalesce(_or_null(F.col("agent")), F.lit("unknown"))
    return kept.select("answer_id", F.row_number().over(order).alias("step"), agent.alias("agent"), "kind", detail.alias("detail"))
