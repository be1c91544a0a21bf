"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by path.

All of it is DataFrame functions. Every line of a file is a header that may name a licence; a licence
file is also compared as a whole. Weights are term counts times inverse document frequencies among the
templates; a term of no template weighs as the rarest and counts in a line's length only. A line is
compared once however often it occurs. What a line holds of a template bounds their cosine: lines that hold
too little of every template are left out before they are cut to terms.
Standard headers, titles and whole licence texts are compared with windows of as many terms that start at a
line or sentence, and with licence files as wholes; their term counts are damped by logarithms. SPDX tags are
read as such. Both say more than the short forms and outrank them.
A file without a licence of its own has that of the licence files in the
nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm._shared import saved
from spindrift.llm.licence_forms import long_forms

LEAST = 0.75
#: Terms of templates that any text holds.
COMMON = {"all", "by", "is", "of", "terms", "the", "this", "to", "under", "work"}
#: Windows for a template start in steps of this part of its terms, or at every line and sentence where those are longer.
STEPS = 32

# SPDX identifiers, and short forms in which texts state those licences.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
]
#: An SPDX tag's expression, and the ends of identifiers that leave the licence as it is.
SPDX = r"spdx-license-identifier:[ \t]*(\(*[a-z0-9.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9.+-]+\)*)*)"
SPDX_END = r"(-only|-or-later|\+)$"
#: A copyright notice before the words that reserve all rights; its year and holder are fields.
NOTICE = r"copyright\b(?:(?!licen[cs]e).){0,120}?\ball rights reserved"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([-._].*)?$"


class Weights:
    """Inverse frequencies of the templates' terms, and the templates' unit vectors."""

    def __init__(self, templates: list[tuple[str, str]], damped: bool = False) -> None:
        self.names = [name for name, _ in templates]
        counts = [Counter(re.findall(r"[a-z0-9]+", text.lower())) for _, text in templates]
        self.sizes = [sum(c.values()) for c in counts]
        held = Counter(t for c in counts for t in c)
        self.unseen = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in sorted(held.items())}
        self.vectors = []
        for c in counts:
            v = {t: (1 + math.log(n) if damped else n) * self.idf[t] for t, n in c.items()}
            length = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append({t: x / length for t, x in v.items()})

    def fewest(self, least: float) -> list[int]:
        """For each template, the fewest of its terms with which a text can have the least cosine."""
        out = []
        for v in self.vectors:
            squares, n, held = sorted((x * x for x in v.values()), reverse=True), 0, 0.0
            while n < len(squares) and held < least * least - 1e-9:
                held, n = held + squares[n], n + 1
            out.append(n)
        return out


def _cost(term: str) -> float:
    """About how often a term is part of some word of a line."""
    return 100.0 if term in COMMON else 30.0 if len(term) < 3 else 5.0 if len(term) == 3 else 1.0


def gate(weights: Weights, least: float) -> list[str]:
    """A few terms of which a text must hold one, as parts of words at least, to reach the least cosine with any template.

    Without them all, what is left of each template is too little. Terms that serve many templates and are in few
    texts come first.
    """
    need = 1 - least * least + 1e-9
    held = lambda terms: [sum(x * x for t, x in v.items() if any(s in t for s in terms)) for v in weights.vectors]
    cover = {s: held([s]) for s in weights.idf}
    out: list[str] = []
    while min(held(out)) < need and len(out) < len(cover):
        missing = [max(need - h, 0) for h in held(out)]
        gain = {s: sum(min(c, m) for c, m in zip(cs, missing)) / _cost(s) for s, cs in cover.items() if s not in out}
        out.append(max(sorted(gain), key=gain.__getitem__))
    for s in sorted(out, key=lambda s: (-_cost(s), s)):  # what the later ones made needless
        if min(held([x for x in out if x != s])) >= need:
            out.remove(s)
    return out if min(held(out)) >= need else list(weights.idf)


def _any_of(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def _may_reach(line: Column, weights: Weights, least: float) -> Column:
    """Whether the terms of some template that a lower-case line holds, as parts of words at least, can make the least cosine."""
    out = F.lit(False)
    for v in weights.vectors:
        held = F.lit(0.0)
        for t, x in v.items():
            held = held + F.when(F.contains(line, F.lit(t)), x * x).otherwise(0.0)
        out = out | (held >= least * least - 1e-9)
    return _any_of(line, gate(weights, least)) & out


def _folder(path: Column) -> Column:
    """The directory of a path, '' for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def own_licences(files: DataFrame, weights: Weights, least: float) -> DataFrame:
    """key, similarity double, template int: the best template of each file that reaches the least cosine."""
    text = F.lower("text")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)
    whole = F.when(named, F.array(F.regexp_replace(text, "\n", " "))).otherwise(F.array().cast("array<string>"))
    units = files.where(_any_of(text, gate(weights, least))).select("key", F.explode(F.concat(F.split(text, "\n", -1), whole)).alias("unit"))
    units = saved(units.where(_may_reach(F.col("unit"), weights, least)), "units")
    units = units.withColumn("unit", F.regexp_replace("unit", NOTICE, "all rights reserved")).withColumn("id", F.md5("unit"))
    spark = files.sparkSession
    entries = {t: [(k, v[t]) for k, v in enumerate(weights.vectors) if t in v] for t in weights.idf}
    table = F.broadcast(spark.createDataFrame([(t, weights.idf[t], entries[t]) for t in weights.idf], "term string, idf double, entries array<struct<template:int,weight:double>>"))  # the templates' terms
    known = F.lit(sorted(weights.idf))
    cut = F.filter(F.split("unit", "[^a-z0-9]+"), lambda x: x != "")
    cut = units.groupBy("id").agg(F.first("unit").alias("unit")).select("id", cut.alias("terms"))
    cut = cut.select("id", "terms", F.filter("terms", lambda x: F.array_contains(known, x)).alias("own"))
    # products with templates need the templates' terms only; with one for each other term, lengths are at least these
    counts = cut.select("id", (F.size("terms") - F.size("own")).alias("others"), F.explode("own").alias("term")).groupBy("id", "others", "term").agg(F.count("*").cast("double").alias("n"))
    weighed = counts.join(table, "term").withColumn("x", F.col("n") * F.col("idf"))
    squares = weighed.groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.first("others").alias("others"))
    products = weighed.select("id", "x", F.explode("entries").alias("e")).groupBy("id", F.col("e.template").alias("template")).agg(F.sum(F.col("x") * F.col("e.weight")).alias("product"))
    most = F.col("product") / F.sqrt(F.col("square") + F.col("others") * F.lit(weights.unseen**2))
    near = saved(products.join(squares, "id").where(most >= least - 1e-6).select("id", "template", "product", "square"), "near")
    rest = cut.join(near.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.filter("terms", lambda x: ~F.array_contains(known, x))).alias("term"))
    rest = rest.groupBy("id", "term").agg(F.count("*").cast("double").alias("n")).groupBy("id").agg(F.sum(F.col("n") * F.col("n") * F.lit(weights.unseen**2)).alias("rest"))
    cosine = F.round(F.col("product") / F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0))), 9)
    scored = near.join(rest, "id", "left").select("id", cosine.alias("similarity"), "template").where(F.col("similarity") >= least)
    best = scored.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("template")).alias("last"))).alias("best"))
    return units.select("key", "id").join(best, "id").groupBy("key").agg(F.max("best").alias("best")).select("key", "best.similarity", (-F.col("best.last")).alias("template"))


def long_licences(files: DataFrame, weights: Weights, least: float) -> DataFrame:
    """key, similarity double, template int: the best long form of each file that reaches the least cosine.

    A text that holds fewer terms of a template than any with that cosine is left out, as is such a window.
    """
    fewest, terms = weights.fewest(least), [sorted(v) for v in weights.vectors]
    known = ", ".join(f"'{t}'" for t in sorted(weights.idf))
    held = F.expr(f"array_distinct(filter(split(lower(text), '[^a-z0-9]+'), x -> x in ({known})))")
    named = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False))
    may = [F.when((F.size("held") >= n) & (F.size(F.array_intersect(F.lit(t), F.col("held"))) >= n), F.lit(k)) for k, (n, t) in enumerate(zip(fewest, terms))]
    # an array of one value, exploded, is evaluated once
    texts = files.select("key", "text", named.alias("named"), held.alias("held")).select("key", "text", "named", "held", F.explode(F.array(F.array_compact(F.array(*may)))).alias("templates"))
    texts = saved(texts.where(F.size("templates") > 0), "texts")
    # the root of the squared weights of the terms that a text holds bounds all cosines in it
    spark = files.sparkSession
    entries = {t: [(k, v[t] * v[t]) for k, v in enumerate(weights.vectors) if t in v] for t in weights.idf}
    shares = F.broadcast(spark.createDataFrame(list(entries.items()), "term string, entries array<struct<template:int,square:double>>"))  # the templates' terms
    sums = texts.select("key", F.explode("held").alias("term")).join(shares, "term").select("key", F.explode("entries").alias("e")).groupBy("key", "e.template").agg(F.sum("e.square").alias("square"))
    fits = saved(sums.where(F.col("square") >= least * least - 1e-9).groupBy("key").agg(F.collect_set("template").alias("fits")), "fits")
    texts = texts.join(fits, "key").select("key", "text", "named", F.array_intersect("templates", "fits").alias("templates"))
    # the first term of each line and sentence is marked
    marked = F.regexp_replace(F.translate(F.lower("text"), "\x01", " "), r"(^|\n|[.!?;:]\s)[^a-z0-9]*", " \x01")
    cut = F.filter(F.split(marked, "[^a-z0-9\x01]+"), lambda x: ~x.isin("", "\x01"))
    cut = texts.select("key", "named", "templates", F.explode(F.array(cut)).alias("marked"))
    starts = F.filter(F.transform("marked", lambda x, i: F.when(x.startswith("\x01"), i)), lambda i: i.isNotNull())
    cut = saved(cut.select("key", "named", "templates", F.transform("marked", lambda x: F.translate(x, "\x01", "")).alias("terms"), starts.alias("starts")), "terms")
    of = lambda values: F.element_at(F.lit(values), F.col("template") + 1)
    cut = cut.select("key", "named", "terms", "starts", F.explode("templates").alias("template")).withColumn("n", of(weights.sizes))
    step = F.greatest(F.floor(F.col("n") / STEPS), F.lit(1))
    some = F.filter("starts", lambda p, i: F.when(i == 0, True).otherwise(F.floor(p / step) != F.floor(F.get("starts", i - 1) / step)))
    whole = F.when(F.col("named") & (F.size("terms") > 0), F.array(F.struct(F.lit(1).alias("a"), F.size("terms").alias("n")))).otherwise(F.array().cast("array<struct<a:int,n:int>>"))
    spans = F.concat(F.transform(some, lambda p: F.struct((p + 1).alias("a"), F.col("n").alias("n"))), whole)
    windows = cut.select("key", "template", "terms", F.explode(F.array(spans)).alias("spans")).select("key", "template", "terms", F.explode("spans").alias("s"))
    windows = windows.select("key", "template", F.slice("terms", F.col("s.a"), F.col("s.n")).alias("window"))
    windows = windows.where(F.size(F.array_intersect("window", of(terms))) >= of(fewest)).withColumn("id", F.md5(F.array_join("window", " ")))
    windows = saved(windows, "windows")
    table = F.broadcast(spark.createDataFrame([(t, x, [v.get(t, 0.0) for v in weights.vectors]) for t, x in weights.idf.items()], "term string, idf double, weights array<double>"))
    once = windows.groupBy("template", "id").agg(F.first("window").alias("window")).select("template", "id", F.explode("window").alias("term"))
    counts = once.groupBy("template", "id", "term").agg((1 + F.log(F.count("*"))).alias("n")).join(table, "term", "left")
    x = F.col("n") * F.coalesce("idf", F.lit(weights.unseen))
    weighed = counts.select("template", "id", x.alias("x"), F.coalesce(F.element_at("weights", F.col("template") + 1), F.lit(0.0)).alias("weight"))
    cosine = F.round(F.sum(F.col("x") * F.col("weight")) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 9)
    scored = weighed.groupBy("template", "id").agg(cosine.alias("similarity")).where(F.col("similarity") >= least)
    best = windows.select("key", "template", "id").join(scored, ["template", "id"]).groupBy("key").agg(F.max(F.struct("similarity", (-F.col("template")).alias("last"))).alias("best"))
    return best.select("key", "best.similarity", (-F.col("best.last")).alias("template"))


def tagged(files: DataFrame, names: list[str]) -> DataFrame:
    """key, similarity double, template int: the first of a file's SPDX identifiers that is among names; its similarity is 1."""
    tags = F.regexp_extract_all(F.lower("text"), F.lit(SPDX), 1)
    ids = F.transform(F.flatten(F.transform(tags, lambda x: F.split(x, r"[ \t()]+"))), lambda x: F.regexp_replace(x, SPDX_END, ""))
    places = F.filter(F.transform(ids, lambda x: F.array_position(F.lit([n.lower() for n in names]), x)), lambda i: i > 0)
    found = files.where(F.lower("text").contains("spdx-license-identifier")).select("key", (F.get(places, 0) - 1).cast("int").alias("template"))
    return found.where("template is not null").select("key", F.lit(1.0).alias("similarity"), "template")


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """files without text, and license string, similarity double, origin string, from_dir string.

    files has path and text. license is the template with the largest cosine of at least `least` among the
    file's lines (for a licence file also its whole text), the first in the list at a tie: origin is `own`.
    With the templates of this module, an SPDX tag outranks all else, and a long form that reaches `least` all lines.
    Else it is that of the directory nearest above, the file's own one included, whose licence files have
    one (the most similar, then the first in the list): origin is `inherited`, from_dir that directory. Else
    license, similarity and from_dir are null and origin is `none`. Directories end at `/`; a bare name is in
    ''. A null path inherits nothing; a null or empty text has no licence of its own. Repeated rows come
    repeatedly; other columns stay, but those named as the new ones, which are replaced. No rows give no rows.
    """
    weights = Weights(templates or TEMPLATES)
    names = weights.names
    new = ("license", "similarity", "origin", "from_dir")
    kept = [c for c in files.columns if c not in (*new, "text")]
    # the caller's columns travel as one, so none of their names meets one from here
    mine = F.struct(*(files[f"`{c}`"].alias(c) for c in kept)).alias("own")
    keyed = files.select(mine, F.col("path"), F.col("text").cast("string").alias("text"), F.xxhash64("path", "text").alias("key"))
    texts = keyed.where("text is not null").select("path", "text", "key")
    own = own_licences(texts, weights, least).withColumn("rank", F.lit(1))
    if not templates:
        long = Weights(long_forms(), damped=True)
        found = long_licences(texts, long, least).withColumn("template", F.col("template") + len(names)).withColumn("rank", F.lit(2))
        own = own.unionByName(found).unionByName(tagged(texts, names).withColumn("rank", F.lit(3)))
        own = own.groupBy("key").agg(F.max(F.struct("rank", "similarity", (-F.col("template")).alias("last"))).alias("best"))
        own = own.select("key", "best.rank", "best.similarity", (-F.col("best.last")).alias("template"))
        names = names + long.names
    slim = keyed.select(F.col("own").alias("mine"), "path", F.col("key").alias("__key"))
    with_own = slim.join(own.select(F.col("key").alias("__key"), F.col("similarity").alias("__own"), F.col("template").alias("__template"), F.col("rank").alias("__rank")), "__key", "left")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE)
    folders = with_own.where(named & F.col("__template").isNotNull()).groupBy(_folder(F.col("path")).alias("__dir")).agg(F.max(F.struct(F.col("__rank").alias("r"), F.col("__own").alias("s"), (-F.col("__template")).alias("t"))).alias("__best"))
    # every directory with each above it
    parts = F.split("__folder", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    with_own = with_own.withColumn("__folder", _folder(F.col("path")))
    inner = with_own.where("__template is null and path is not null").select("__folder").distinct()
    chains = inner.select("__folder", F.explode(F.array_distinct(above)).alias("__dir"))
    nearest = chains.join(folders, "__dir").groupBy("__folder").agg(F.max(F.struct(F.length("__dir").alias("n"), "__dir", "__best")).alias("__from"))
    out = with_own.join(nearest, "__folder", "left")
    names = F.lit(names)
    own_name = F.when(F.col("__template").isNotNull(), F.element_at(names, F.col("__template") + 1))
    from_name = F.when(F.col("__from").isNotNull(), F.element_at(names, 1 - F.col("__from.__best.t")))
    inherits = F.col("__template").isNull()
    return out.select(
        *(F.col("mine").getField(c).alias(c) for c in kept),
        F.coalesce(own_name, from_name).alias("license"),
        F.coalesce("__own", F.col("__from.__best.s")).alias("similarity"),
        F.when(~inherits, "own").when(F.col("__from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("__from.__dir")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: documents have no paths, so their source and the digits of doc_id make some.

    A directory for each source, in it one for each 1,000 doc_ids and in that for each 100; one in ten
    documents is its directory's licence file. A null doc_id has its source alone as path.
    """
    number = F.col("doc_id")
    name = F.when(number % 10 == 0, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def _oracle() -> str:
    w = Weights(TEMPLATES)
    idf = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in w.idf.items())
    entries = ", ".join(f"('{t}', {k}, {x!r}::DOUBLE)" for k, v in enumerate(w.vectors) for t, x in v.items())
    names = ", ".join(f"'{n}'" for n in w.names)
    return rf"""
WITH idf(term, idf) AS (VALUES {idf}), entries(term, template, weight) AS (VALUES {entries}),
files AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS name,
          coalesce(source, 'none') || '/' || (doc_id // 1000) AS top, coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS dir FROM documents),
units AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS unit FROM files UNION ALL SELECT doc_id, replace(lower(text), chr(10), ' ') FROM files WHERE name LIKE 'LICENSE%'),
terms AS (SELECT unit, unnest(regexp_extract_all(unit, '[a-z0-9]+')) AS term FROM (SELECT DISTINCT unit FROM units)),
counts AS (SELECT unit, term, count(*)::DOUBLE AS n FROM terms GROUP BY unit, term),
weighed AS (SELECT unit, c.term, n * coalesce(idf, {w.unseen!r}::DOUBLE) AS x FROM counts c LEFT JOIN idf USING (term)),
lengths AS (SELECT unit, sqrt(sum(x * x)) AS length FROM weighed GROUP BY unit),
products AS (SELECT unit, template, sum(x * weight) AS product FROM weighed JOIN entries USING (term) GROUP BY unit, template),
scored AS (SELECT unit, template, round(product / length, 9) AS similarity FROM products JOIN lengths USING (unit)),
own AS (SELECT doc_id, template, similarity FROM (SELECT doc_id, template, similarity, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, template) AS k
        FROM units JOIN scored USING (unit) WHERE similarity >= {LEAST}) WHERE k = 1),
full_files AS (SELECT f.doc_id, name, top, dir, coalesce(source, 'none') AS root, template, similarity FROM files f JOIN documents USING (doc_id) LEFT JOIN own ON f.doc_id = own.doc_id),
best AS (SELECT dir, template, similarity FROM (SELECT dir, template, similarity, row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, template) AS k
         FROM full_files WHERE name LIKE 'LICENSE%' AND template IS NOT NULL) WHERE k = 1)
SELECT f.doc_id, dir || '/' || name AS path, list_extract([{names}], 1 + coalesce(f.template, b.template)) AS license, coalesce(f.similarity, b.similarity) AS similarity,
  CASE WHEN f.template IS NOT NULL THEN 'own' WHEN b.template IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN f.template IS NULL AND b.template IS NOT NULL THEN dir END AS from_dir
FROM full_files f LEFT JOIN best b USING (dir)
"""


ORACLE_SQL = _oracle()
