"""Full-text analysis: two analyzers, web-style queries, matching and cover-density ranking.

`simple` lower-cases runs of letters and digits. `english` also drops stop words and stems (Porter 1980).
A query is words that all must occur, with "quoted phrases", `or` between alternatives and a leading `-`
for words that must not. The rank sums, over the minimal stretches of positions that hold all words of an
alternative, one over their length (Clarke, Cormack and Tudhope 2000).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindrift.functions import text as T

# Frequent English words that carry no meaning of their own in a search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now""".split()
)

#: The most words with wanted stems that go to every task as one table.
MOST_NAMES = 100_000
_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return i == 0 or not _consonant(w, i - 1) if w[i] == "y" else True


def _measure(w: str) -> int:
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


# Porter's suffix tables of 1980, steps 2 to 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, ends) -> str:
    return max((e for e in ends if w.endswith(e)), key=len, default="")


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words that aren't of a to z stay as they are."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (end := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (end := _longest(w, table)) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    if (end := _longest(w, _STEP4)) and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@dataclass(frozen=True)
class Phrase:
    """Terms at relative places; of one term, a word."""

    terms: tuple[tuple[str, int], ...]
    wanted: bool = True


def _plain(text: str) -> list[tuple[str, int]]:
    return [(w, i) for i, w in enumerate(re.findall(r"[^\W_]+", text.lower()), 1)]


def _english(text: str) -> list[tuple[str, int]]:
    return [(stem(w), i) for w, i in _plain(text) if w not in STOP_WORDS]


#: Analyzers: terms of a text with their positions from 1; dropped words leave their positions.
ANALYZERS: dict[str, Callable[[str], list[tuple[str, int]]]] = {"simple": _plain, "english": _english}


def parse_query(query: str, analyzer: str = "english") -> list[list[Phrase]]:
    """Alternatives, each a list of phrases; empty where nothing of the query is left."""
    analyze = ANALYZERS[analyzer]
    out: list[list[Phrase]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if not quoted and not minus and word.lower() == "or":
            out.append([])
            continue
        wanted = not (minus or word.startswith("-"))
        terms = analyze(quoted or word)
        if terms:
            first = terms[0][1]
            out[-1].append(Phrase(tuple((t, i - first) for t, i in terms), wanted))
    return [x for x in out if any(p.wanted for p in x)]


def term_positions(text: Column, analyzer: str = "simple") -> Column:
    """map<string, array<int>>: the positions of a text's terms, from 1, in Arrow batches: one pass over each text."""

    @F.pandas_udf("map<string, array<int>>")
    def positions(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found: dict[str, list[int]] = {}
            for term, i in ANALYZERS[analyzer](t or ""):
                found.setdefault(term, []).append(i)
            out.append(found)
        return pd.Series(out)

    return positions(text)


def _followed(other: Column, shift: int) -> Callable[[Column], Column]:
    return lambda i: F.array_contains(other, i + shift)


def _up_to(e: Column) -> Callable[[Column], Column]:
    return lambda i: i <= e


def _stretch(places: Column) -> Callable[[Column], Column]:
    """The shortest stretch that ends at e and holds a place of each list, if there is one."""

    def start(e: Column) -> Column:
        latest = F.transform(places, lambda p: F.array_max(F.filter(p, _up_to(e))))
        complete = ~F.exists(latest, lambda x: x.isNull())
        return F.when(complete, F.struct(F.array_min(latest).alias("s"), e.alias("e")))

    return start


def _minimal(stretches: Column) -> Column:
    """Of stretches by their ends, the first from each start."""
    return F.filter(stretches, lambda x, i: (i == 0) | (F.get(stretches, i - 1)["s"] < x["s"]))


def _starts(positions: Column, phrase: Phrase) -> Column:
    """Where a phrase starts, given a map of positions."""
    none = F.array().cast("array<int>")
    term, _ = phrase.terms[0]
    at = F.coalesce(F.try_element_at(positions, F.lit(term)), none)
    for t, shift in phrase.terms[1:]:
        other = F.coalesce(F.try_element_at(positions, F.lit(t)), none)
        at = F.filter(at, _followed(other, shift))
    return at


def matches(positions: Column, query: list[list[Phrase]]) -> Column:
    """Whether a map of positions satisfies a parsed query; a query of nothing matches nothing."""
    found = F.lit(False)
    for alternative in query:
        good = F.lit(True)
        for phrase in alternative:
            there = F.size(_starts(positions, phrase)) > 0
            good = good & (there if phrase.wanted else ~there)
        found = found | good
    return found


def density(places: Column) -> Column:
    """The sum of 1 / length over the minimal stretches that hold a place of each list of array<array<int>>, rounded to 9 decimals.

    A stretch ends at each place; it starts at the smallest of the lists' last places up to there. Only the
    first stretch from each start is minimal.
    """
    ends = F.array_sort(F.array_distinct(F.flatten(places)))
    stretches = F.filter(F.transform(ends, _stretch(places)), lambda x: x.isNotNull())
    return F.round(F.aggregate(_minimal(stretches), F.lit(0.0), lambda t, x: t + F.lit(1.0) / (x["e"] - x["s"] + 1)), 9)


def cover_density(positions: Column, query: list[list[Phrase]]) -> Column:
    """The density() of the wanted phrases' starts, of the best alternative; 0 for a query of nothing."""
    scores = [density(F.array(*(_starts(positions, p) for p in alternative if p.wanted))) for alternative in query]
    if not scores:
        return F.lit(0.0)
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def query_terms(queries: DataFrame, analyzer: str = "english") -> DataFrame:
    """query_id, alt, phrase, wanted, term, shift, size, needed: the terms of queries(query_id, query_text), parsed.

    size is the number of the phrase's terms, needed that of the alternative's wanted phrases. A query of
    nothing has no rows.
    """

    @F.pandas_udf("array<struct<alt:int,phrase:int,wanted:boolean,term:string,shift:int,size:int,needed:int>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[
            (a, p, phrase.wanted, term, shift, len(phrase.terms), sum(x.wanted for x in alternative))
            for a, alternative in enumerate(parse_query(text or "", analyzer)) for p, phrase in enumerate(alternative) for term, shift in phrase.terms
        ] for text in texts])

    return queries.select("query_id", F.explode(parsed(F.col("query_text"))).alias("x")).select("query_id", "x.*")


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def word_rows(texts: DataFrame, key: list[str], text: str, wanted: DataFrame, analyzer: str = "english") -> DataFrame:
    """key, term, positions array<int>: where texts have the terms of wanted(term), from 1, as term_positions() would say.

    Words are cut by built-in functions. Under `english` only the distinct words of all texts are stemmed, in
    Python; words whose stems are wanted are looked up.
    """
    if analyzer not in ANALYZERS:
        raise ValueError(f"no analyzer {analyzer}")
    if analyzer == "simple":
        names = wanted.select(F.col("term").alias("word"), "term")
    else:
        words = texts.select(F.explode(F.array_distinct(T.terms(F.col(text)))).alias("word")).distinct().where(~F.col("word").isin(sorted(STOP_WORDS)))
        names = words.withColumn("term", _stems("word")).join(wanted, "term").select("word", "term")
        few = names.limit(MOST_NAMES + 1).collect()
        if len(few) <= MOST_NAMES:  # else the join shuffles
            names = F.broadcast(texts.sparkSession.createDataFrame(few, "word string, term string"))
    rows = texts.select(*key, F.posexplode(T.terms(F.col(text))).alias("i", "word")).join(names, "word")
    return rows.groupBy(*key, "term").agg(F.array_sort(F.collect_list(F.col("i") + 1)).alias("positions"))
