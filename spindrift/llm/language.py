"""Language identification of mixed text.

A word is a run of letters (and marks). Its script, by Unicode ranges, narrows the languages that can
have written it; among those it gets a log-likelihood for each from its letter trigrams and from itself
as a whole. Viterbi then labels all words of a text, with a penalty for every switch of language, which
gives the spans of each language. A text's language is the one with most letters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._words import U64, mix

#: Training documents for each language, the most languages (each is 0.8 MB of sums on the driver), and the natural logarithm that a switch costs.
SAMPLE, MOST_LANGUAGES, SWITCH = 600, 100, 14.0
#: The most bytes of text that a language learns from: a task holds them.
SAMPLE_BYTES = 64 << 20
_TRIGRAMS, _WORDS = 1 << 16, 1 << 17
_CHUNK = 250_000
#: Parts of a language whose first documents are found apart.
_PARTS = 16
_OFF = np.float32(-400.0)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def scripts() -> tuple[np.ndarray, list[str]]:
    """For every code point the number of its script, 0 for what is neither letter nor mark; the scripts' names.

    The script is the first word of a letter's Unicode name; marks belong to any script (number 1).
    """
    names, numbers = ["", "MARK"], {"": 0, "MARK": 1}
    out = np.zeros(sys.maxunicode + 2, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "M":
            out[cp] = 1
        elif kind[0] == "L":
            name = unicodedata.name(chr(cp), "OTHER").split(" ")[0].split("-")[0]
            if name not in numbers and len(names) < 250:
                numbers[name] = len(names)
                names.append(name)
            out[cp] = numbers.get(name, 2)
    return out, names


class Words:
    """The words of some texts: the letters' trigram buckets, the words' buckets, bounds and scripts."""

    def __init__(self, texts: list[str]) -> None:
        table, _ = scripts()
        texts = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        x = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        kind = table[np.minimum(x, sys.maxunicode + 1)]
        letter = kind > 0
        # runs of letters
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        y = np.where(letter, x, 0).astype(U64)
        self.at = np.flatnonzero(letter)
        before = np.concatenate([[U64(0)], y[:-1]])[self.at]
        after = np.concatenate([y[1:], [U64(0)]])[self.at]
        h = before * U64(0x9E3779B97F4A7C15) + y[self.at] * U64(0xC2B2AE3D27D4EB4F) + after * U64(0x165667B19E3779F9)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        self.trigram = (h >> U64(48)).astype(np.int64)
        first = np.searchsorted(self.at, self.starts)
        self.first = first
        whole = np.add.reduceat(mix(h, 2), first) if len(first) else np.zeros(0, U64)
        self.word = (mix(whole, 4) >> U64(47)).astype(np.int64)
        self.script = np.maximum.reduceat(kind[self.at], first) if len(first) else np.zeros(0, np.uint8)
        self.script = np.where(self.script == 1, 0, self.script)  # marks alone say nothing
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], ends]))
        self.offsets = np.concatenate([[0], ends])


class Model:
    """Log-probabilities by language, and the scripts of each."""

    def __init__(self, langs: list[str], trigrams: np.ndarray, words: np.ndarray, script_counts: np.ndarray, switch: float = SWITCH) -> None:
        self.langs, self.switch = langs, switch
        if not langs:
            return

        def logs(counts: np.ndarray) -> np.ndarray:
            p = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]))
            return np.ascontiguousarray(p.T.astype(np.float32))

        self.trigrams, self.words = logs(trigrams), logs(words)
        share = script_counts / np.maximum(script_counts.sum(axis=1, keepdims=True), 1)
        uses = share >= 0.01
        self.off = np.where(uses, np.float32(0), _OFF).T.astype(np.float32)
        self.off[~uses.any(axis=0)] = 0  # a script of no language excludes none
        self.seen = uses.any(axis=0)

    def scores(self, w: Words) -> np.ndarray:
        """A row of log-likelihoods for each word; equal ones for a word of an unknown script."""
        if not len(w.starts):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.trigrams[w.trigram], w.first, axis=0)
        out += self.words[w.word]
        out += self.off[w.script]
        out[~self.seen[w.script]] = 0
        return out - out.max(axis=1, keepdims=True)

    def paths(self, w: Words) -> np.ndarray:
        """The best label of every word: Viterbi with a constant penalty for a switch.

        A path with n switches has n + 1 stretches, so it can beat the best single language only if some stretch
        gains more than n / (n + 1), that is half a penalty at least, over it. Texts without such a stretch have that
        language throughout, which sums find for all texts at once; only others go word by word.
        """
        s = self.scores(w)
        path = np.zeros(len(s), np.int64)
        rows = np.flatnonzero(np.diff(w.bounds) > 0)
        if not len(rows):
            return path
        starts, counts = w.bounds[rows], np.diff(w.bounds)[rows]
        best = np.add.reduceat(s.astype(np.float64), starts, axis=0).argmax(axis=1)
        of = np.repeat(np.arange(len(rows)), counts)
        path[:] = best[of]
        gain = np.zeros(len(rows))
        own = s[np.arange(len(s)), path].astype(np.float64)
        span = float(np.abs(s).sum(axis=1).max() * (counts.max() + 1) * 4 + 1)
        for k in range(len(self.langs)):
            d = np.cumsum(s[:, k] - own)
            base = np.concatenate([[0.0], d])[starts]
            d -= base[of]
            low = np.minimum.accumulate(np.minimum(np.concatenate([[0.0], d[:-1]]) * (np.concatenate([[-1], of[:-1]]) == of), 0) - span * of) + span * of
            gain = np.maximum(gain, np.maximum.reduceat(d - low, starts))
        for r in np.flatnonzero(gain >= self.switch / 2 - 1e-3):
            a, b = starts[r], starts[r] + counts[r]
            path[a:b] = viterbi(s[a:b], self.switch)
        return path


def viterbi(s: np.ndarray, switch: float) -> list[int]:
    """The labels of the best path through the rows of s; a tie keeps the label before, then the smallest one."""
    rows, back = s.tolist(), []
    v = list(rows[0])
    ks = range(len(v))
    for row in rows[1:]:
        top = max(v)
        where, floor = v.index(top), top - switch
        back.append([k if v[k] >= floor else where for k in ks])
        v = [(x if x >= floor else floor) + y for x, y in zip(v, row)]
    k = v.index(max(v))
    out = [k]
    for b in reversed(back):
        k = b[k]
        out.append(k)
    return out[::-1]


def fit(labelled: DataFrame, per_language: int = SAMPLE, switch: float = SWITCH) -> Model:
    """A model of labelled(doc_id, text, lang): of at most per_language documents and SAMPLE_BYTES of text of each language.

    The sample is the first of each language by md5 of doc_id, so it is the same at every run. Rows with a
    null doc_id, text or lang teach nothing. A doc_id that a language has several times teaches it one text, that with
    the smallest md5. Only the sample's texts and sums by language are moved.
    """
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ids = labelled.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang").distinct()
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = ids
    for group in (["lang", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS))], ["lang"]):  # the first of each part, and of those the first
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("n") <= per_language).select("doc_id", "lang")
    texts = labelled.where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most per_language x languages ids
    texts = texts.groupBy("doc_id", "lang").agg(F.min(F.struct(F.md5("text").alias("h"), "text")).alias("own")).select("doc_id", "lang", F.col("own.text").alias("text"))
    before = Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    texts = texts.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).where(F.col("bytes") <= SAMPLE_BYTES).drop("bytes")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        sums = [np.zeros(_TRIGRAMS, np.int64), np.zeros(_WORDS, np.int64), np.zeros(256, np.int64)]
        for part in _parts(rows["text"]):
            w = Words(part)
            for total, found in zip(sums, (w.trigram, w.word, w.script)):
                total += np.bincount(found, minlength=len(total))
        return pa.table({"lang": [key[0].as_py()], **{n: pa.array([s.astype(np.int32).tobytes()], pa.binary()) for n, s in zip(("trigrams", "words", "scripts"), sums)}})

    found = texts.groupBy("lang").applyInArrow(count, "lang string, trigrams binary, words binary, scripts binary").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def matrix(name: str) -> np.ndarray:
        return np.array([np.frombuffer(r[name], np.int32) for r in found], np.float64) if found else np.zeros((0, 1))

    return Model([r["lang"] for r in found], matrix("trigrams"), matrix("words"), matrix("scripts"), switch)


def _parts(column: pa.Array | pa.ChunkedArray) -> Iterator[list[str]]:
    """Texts in lists of about _CHUNK characters, one text at least; null counts as empty."""
    part, size = [], 0
    for i in range(0, len(column), 64):
        for t in column.slice(i, 64).to_pylist():
            part.append(t or "")
            size += len(part[-1])
            if size > _CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def _mapped(docs: DataFrame, model: Model, schema: str, make) -> DataFrame:
    """The rows of docs, which has text, with the columns that make() gives."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            for part in _parts(batch.column(text)):
                w = Words(part)
                path = model.paths(w) if model.langs else np.zeros(len(w.starts), np.int64)
                names, columns = make(w, path, len(part))
                own = batch.slice(i, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*own.schema.names, *names])
                i += len(part)

    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{own}, {schema}")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred string, score double, n_spans int of every whole text.

    lang_pred is the language with most letters, the first by name at a tie; score is its share of the
    letters. A null text and one without letters have `und` and 0, and so has every text under a model
    of no language. doc_id is passed through, nulls and repeats as well; other columns are left out;
    no rows give no rows.
    """
    return annotate(_texts(docs), model).drop("text")


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with predict()'s columns; columns of those names are replaced. No shuffle."""

    def make(w: Words, path: np.ndarray, rows: int) -> tuple[list[str], list[pa.Array]]:
        langs = model.langs or [UNKNOWN]
        length = np.where(w.script > 0, w.ends - w.starts, 0)
        of = np.repeat(np.arange(rows), np.diff(w.bounds))
        total = np.bincount(of * len(langs) + path, length, rows * len(langs)).reshape(rows, len(langs))
        best, letters = total.argmax(axis=1), total.sum(axis=1)
        score = np.where((letters > 0) & bool(model.langs), total.max(axis=1) / np.maximum(letters, 1), 0.0)
        starts = np.ones(len(path), bool)
        starts[1:] = (path[1:] != path[:-1]) | (of[1:] != of[:-1])
        pred = [langs[k] if n else UNKNOWN for k, n in zip(best, letters)]
        spans = np.bincount(of[starts], minlength=rows).astype(np.int32)
        return ["lang_pred", "score", "n_spans"], [pa.array(pred, pa.string()), pa.array(score), pa.array(spans)]

    return _mapped(docs.drop("lang_pred", "score", "n_spans"), model, "lang_pred string, score double, n_spans int", make)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans: the stretches of one language of every whole text, in order.

    Each is a struct of start and end (positions in the lower-cased text, from its first word's start to
    its last word's end) and lang. Null texts and texts without letters have none; the rest is as in predict().
    """

    def make(w: Words, path: np.ndarray, rows: int) -> tuple[list[str], list[pa.Array]]:
        out = []
        for r in range(rows):
            a, b = w.bounds[r], w.bounds[r + 1]
            p = path[a:b]
            cut = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) and model.langs else [0]
            out.append([{"start": int(w.starts[a + i] - w.offsets[r]), "end": int(w.ends[a + j - 1] - w.offsets[r]), "lang": model.langs[p[i]]} for i, j in zip(cut[:-1], cut[1:])])
        return ["spans"], [pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]

    return _mapped(_texts(docs), model, "spans array<struct<start:int,end:int,lang:string>>", make).drop("text")
