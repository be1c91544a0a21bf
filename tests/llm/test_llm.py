"""The ten corpus operators against plain versions, and on awkward rows."""

import base64
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import _shared, byte_bpe, fingerprints, language, licenses, lm_score, mixing, ngram_join, quality, rotated_codes, template_lines
from spindrift.llm._shared import components

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(80)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 20, 60, 200]))) for _ in range(n)]
    for i in range(0, n // 2, 3):  # near copies, some of them close to the threshold
        w = texts[i].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts[n - 1 - i] = " ".join(w)
    return texts + [texts[0], "", "   ", None, "Ünï 漢字 한국어 \x00 é", texts[1] + "\n" + texts[2]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr")[i % 2], f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- byte-level BPE


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(spark, docs, empty):
    rng = random.Random(2)
    odd = ["", None, "  \n\n x  ", "<|endoftext|>", "a" * 3000, "don't I'LL 1234 ½", "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0xD000), 32])) for _ in range(2000)), "▁ ▁x"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")).withColumn("ids", F.lit("clash"))
    enc = encoding()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in byte_bpe.round_trip(df, VOCABULARY, PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(df, VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == texts
    assert byte_bpe.round_trip(empty, VOCABULARY, PATTERN).count() == 0


def test_bpe_of_odd_rows(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "x" * 70_000), (4, "é" * 3 + "\ud7ff")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(1))
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in byte_bpe.round_trip(df, VOCABULARY, PATTERN).collect()]
    assert got == [(d, len(encoding().encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    some = spark.createDataFrame([(1, [64, None, 65]), (2, None), (None, [])], "doc_id long, ids array<int>")
    assert [(r.doc_id, bytes(r.data)) for r in byte_bpe.decode(some, VOCABULARY, PATTERN).collect()] == [(1, encoding().decode_bytes([64, 65])), (2, b""), (None, b"")]
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), VOCABULARY, PATTERN).collect()


def test_pre_tokens_are_forgotten(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 5)
    c = byte_bpe.Codec(byte_bpe.serialise(byte_bpe.read_ranks(VOCABULARY)), PATTERN)
    for i in range(30):
        text = f"word{i} other{i * i} " + "long" * 50
        assert c.encode(text) == " ".join(map(str, encoding().encode_ordinary(text))) and len(c) <= 5 + 6 and all(len(x) <= byte_bpe.LONGEST for x in c)


# --- fingerprints


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_estimate_similarity(spark, docs, empty):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprints.edited_prints(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        t, n = r.text or "", after.text or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        g = got[r.doc_id]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [g.near_edited - jaccard(shingles(t, 5), shingles(edited, 5)), g.near_next - jaccard(shingles(t, 5), shingles(n, 5))]
        if t == edited:
            assert g.fingerprint == g.edited_fingerprint and g.near_edited == 1
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert plain == {k: v.fingerprint for k, v in got.items()}
    assert fingerprints.edited_prints(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.edited_prints(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.doc_id is None
    twice = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (6, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.near_next) for r in fingerprints.edited_prints(twice).collect()) == [(5, 0.0), (5, 1.0), (6, 0.0)]


def test_fingerprints_of_odd_rows(spark):
    """Null ids among others, clashing columns, repeated rows, and a very long text: every row meets its successor."""
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(None, "a b c d e f"), (None, None), (3, "one two three"), (3, "one two three"), (5, long), (9, long[:-1]), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("look", F.lit(1)).withColumn("fingerprint", F.lit(2))
    got = fingerprints.edited_prints(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        want.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    by = {r.doc_id: r for r in got if r.doc_id and r.doc_id != 3}
    assert by[5].near_next < 0.2 and by[7].near_next < 0.2 and by[5].near_edited > 0.2
    many = spark.createDataFrame([(i * 3, f"text {i}") for i in range(500)], "doc_id long, text string")
    parts = fingerprints.with_next(many, 60).where("not look").groupBy("part").count().collect()
    assert len(parts) > 40 and sum(r["count"] for r in parts) == 500


# --- n-gram join


def brute_components(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("k, num, den, seed", [(4, 85, 100, 1), (5, 80, 100, 2), (1, 70, 100, 3)])
def test_ngram_join_is_exact(spark, k, num, den, seed):
    texts = dict(enumerate(corpus(120, seed)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("node", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, k, num, den).collect()}
    assert got == brute_components(texts, k, num, den)


def test_ngram_join_of_odd_tables(spark, empty):
    assert ngram_join.join(empty).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "x y"), (4, None), (3, " ")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (3, 3), (4, 4)]
    with pytest.raises(ValueError):
        ngram_join.Rule(4, 50, 100)


@pytest.mark.parametrize("block", [2, 7])
def test_ngram_join_in_blocks(spark, block):
    """Groups and clusters far above a block, in chains and stars, give the same components."""
    rng = random.Random(block)
    base = [f"w{i}" for i in range(90)]
    texts = {0: " ".join(base)}
    for i in range(1, 60):  # each is one or two words away from some earlier text, so that some chains drift apart
        words = texts[rng.choice([0, i - 1, rng.randrange(i)])].split()
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {100 + i: " ".join(base[:45] + [f"y{i}_{j}" for j in range(rng.choice([5, 30]))]) for i in range(30)}  # one shared passage
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 85, 100, block=block).collect()}
    want = brute_components(texts, 4, 85, 100)
    assert len({c for _, c in want.values()}) > 20 and got == want


def test_representatives_are_chosen_by_row(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "b"), (1, long, "a"), (1, "quite another text of some words", "c"), (2, long + " x", "d"), (2, "a third text that is on its own", "e")]
    rows += [(None, long, "f"), (None, "no id but words of its own", "g"), (None, "no id but words of its own", "g"), (3, None, "h"), (3, None, "h"), (4, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("label", F.lit(1))
    got = sorted((r.doc_id or -1, r.source, r.label) for r in ngram_join.representatives(docs).collect())
    assert got == [(-1, "g", 1), (1, "a", 1), (1, "c", 1), (2, "e", 1), (3, "h", 1), (3, "h", 1), (4, "i", 1)]
    assert ngram_join.representatives(docs.where("false")).count() == 0


def random_sets(n: int, rng) -> list:
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    out = []
    for _ in range(n):
        keep = rng.random(300) > rng.choice([0.02, 0.05, 0.1])
        out.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 62, 300 - keep.sum()).astype(np.uint64)])))
    return out


def test_tree_finds_every_pair():
    rows = random_sets(150, np.random.default_rng(4))
    rule = ngram_join.Rule(4, 85, 100)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    sizes = np.diff(bounds)
    want = {(a, b) for a, b in combinations(range(len(rows)), 2) if rule.enough(len(np.intersect1d(rows[a], rows[b])), sizes[a] + sizes[b])}
    for counts in (ngram_join.folded(ngram_join.count_vectors(np.concatenate(rows), bounds, rule)), ngram_join._fine(rows)):
        parts = list(ngram_join.near_pairs(counts, sizes, rule, lambda i, j: np.ones(len(i), bool)))
        found = [tuple(sorted(p)) for i, j in parts for p in zip(i.tolist(), j.tolist())]
        assert want <= set(found) and len(found) == len(set(found)) < 150 * 149 / 2
        side = np.arange(150) % 2
        for sets, good in ((None, set(found)), (rows, want)):
            for ask in (None, side):
                edges = ngram_join.forest(counts, sizes, np.arange(150), ask, rule, sets)
                pairs = [p for p in good if ask is None or ask[p[0]] != ask[p[1]]]
                assert len(edges) < 150 and {tuple(sorted(e)) for e in edges} <= set(pairs)
                assert parts_of(edges, 150) == parts_of(pairs, 150)


def parts_of(edges, n):
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_keys_of_linked_sets_meet_beyond_the_spare_ones():
    """Any two linked sets share more keys, empty classes counted, than either may leave out."""
    rng = np.random.default_rng(9)
    rule = ngram_join.Rule(5, 80, 100)
    for n in (3, 5, 8, 12, 40, 150, 700):
        for _ in range(30):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            d = int(2 * n * 0.2 / 1.8 * rng.random())
            b = np.concatenate([a[d // 2 :], rng.integers(0, 1 << 62, rng.integers(0, d // 2 + 1)).astype(np.uint64)])
            if not rule.enough(len(np.intersect1d(a, b)), len(a) + len(b)) or len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            keys, nodes, left = ngram_join._keys_of(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), np.array([1, 2]), rule)
            both = {}
            for k, node, more in zip(keys.tolist(), nodes.tolist(), left.tolist()):
                both.setdefault(k, {})[node] = more
            shared = [v for v in both.values() if len(v) == 2]
            bands = {k & 63 for k, v in both.items() if len(v) == 2}
            assert any(len([1 for k, v in both.items() if len(v) == 2 and k & 63 == x]) > max(max(v.values()) for k, v in both.items() if len(v) == 2 and k & 63 == x) for x in bands) and shared


def test_saved_tables_and_settings(spark):
    from concurrent.futures import ThreadPoolExecutor

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    was = [spark.conf.get(k, None) for k in keys]

    def work(n):
        with _shared.scratch() as kept:
            gone = _shared.saved(spark.range(n), "gone")
            with _shared.scratch() as inner:
                inner.append(_shared.saved(spark.range(n + 1), "inner"))
                _shared.saved(spark.range(1), "gone")
            assert gone.count() == n and inner[0].count() == n + 1
            kept.append(_shared.saved(spark.range(n + 2), "kept"))
        return gone._saved_at, inner[0]._saved_at, kept[0]

    with ThreadPoolExecutor(4) as pool:
        for n, (gone, inner, kept) in enumerate(pool.map(work, range(8))):
            assert gone not in _shared._made and inner not in _shared._made and not os.path.exists(gone) and kept.count() == n + 2
    with pytest.raises(ZeroDivisionError), _shared.scratch():
        left = _shared.saved(spark.range(3), "left")._saved_at
        raise ZeroDivisionError
    assert not os.path.exists(left)
    assert [spark.conf.get(k, None) for k in keys] == was


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


# --- language-model scores


def test_lm_scores_are_plain_ones(spark, docs, empty):
    rows = [(r.doc_id, words_of(r.text)) for r in docs.collect()]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total, n_all = Counter(), sum(len(w) for _, w in rows)
    for _, w in rows:
        total.update(grams(w))
    want = {}
    for d, w in rows:
        own, score = grams(w), 0.0
        c = lambda g, own=own: total[g] - own[g]
        for i in range(len(w)):
            most = min(i + 1, 3)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    score += math.log((c(g) / (c(g[:-1]) if n > 1 else n_all - len(w))) * 0.4 ** (most - n))
                    break
            else:
                score += math.log(0.4 ** (most - 1) / (n_all - len(w) + 1))
        want[d] = (len(w), score)
    for options in ({}, {"block": 500}, {"block": 300, "partition": 100, "fan": 2}, {"block": 2000, "partition": 60, "fan": 5}):  # one block, many, teams of blocks
        got = {r.doc_id: (r.n_words, r.score) for r in lm_score.score(docs, **options).collect()}
        for d in want:
            assert got[d][0] == want[d][0] and got[d][1] == pytest.approx(want[d][1], abs=1e-6)
    assert lm_score.score(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (8, None)], "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("score", F.lit(1))
    got = sorted((r.doc_id or -1, r.n_words, round(r.score, 6)) for r in lm_score.score(odd).collect())
    same = round(math.log(2 / 6 * 0.4**0) + 2 * math.log(1.0), 6)  # each row's words are in two others
    assert got == [(-1, 3, same), (7, 3, same), (7, 3, same), (8, 0, 0.0)]


def test_packed_numbers():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000).astype(np.uint64))
    assert (lm_score.unpack_hashes(lm_score.pack_hashes(x)) == x).all()
    close = np.arange(1000, dtype=np.uint64) + np.uint64(5)
    assert (lm_score.unpack_hashes(lm_score.pack_hashes(close)) == close).all()
    c = np.array([1, 254, 255, 256, 10**9, 1])
    assert (lm_score.unpack_counts(lm_score.pack_counts(c), 6) == c).all()


# --- line dedup


def plain_dedup(rows, min_docs, lead=3, agree=0.7, shortest=6, few_docs=3):
    least = lambda t: min(few_docs, min_docs) if len(t) >= template_lines.LONG else min_docs
    lines = [(d, i, x, ["<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", x)]) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    at = Counter((len(t), *t[:lead], p, t[p]) for _, _, _, t in lines if len(t) >= shortest for p in range(lead, len(t)))

    def template(t):
        if len(t) < shortest:
            return tuple(t) or None
        mask = tuple(x if at[(len(t), *t[:lead], p, x)] >= least(t) else None for p, x in enumerate(t) if p >= lead)
        return (len(t), *t[:lead], mask) if sum(x is not None for x in mask) >= agree * len(mask) else None

    seen = defaultdict(set)
    for d, _, _, t in lines:
        seen[template(t)].add(d)
    first, kept = {}, defaultdict(list)
    for d, i, x, t in sorted(lines, key=lambda r: (r[0], r[1])):
        key = template(t)
        key = key if key is not None and len(seen[key]) >= least(t) else None
        if key is None or key not in first:
            kept[d].append(x)
        if key is not None:
            first.setdefault(key, d)
    return {d: "\n".join(kept[d]) for d, t in rows if t is not None}


def test_line_dedup_is_plain_one(spark, empty):
    rng = random.Random(9)
    rows = []
    for d in range(40):
        lines = [" ".join(rng.choices("abcdefghijk", k=rng.choice([2, 7, 9]))) for _ in range(rng.randrange(1, 6))]
        if d % 3 == 0:
            lines.append("Read all about it at our shop today")
        if d % 4 == 0:
            lines.insert(0, f"Posted by user{d} on {d} May in the forum")
        if d % 5 == 0:
            lines.append(f"Posted once again {rng.choice('xyz')} in the forum of old")
        if d % 13 == 0:
            lines.append(" ".join(["a passage of some length"] * 5 + [rng.choice("xy"), "ends"]))
        if d % 20 == 0:
            lines.append("one that only two documents have " * 4)
        rows.append((d, "\n".join(lines)))
    rows += [(50, ""), (51, "\n"), (52, "Read all about it at our shop today\n"), (53, " \n\t")]
    df = spark.createDataFrame([*rows, (54, None)], "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: r.text for r in template_lines.dedup(df, min_docs=4).collect()}
    assert got.pop(54) is None and got == plain_dedup(rows, 4)
    assert template_lines.dedup(empty).count() == 0


def test_templates_beside_other_lines(spark):
    """Lines that only share a leaf with a template, or two templates in one leaf, do not hide it."""
    names = "alice bob carol dave erin frank grace heidi ivan judy".split()
    rows = [(i, f"Posted by the user {names[i % 10]} in the forum\nown {i} words of document {chr(97 + i)}") for i in range(12)]
    rows += [(20 + i, f"Posted by the mayor for {names[i % 10]} only today") for i in range(12)]
    rows += [(40, "Posted by the sea where nobody ever looks"), (41, "Posted by the wind over all those hills")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in template_lines.dedup(df, min_docs=4).collect()}
    assert {d: t for d, (t, _) in got.items()} == plain_dedup(rows, 4)
    assert got[40][1] == got[41][1] == got[0][1] == got[20][1] == 0 and all(got[i][1] == 1 for i in [*range(1, 12), *range(21, 32)])


def test_line_dedup_of_odd_rows(spark):
    """Null ids, repeated rows, a very long line, and two texts of one id."""
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(30_000))
    rows = [(None, "same line here"), (None, "same line here"), (1, long), (2, long + "\nx"), (3, long), (3, "same line here"), (3, "same line here"), (3, "other")]
    got = sorted((r.doc_id or -1, len(r.text), r.n_dropped) for r in template_lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect())
    assert got == [(-1, 0, 1), (-1, 0, 1), (1, len(long), 0), (2, 1, 1), (3, 0, 1), (3, 5, 0), (3, 14, 0), (3, 14, 0)]


def test_lines_of_texts_that_end_in_line_feeds():
    import pyarrow as pa

    texts = ["", "a\n", "\n", "b\n\nc", "d", ""]
    ((_, _, x),) = template_lines._lines(pa.array(texts))
    assert list(zip(x.of.tolist(), x.number.tolist())) == [(d, i) for d, t in enumerate(texts) for i in range(len(t.split("\n")))]


# --- languages


def test_languages(spark, empty):
    rng = random.Random(6)
    stems = {"en": ["the", "and", "ing", "tion", "with"], "fr": ["eau", "ment", "que", "les", "oi"], "ru": ["что", "это", "как", "ные", "ств"]}
    text = lambda k, n: " ".join("".join(rng.choices(stems[k], k=rng.randrange(1, 4))) for _ in range(n))
    train = spark.createDataFrame([(i, text(k, 40), k) for i in range(60) for k in [("en", "fr", "ru")[i % 3]]] + [(None, "x", "en"), (99, None, "en"), (98, "y", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.langs == ["en", "fr", "ru"]
    mixed = text("en", 40) + ". " + text("fr", 40) + ". " + text("en", 10)
    rows = [(1, text("en", 30)), (2, text("fr", 3)), (3, text("ru", 8)), (4, None), (5, ""), (6, "123 --- !!"), (7, mixed), (8, "漢字"), (1, text("en", 5))]
    got = sorted((r.doc_id, r.lang_pred, r.n_spans) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect())
    assert [x[:2] for x in got if x[0] != 8] == [(1, "en"), (1, "en"), (2, "fr"), (3, "ru"), (4, "und"), (5, "und"), (6, "und"), (7, "en")]
    (spans,) = [r.spans for r in language.spans(spark.createDataFrame([(7, mixed)], "doc_id long, text string"), model).collect()]
    assert [s.lang for s in spans] == ["en", "fr", "en"] and spans[0].start == 0 and spans[-1].end == len(mixed)
    assert language.predict(empty, model).count() == 0
    assert language.predict(spark.createDataFrame(rows, "doc_id long, text string"), language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], np.ones((3, language._TRIGRAMS)), np.ones((3, language._WORDS)), np.ones((3, 256)))
    for n in (1, 2, 3, 6, 7):
        w = language.Words([" ".join(["ab"] * n)])
        for _ in range(40):
            s = -np.round(rng.choice([0, 1, 4, 8, 13], (n, 3)) + rng.random((n, 3)) * rng.choice([0, 1]), 3).astype(np.float32)
            s -= s.max(axis=1, keepdims=True)
            value = lambda p: float(s[np.arange(n), p].sum()) - model.switch * int((np.diff(p) != 0).sum())
            best = max(value(np.array(p)) for p in product(range(3), repeat=n))
            model.scores = lambda _, s=s: s
            assert value(np.array(language.viterbi(s, model.switch))) == pytest.approx(best, abs=1e-3)
            assert value(model.paths(w)) == pytest.approx(best, abs=1e-3)
    third = np.full((4, 3), -8.0, np.float32)  # two halves in two languages, each close to a third one that is best in all
    third[:2, 0], third[2:, 1], third[:, 2] = 0, 0, -4
    model.scores = lambda _: third
    assert model.paths(language.Words(["ab ab ab ab"])).tolist() == [0, 0, 1, 1]


def test_language_of_long_texts_ties_and_null_ids(spark):
    train = [(i, ("aa bb " if i % 2 else "xx yy ") * 30, "one" if i % 2 else "two") for i in range(40)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(None, "aa bb"), (None, None), (1, "aa bb xx yy"), (2, "aa bb " * 150_000 + "xx"), (3, "xx yy " * 20 + "aa bb " * 20)]
    got = [(r.doc_id, r.lang_pred, r.n_spans) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert got[0] == (None, "one", 1) and got[1] == (None, "und", 0) and got[3][:2] == (2, "one") and got[4] == (3, "one", 2)  # a tie goes to the first name


def test_whole_texts_take_the_single_language_shortcut_only_where_it_is_exact():
    rng = np.random.default_rng(8)
    model = language.Model(["a", "b", "c"], np.ones((3, language._TRIGRAMS)), np.ones((3, language._WORDS)), np.ones((3, 256)))
    w = language.Words([" ".join(["ab"] * n) for n in (1, 30, 200, 5)])
    for _ in range(60):
        s = -np.abs(rng.normal(0, rng.choice([1, 5, 9]), (len(w.starts), 3)).cumsum(axis=0) % 12).astype(np.float32)
        model.scores = lambda _, s=s: s
        path = model.paths(w)
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            value = lambda p: s[np.arange(a, b), p].sum() - model.switch * (np.diff(p) != 0).sum()
            assert value(path[a:b]) == pytest.approx(value(np.array(language.viterbi(s[a:b], model.switch))), abs=1e-2)


# --- mixing


def test_schedule_keeps_every_prefix_within_a_block():
    rng = random.Random(3)
    for _ in range(30):
        weights = mixing.whole_weights({f"s{i}": rng.choice([0.1, 1, 7, 50]) for i in range(rng.randrange(1, 12))}, 200)
        period, seen = sum(weights.values()), Counter()
        for t, k in enumerate(mixing.schedule(weights), 1):
            seen[k] += 1
            assert all(abs(seen[x] - t * w / period) < 1 for x, w in weights.items())
        assert seen == weights


def test_mixture_places_every_row(spark, docs, empty):
    rows = mixing.mix(docs.unionByName(docs.where("doc_id < 2")).withColumn("slot", F.lit("clash")), block=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*range(docs.count()), 0, 1])
    weights = mixing.target_weights(docs.unionByName(docs.where("doc_id < 2")))
    slots = mixing.schedule(weights)
    of = defaultdict(list)
    for r in rows:
        of[r.source or ""].append((r.slot, r.in_block, r.doc_id))
    for k, found in of.items():
        assert all(slots[s % len(slots)] == k for s, _, _ in found)
        ordered = [d for _, _, d in sorted(found)]
        assert ordered == sorted(ordered, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d))
        assert sorted((s, i) for s, i, _ in found) == sorted({(s, i) for s, i, _ in found})
    assert mixing.mix(empty).count() == 0
    assert [r.doc_id for r in mixing.mixed(docs).collect()] == [r.doc_id for r in sorted(mixing.mix(docs).collect(), key=lambda r: (r.slot, r.in_block))]
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(docs, {"s0": 1}).collect()


def test_mixture_of_null_ids_and_many_sources(spark):
    rows = [(None, f"t{i}", None if i % 2 else "s") for i in range(40)] + [(1, "x", "s"), (1, "x", "s"), (2, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = mixing.mix(docs, block=4).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in placed) == Counter(rows) and len({(r.slot, r.in_block) for r in placed}) == len(rows)
    assert [r.text for r in mixing.mixed(docs, block=4).collect()] == [r.text for r in mixing.mixed(docs.repartition(5), block=4).collect()]
    sizes = {f"s{i}": 1.0 + i % 7 for i in range(3000)} | {"large": 1e6}
    weights = mixing.whole_weights(sizes)
    assert sum(weights.values()) == 10 * 3001 and min(weights.values()) == 1 and len(mixing.schedule(weights)) == 10 * 3001


# --- nearest neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 24)).astype(np.float32)
    v[10] = v[20] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (None, [1.0] * 24), (300, v[300].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = defaultdict(list)
    for r in rotated_codes.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        hits += len({i for _, i in want} & {i for i, _ in found})
        assert all(s == pytest.approx(d[i]) for i, s in found) and [s for _, s in found] == sorted(s for _, s in found)
    assert hits >= 0.9 * 70 and [i for i, _ in got[0][:2]] == [10, 20]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rotated_codes.search(none, none).count() == 0 and rotated_codes.search(df, none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in rotated_codes.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [2, 1]


def test_neighbours_of_any_magnitude(spark):
    rows = [(i, [m * x for x in v]) for i, (m, v) in enumerate([(1e50, [1.0, 0, 0]), (1e50, [1.0, 1, 0]), (2e50, [0, 1.0, 1]), (1e50, [1.0, 1, 1]), (3e50, [0.0, 0, 1])])]
    for by in (1.0, 1e-45, 1e150, 1e-300):
        df = spark.createDataFrame([(i, [x * by for x in v]) for i, v in rows] + [(9, [float("inf")] * 3)], "vec_id long, embedding array<double>")
        got = rotated_codes.search(df, df).orderBy("query_id", "rank").collect()
        assert len(got) == 20
        for q, v in rows:
            want = sorted((math.dist([x / 1e50 for x in v], [x / 1e50 for x in u]), i) for i, u in rows if i != q)
            mine = [r for r in got if r.query_id == q]
            assert [r.vec_id for r in mine] == [i for _, i in want] and [r.score for r in mine] == pytest.approx([d * 1e50 * by for d, _ in want])
    with pytest.raises(ValueError, match="numbers"):
        rotated_codes.search(df, spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_estimates_from_bit_planes():
    """Against signs and coordinates multiplied out; the bound holds for all but a few pairs."""
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(300, 70)), rng.normal(size=(40, 70))
    centre, turn = v.mean(axis=0), rotated_codes.rotations(70)
    words, lengths, products = rotated_codes._encode(v, centre, turn)
    assert words.shape == (300, rotated_codes.ROTATIONS * 2) and turn.shape == (rotated_codes.ROTATIONS * 128, 128)
    near, error = rotated_codes.estimates(q, centre, turn, words, lengths, products, 1.0)
    true = ((q[:, None, :] - v[None]) ** 2).sum(axis=2)
    assert abs((near - true).mean()) < 0.02 * true.mean()
    assert 0.55 < (np.abs(near - true) <= error).mean() < 0.85 and (np.abs(near - true) <= 4 * error).mean() > 0.999


# --- licences


def test_licence_ties_and_long_files(spark):
    two = [("One", "alpha beta gamma delta"), ("Two", "alpha beta gamma delta")]
    rows = [("x/a", "alpha beta gamma delta"), ("x/b", "word " * 200_000 + "\nalpha beta gamma delta\n" + "more " * 100_000), (None, "alpha beta gamma delta"), ("x/a", "alpha beta gamma delta")]
    got = Counter((r.path, r.license, r.similarity) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string"), two).collect())
    assert got == Counter({("x/a", "One", 1.0): 2, ("x/b", "One", 1.0): 1, (None, "One", 1.0): 1})  # the first in the list



def test_licences_and_inheritance(spark):
    mit, apache = "Released under the MIT License.", "intro\nLicensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", mit), ("a/b/x.txt", "text"), ("a/b/c/y.txt", apache), ("a/b/c/z.txt", None), ("d/x.txt", "nothing"), ("top.txt", ""), (None, "plain"), ("a/b/COPYING.md", "All rights\nreserved."), ("a/LICENSE-x", "no licence"), ("d/x.txt", "nothing")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("origin", F.lit("clash"))
    got = Counter((r.path, r.license, r.origin, r.from_dir) for r in licenses.scan(df).collect())
    assert got == Counter([
        ("a/LICENSE", "MIT", "own", None), ("a/b/x.txt", "Proprietary", "inherited", "a/b"), ("a/b/c/y.txt", "Apache-2.0", "own", None), ("a/b/c/z.txt", "Proprietary", "inherited", "a/b"),
        ("d/x.txt", None, "none", None), ("d/x.txt", None, "none", None), ("top.txt", None, "none", None), (None, None, "none", None), ("a/b/COPYING.md", "Proprietary", "own", None), ("a/LICENSE-x", "MIT", "inherited", "a"),
    ])
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_prefilter_loses_nothing(spark):
    rng = random.Random(12)
    w = licenses.Weights(licenses.TEMPLATES)
    lines = []
    for _ in range(400):
        words = re.findall(r"\S+", rng.choice(licenses.TEMPLATES)[1])
        lines.append(" ".join([x for x in words if rng.random() > 0.25] + rng.choices(["foo", "the", "bar"], k=rng.randrange(3))))
    df = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(lines)], "path string, text string")
    got = {r.path: r.similarity for r in licenses.scan(df).collect()}
    for i, x in enumerate(lines):
        c = Counter(re.findall(r"[a-z0-9]+", x.lower()))
        v = {t: n * w.idf.get(t, w.unseen) for t, n in c.items()}
        best = max((sum(v.get(t, 0) * y for t, y in u.items()) / math.sqrt(sum(y * y for y in v.values())) if v else 0 for u in w.vectors), default=0)
        assert (got[f"f{i}"] is not None) == (round(best, 9) >= licenses.LEAST)
        if got[f"f{i}"] is not None:
            assert got[f"f{i}"] == pytest.approx(best)


def test_whole_texts_headers_and_tags(spark):
    forms = licenses.long_forms()
    assert {n for n, _ in forms} | {"Proprietary"} == {n for n, _ in licenses.TEMPLATES} and len(forms) > 20
    prose = "Some words before it, on a line.\n\nAnd more of them. "
    rows = [(f"{n}/{i}.txt", n, prose + "\n" + t + "\nint main() { return 0; }\n") for i, (n, t) in enumerate(forms)]
    rows += [(f"{n}/{i}.c", n, prose + "\n/*\n" + "\n".join(" * " + x for x in re.findall(r".{1,58}(?:\s|$)", t.replace("\n", " "))) + "\n */ code();") for i, (n, t) in enumerate(forms)]
    mit = next(t for n, t in reversed(forms) if n == "MIT")
    rows += [
        ("m/LICENSE", "MIT", "MIT License\n\nCopyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + mit), ("m/x/y.c", "MIT", "none of its own"), ("t/1", "MIT", "// SPDX-License-Identifier: MIT"),
        ("t/2", "Apache-2.0", "x\n# SPDX-License-Identifier: (Zlib OR Apache-2.0)\nAll rights reserved."), ("t/3", "GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("t/4", None, "SPDX-License-Identifier: Zlib see MIT"),
        ("t/5", "Proprietary", "Copyright (c) 2020 Jane Doe. All rights reserved."), ("t/6", "GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007"), ("t/7", None, prose),
    ]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame([(p, t) for p, _, t in rows], "path string, text string")).collect()}
    assert got == {p: n for p, n, _ in rows}


# --- quality


def test_quality_on_held_out_rows(spark, empty):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat", "and", "slept"], k=30))
    bad = lambda: " ".join(w + "###" for w in rng.choices(["the", "cat", "sat", "on", "mat"], k=30))
    rows = [(i, good() if i % 3 else bad()) for i in range(150)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(1, 0), (None, 1), (5, None), (999, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(100, 150)) and got[200] == got[201] and all(0 <= s <= 1 for s in got.values())
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scores(docs, none).collect()} == {0.5} and quality.scores(empty, none).count() == 0


def dense(rows, width):
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, x] = 1
    return out


def test_hinge_loss_is_least(monkeypatch):
    """Against the dual's own optimum: no weights can do better than a feasible dual value, so a closed gap proves both."""
    monkeypatch.setattr(quality, "BUCKETS", 64)
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 64, 12)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.3, 1.0, -1.0)
    for x, label in zip(rows[:30], y):  # some signal
        x[0] = 0 if label > 0 else 1
    rows = [np.unique(x) for x in rows]
    held = [quality.packed(x) for x in rows]
    ratio = quality.log_ratio(held, y)
    counts = [sum(b in x.tolist() for x, label in zip(rows, y) if label == side) + 1 for side in (1, -1) for b in range(64)]
    p, q = np.array(counts[:64]), np.array(counts[64:])
    assert ratio == pytest.approx(np.log(p / p.sum()) - np.log(q / q.sum()))
    v = dense(rows, 64) * ratio
    v = np.column_stack([v / np.sqrt((v * v).sum(axis=1, keepdims=True)), np.ones(40)])  # the offset is a weight too
    w, b = quality.dual_descent(held, y, ratio, passes=400)
    full = np.append(w, b)
    most = quality.costs(y)
    assert most[y > 0].sum() == pytest.approx(most[y < 0].sum()) == pytest.approx(20 * quality.COST)
    primal = 0.5 * full @ full + (most * np.maximum(0, 1 - y * (v @ full))).sum()
    gram, alpha = (v @ v.T) * np.outer(y, y), np.zeros(40)
    for _ in range(60_000):  # projected gradient
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, most)
    assert primal == pytest.approx(alpha.sum() - 0.5 * alpha @ gram @ alpha, abs=1e-4) and full == pytest.approx((alpha * y) @ v, abs=1e-2)


def test_probability_curve_is_a_minimum():
    rng = np.random.default_rng(1)
    m, y = rng.normal(size=200), np.where(rng.random(200) < 0.4, 1.0, -1.0)
    m += y
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    loss = lambda a, b: -(t * np.log(1 / (1 + np.exp(-(a * m + b)))) + (1 - t) * np.log(1 - 1 / (1 + np.exp(-(a * m + b))))).sum()
    a, b = quality.logistic(m, y)
    assert all(loss(a, b) <= loss(a + x, b + z) + 1e-9 for x in (-0.01, 0, 0.01) for z in (-0.01, 0, 0.01))


def test_packed_buckets_and_bounds(spark):
    rng = np.random.default_rng(4)
    for n in (0, 1, 8191, 8192, 100_000, quality.BUCKETS):
        x = np.sort(rng.choice(quality.BUCKETS, n, replace=False))
        assert (quality.unpacked(quality.packed(x)) == x).all() and len(quality.packed(x)) <= quality.BUCKETS // 8
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "a b"), (2, "e f"), (3, "g")], "doc_id long, text string")
    one_class = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, label int"))
    found = quality.scores(docs, one_class).collect()
    assert len(found) == 6 and len({r.score for r in found}) == 1 and 0.5 < found[0].score < 1
    both = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"))
    by_id = {(r.doc_id, round(r.score, 9)) for r in quality.scores(docs, both).collect()}
    assert len([x for x in by_id if x[0] == 1]) <= 2


# --- the pipeline


def test_pipeline_stages(spark, tmp_path):
    texts = [t for t in corpus(60, 4)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        after = {r.doc_id: r for r in kept.collect()}
        if name == "language ID":
            assert set(before) - set(after) == {i for i, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")}
        if name == "line dedup":
            assert set(after) == set(before) and {i: r.text for i, r in after.items()} == plain_dedup([(i, r.text) for i, r in before.items()], template_lines.MIN_DOCS, few_docs=template_lines.MIN_DOCS)
        if name == "n-gram Jaccard join":
            groups = brute_components({i: r.text for i, r in before.items()}, 5, 80, 100)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        if name == "mixing sources to target weights":
            assert after == before
    out = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept.collect()}


def test_pipeline_result_has_the_mixture(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * (1 + 40 * (i % 5)), "en", f"s{min(i % 7, 2)}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    monkeypatch.setattr(corpus_pipeline, "saved", lambda df, name: (df.write.option("maxRecordsPerFile", 60).parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1])
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("slot", "in_block").collect()
    assert len(list((tmp_path / "mixing").glob("*.parquet"))) > 1
    assert [(r.doc_id, r.slot, r.in_block) for r in got] == [(r.doc_id, r.slot, r.in_block) for r in mixing.mix(docs).orderBy("slot", "in_block").collect()]
    assert [r.doc_id for r in got] == [r.doc_id for r in mixing.mixed(docs).collect()]
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in rows}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, a very long text, an extra column, and a table without rows."""
    text = lambda k: " ".join(f"{w}{chr(97 + k)}" for w in "the sea is wide and the night is long for those who wait at home".split())
    rows = [(i, text(i), "en", f"s{i % 2}", 60, i) for i in range(20)] + [(0, text(0), "en", "s0", 60, 0), (1, text(20), "en", None, 60, 1), (None, text(21), None, None, None, None)]
    rows += [(30, None, None, None, None, None), (31, "", "en", "s1", 0, 1), (32, "12 34", "en", "s1", 5, 1), (33, " ".join(text(i % 26) for i in range(3000)), "en", "s1", 0, 2)]
    docs = spark.createDataFrame(rows, DOC + ", slot long")
    for some in (docs, docs.where("false")):
        path = str(tmp_path / str(some.isEmpty()))
        some.write.parquet(f"{path}/documents.parquet")
        kept = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, path)
            assert kept.columns == docs.columns
        want = Counter((d, t) for d, t, *_ in set(rows) if t and re.search("[a-z]", t)) if some is docs else Counter()
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
        out = corpus_pipeline.run(spark, path).collect()
        assert Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter({(d, hashlib.sha256(t.encode()).hexdigest()): n for (d, t), n in want.items()})
        assert len({(r.slot, r.in_block) for r in out}) == len(out)
