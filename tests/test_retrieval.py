"""Vectors, full text, trigrams, fusion and the chunk store."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import embedding, fulltext, sql
from spindrift.functions import text as T
from spindrift.operators import retrieval
from spindrift.sources.chunk_store import ChunkStore

CHUNK = "space_key string, chunk_id string, source_id string, title string, heading string, breadcrumb string, content string, embedding array<double>"


def rows(*items):
    return [(space, f"{source}#0", source, source, "S", None, content, vector) for space, source, content, vector in items]


@pytest.fixture
def store(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "store"), 3)
    s.ensure()
    return s


def put(spark, store, space, source, content, vector):
    return store.replace_source(space, source, spark.createDataFrame(rows((space, source, content, vector)), CHUNK))


def test_replace_upsert_delete_and_spaces(spark, store):
    for space, text in (("A", "one"), ("B", "two")):
        assert put(spark, store, space, "shared", text, [1.0, 0.0, 0.0]) == 1
    assert put(spark, store, "A", "shared", "three", [1.0, 0.0, 0.0]) == 1
    assert sorted(r.content for r in store.read().collect()) == ["three", "two"]
    both = spark.createDataFrame(rows(("A", "shared", "v1", [0.0, 1.0, 0.0]), ("A", "new", "n", [0.0, 1.0, 0.0])), CHUNK).withColumn("position", F.lit(1))
    again = spark.createDataFrame(rows(("A", "shared", "v2", [0.0, 1.0, 0.0])), CHUNK).withColumn("position", F.lit(2))
    assert store.upsert(both.unionByName(again)) == 3
    assert sorted(r.content for r in store.read("A").collect()) == ["n", "v2"]
    assert store.delete_source("A", "shared") == 1 and store.delete_source("A", "shared") == 0
    assert [r.content for r in store.read("A").collect()] == ["n"] and [r.content for r in store.read("B").collect()] == ["two"]
    assert store.read("").count() == 2 and store.read("none").count() == 0


def test_writes_over_spaces_are_seen_whole(spark, store):
    for space in ("A", "B", "x/y = z"):
        put(spark, store, space, "s", "old", [1.0, 0.0, 0.0])
    before = store.read()
    batch = spark.createDataFrame(rows(*((space, "s", "new", [0.0, 1.0, 0.0]) for space in ("A", "B", "x/y = z", "C"))), CHUNK)
    commit, seen = store.log.commit, []
    store.log.commit = lambda *a: (seen.append(sorted(r.content for r in store.read().collect())), commit(*a))[1]
    assert store.upsert(batch) == 4
    assert seen == [["old"] * 3]  # one new version, and until then nothing of the write
    assert sorted((r.space_key, r.content) for r in store.read().collect()) == [(x, "new") for x in ("A", "B", "C", "x/y = z")]
    assert sorted(r.content for r in before.collect()) == ["old"] * 3
    sources = spark.createDataFrame([("A", "s"), ("C", "s"), ("D", "s")], "space_key string, source_id string")
    assert store.replace_sources(sources, spark.createDataFrame(rows(("D", "s", "newer", [0.0, 1.0, 0.0])), CHUNK)) == 1
    assert sorted((r.space_key, r.content) for r in store.read().collect()) == [("B", "new"), ("D", "newer"), ("x/y = z", "new")]
    assert store.vacuum() > 0 and store.read().count() == 3 and store.vacuum() == 0
    with pytest.raises(ValueError, match="position"):
        store.upsert(batch.unionByName(batch))


def some_chunks(rng, n, space="AB"):
    words = "krill whale song deep ocean blue harbour tide".split()
    return rows(*((rng.choice(space), f"s{rng.randrange(60)}", " ".join(rng.choices(words, k=6)), [rng.random(), rng.random(), 1.0]) for _ in range(n)))


def unique(batch):
    return list({(r[0], r[1]): r for r in batch}.values())


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_searches_through_segments_equal_a_rebuild(spark, store):
    """A hundred random changes in a dozen writes; rows, index and searches are those of one segment of what is left."""
    rng = random.Random(1)
    ask = lambda space: [tuple(r) for r in store.search_hybrid([1.0, 0.2, 0.0], '"blue whale" or singing tide', space_key=space).collect()]
    want = {}
    for k in range(12):
        batch = unique(some_chunks(rng, 9))
        if k % 3 == 2:
            space, source = rng.choice(sorted({(x[0], x[2]) for x in want.values()}))
            assert store.delete_source(space, source) == sum((x[0], x[2]) == (space, source) for x in want.values())
            want = {key: x for key, x in want.items() if (x[0], x[2]) != (space, source)}
        store.upsert(spark.createDataFrame(batch, CHUNK))
        want |= {(x[0], x[1]): x for x in batch}
    assert len(store.log.state()[1]["segments"]) > 1 and store.log.state()[1]["dead"]
    assert {(r.space_key, r.chunk_id): r.content for r in store.read().collect()} == {k: x[6] for k, x in want.items()}
    before = [ask(None), ask("A")]
    asked = spark.createDataFrame([("q", "blue")], "query_id string, query_text string")
    matched = lambda index: sorted(map(tuple, retrieval.fulltext_matches(store.read(), asked, "english", index).collect()))
    assert matched(store.index()) == matched(None) != []
    plan = retrieval.fulltext_matches(store.read(), asked, "english", store.index())._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and re.search(r"PushedFilters: [^\n]*(In|EqualTo)\(bucket", plan)
    store.compact(everything=True)
    state = store.log.state()[1]
    assert len(state["segments"]) == 1 and not state["dead"] and state["segments"][0]["rows"] == len(want)
    assert [ask(None), ask("A")] == before and before[0]
    assert store.vacuum() > 0 and [ask(None), ask("A")] == before and store.vacuum() == 0


def test_bounded_search_equals_a_full_one(spark, store):
    """Top lists by bounds are those of all matches; positions move for a few chunks only."""
    rng = random.Random(6)
    words = ["krill", "whale", "song", "deep", "ocean", "blue", *(f"w{i}" for i in range(40))]
    made = [("AB"[i % 2], f"c{i:03d}", f"s{i}", "t", "S", None, " ".join(rng.choices(words, [9, 5, 5, 2, 2, 1, *[3] * 40], k=rng.randrange(1, 90))), [1.0, 0.0, 0.0]) for i in range(400)]
    store.upsert(spark.createDataFrame(made, CHUNK))
    store.delete_source("A", "s4")
    asked = spark.createDataFrame([("a", "krill whale"), ("b", '"deep ocean" or blue -song'), ("c", "krill krill"), ("d", "whale song deep"), ("e", "the"), ("f", "none of it")], "query_id string, query_text string")
    row = lambda r: (r.query_id, r.fts_rank, r.space_key, r.chunk_id, r.text_score)
    for k in (1, 5, 300):
        got, want = (sorted(map(row, retrieval.fulltext_candidates(store.read(), asked, k, "english", index).collect())) for index in (store.index(), None))
        assert got == want != []
    scores = {(r.query_id, r.space_key, r.chunk_id): r.text_score for r in retrieval.fulltext_matches(store.read(), asked).collect()}
    bounds = {(r.query_id, r.space_key, r.chunk_id): r.bound for r in retrieval.fulltext_bounds(asked, "english", store.index()).collect()}
    assert set(scores) <= set(bounds) and all(bounds[x] >= s - 1e-9 for x, s in scores.items())
    fifth = sorted((s for (x, *_), s in scores.items() if x == "a"), reverse=True)[4]
    assert sum(x[0] == "a" and b >= fifth for x, b in bounds.items()) < 0.8 * sum(x[0] == "a" for x in bounds)


def test_segments_are_merged_by_size(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), 3, fan=3)
    store.ensure()
    for i in range(9):
        put(spark, store, "A", f"s{i}", "tide", [1.0, 0.0, 0.0])
        state = store.log.state()[1]
        assert sum(s["rows"] - s["gone"] for s in state["segments"]) == i + 1
    assert [s["rows"] for s in state["segments"]] == [9]
    assert [did for _, did, _ in store.history()].count("compact") == 4


def test_a_write_follows_its_batch(spark, store, tmp_path):
    rng = random.Random(3)
    store.upsert(spark.createDataFrame([("A", f"c{i}", f"s{i}", "t", "S", None, " ".join(f"w{rng.randrange(10**9)}" for _ in range(40)), [1.0, 0.0, 0.0]) for i in range(3000)], CHUNK))
    whole = size_of(tmp_path / "store")
    put(spark, store, "A", "s5", "new words", [1.0, 0.0, 0.0])
    assert size_of(tmp_path / "store") - whole < whole / 20
    assert store.read("A").count() == 3000 and [r.content for r in store.read("A").where("source_id = 's5'").collect()] == ["new words"]


def test_versions_can_be_read(spark, store):
    for text in ("one", "two", "three"):
        put(spark, store, "A", "s", text, [1.0, 0.0, 0.0])
    contents = {v: [r.content for r in store.read(version=v).collect()] for v, _, _ in store.history()}
    assert list(contents.values()) == [[], ["one"], ["two"], ["three"]]
    first = min(v for v, c in contents.items() if c == ["one"])
    assert [r.content for r in store.read(version=first).collect()] == ["one"]
    store.vacuum(keep=1)
    with pytest.raises(ValueError, match="version"):
        store.read(version=first)
    assert [r.content for r in store.read().collect()] == ["three"]


@pytest.mark.parametrize("other", [("A", "same"), ("A", "next"), ("B", "same")])
def test_interleaved_writers_lose_nothing(spark, store, other):
    """A second writer commits between a first one's preparation and its commit, to its source, its space or another space."""
    put(spark, store, "A", "same", "old", [1.0, 0.0, 0.0])
    second = ChunkStore(spark, store.folder, 3)
    commit, tried, killed = store.log.commit, [], []
    kill = store._killed
    store._killed = lambda *a: (killed.append(1), kill(*a))[1]

    def slow(version, state):
        if not tried:
            put(spark, second, *other, "second", [1.0, 0.0, 0.0])
        tried.append(version)
        return commit(version, state)

    store.log.commit = slow
    put(spark, store, "A", "same", "first", [0.0, 1.0, 0.0])
    store.log.commit = commit
    assert len(tried) == 2 and len(killed) == (1 if other[0] == "B" else 2)  # in another space nothing has to be worked out anew
    want = {("A", "same"): "first"} | ({} if other == ("A", "same") else {other: "second"})
    assert {(r.space_key, r.source_id): r.content for r in store.read().collect()} == want
    index = store.index()
    asked = spark.createDataFrame([("q", "first or second or old")], "query_id string, query_text string")
    assert retrieval.fulltext_matches(store.read(), asked, "english", index).count() == len(want)


def test_merging_meets_deletes(spark, store):
    """What is deleted while segments are merged stays deleted."""
    for i in range(4):
        put(spark, store, "A", f"s{i}", "tide", [1.0, 0.0, 0.0])
    second = ChunkStore(spark, store.folder, 3)
    commit, tried = store.log.commit, []

    def slow(version, state):
        if not tried:
            second.delete_source("A", "s1")
        tried.append(version)
        return commit(version, state)

    store.log.commit = slow
    store.compact(everything=True)
    assert sorted(r.source_id for r in store.read().collect()) == ["s0", "s2", "s3"]


def test_only_one_writer_makes_a_version(spark, store):
    version, state = store.log.state()
    assert store.log.commit(version + 1, state) and not store.log.commit(version + 1, state | {"did": "other"})
    assert store.log.state() == (version + 1, state) and not [x for x in store.files.names("log") if x.startswith("staged")]
    with pytest.raises(ValueError):
        store.log.state(99)


def test_wrong_batches_are_refused(spark, store):
    with pytest.raises(ValueError, match="dimension"):
        put(spark, store, "A", "x", "t", [1.0])
    with pytest.raises(ValueError, match="belong"):
        store.replace_source("A", "y", spark.createDataFrame(rows(("A", "x", "t", [1.0, 0.0, 0.0])), CHUNK))
    with pytest.raises(ValueError, match="dimension"):
        ChunkStore(spark, store.folder, 4).ensure()


def test_argument_names_in_errors(spark, store):
    q = [1.0, 0.0, 0.0]
    for options, word in (({"top_k": 0}, "top_k"), ({"candidate_k": 4}, "candidate_k"), ({"rrf_k": 0}, "rrf_k"), ({"trgm_threshold": 1.5}, "trgm_threshold")):
        with pytest.raises(ValueError, match=word):
            store.search_hybrid(q, "query", **options)
    with pytest.raises(ValueError, match="dimension"):
        store.search([1.0])


def test_fusion_of_signals(spark, store):
    east, west = [0.0, 2.0, 0.0], [0.0, -2.0, 0.0]
    for source, content, vector in (("lamp", "foghorn at dawn", east), ("buoy", "calm water", east), ("rock", "a foghorn far away", west), ("sand", "nothing here", west)):
        put(spark, store, "SEA", source, content, vector)
    hits = store.search_hybrid([0.0, 1.0, 0.0], "foghorn", space_key="SEA", top_k=3, candidate_k=3).collect()
    assert [h.source_id for h in hits] == ["lamp", "rock", "buoy"]  # three signals, two and the far end of one, one
    lamp, rock, buoy = hits
    assert lamp.vector_rank is not None and lamp.fts_rank is not None and lamp.trgm_rank is not None and lamp.rrf_score > rock.rrf_score > buoy.rrf_score
    assert buoy.fts_rank is None and buoy.trgm_rank is None and rock.distance > buoy.distance
    assert [h.source_id for h in store.search([0.0, 1.0, 0.0], "SEA", 2).collect()] == ["buoy", "lamp"]


def test_vector_only_and_zero_query(spark, store):
    put(spark, store, "SEA", "x", "tide out", [1.0, 0.0, 0.0])
    (hit,) = store.search_hybrid([0.0, 0.0, 0.0], "?!", space_key="SEA").collect()
    assert (hit.fts_rank, hit.trgm_rank, hit.vector_rank) == (None, None, 1) and math.isnan(hit.distance)


def test_trigrams_find_words_with_particles(spark):
    body = "고래들이 먼 바다에서 노래했다. 등대는 밤새 켜져 있었다."
    chunks = embedding.hashed(spark.createDataFrame([("SEA", "k#0", "k", body)], "space_key string, chunk_id string, source_id string, content string"), "content", dimension=16)
    query = embedding.hashed(spark.createDataFrame([("q", "고래 노래")], "query_id string, query_text string"), "query_text", "query_embedding", 16)
    (hit,) = retrieval.hybrid(chunks, query, trgm_threshold=0.1).collect()
    assert hit.trgm_rank == 1 and hit.fts_rank is None


def brute(q, t):
    best, q = 0.0, set(q)
    for i in range(len(t)):
        for j in range(i + 1, len(t) + 1):
            e = set(t[i:j])
            best = max(best, len(q & e) / len(q | e))
    return best


def test_word_similarity_against_all_stretches(spark):
    rng = random.Random(3)
    cases = [(list(dict.fromkeys(rng.choices("abcdef", k=rng.randrange(1, 6)))), rng.choices("abcdefghij", k=rng.randrange(0, 14))) for _ in range(400)]
    cases += [(list("abcde"), rng.choices("abcdefghijklmnopqrstuvwxyz"[: rng.randrange(2, 27)], k=120)) for _ in range(60)]  # long enough for far ends to be left out
    cases += [(list("abc"), list("xa" * 40 + "b" + "y" * 30 + "c")), (list("abc"), list("a" * 200 + "z" * 200 + "bc"))]
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(cases)], "i int, q array<string>, t array<string>")
    for least in (0.0, 0.4):
        got = {r.i: r.s for r in df.select("i", retrieval.best_stretch(F.col("q"), F.col("t"), F.lit(least)).alias("s")).collect()}
        for i, (q, t) in enumerate(cases):
            want = brute(q, t)
            assert got[i] == pytest.approx(max(want, least)), (q, t)
            assert sql._extent(q, t) == pytest.approx(want), (q, t)
    df = spark.createDataFrame([("word", "two words"), ("krill", "other things"), ("", "x"), (None, "x"), ("x", None)], "q string, t string")
    got = [r.s for r in df.select(retrieval.word_similarity(F.col("q"), F.col("t")).alias("s")).collect()]
    assert got == pytest.approx([0.8, 0.0, 0.0, 0.0, 0.0])


def test_trigrams_are_looked_up_in_spaced_text(spark):
    texts = ["two words", "a b", "", "a_b  é-x", "aaa", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.spaced(F.col("t")).alias("s"), T.trigram_set(F.col("t")).alias("g")).collect()
    every = {g for r in df for g in r.g or []} | {"  w", "x  ", "   ", "o w", " a ", "ds "}
    for r in df[:-1]:
        assert {g for g in every if g in r.s} - {"x  ", "   "} == set(r.g)


def test_trigram_candidates_against_all_texts(spark):
    rng = random.Random(9)
    words = "apache license version rights reserved creative commons free lance verse vision".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(150)]
    chunks = spark.createDataFrame([("A", f"{i:03d}", t) for i, t in enumerate(texts)], "space_key string, chunk_id string, content string")
    questions = {"a": "apache license", "b": "free version", "c": "zzz", "d": "", "e": "l"}
    asked = spark.createDataFrame(list(questions.items()), "query_id string, query_text string")
    for k, threshold in ((5, 0.2), (40, 0.6), (3, 1.0)):
        got = {(r.query_id, r.trgm_rank): (r.chunk_id, round(r.trgm_score, 9)) for r in retrieval.trigram_candidates(chunks, asked, k, threshold).collect()}
        want = {}
        for q, text in questions.items():
            scores = [(round(plain_word_similarity(text, t), 9), f"{i:03d}") for i, t in enumerate(texts)]
            for rank, (s, c) in enumerate(sorted((x for x in scores if x[0] >= threshold and x[0] > 0), key=lambda x: (-x[0], x[1]))[:k], 1):
                want[q, rank] = (c, s)
        assert got == want
    plan = retrieval.trigram_candidates(chunks, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_trigram_set_padding(spark):
    (row,) = spark.createDataFrame([("Cat",)], "t string").select(T.trigram_set(F.col("t")).alias("x")).collect()
    assert row.x == ["  c", " ca", "cat", "at "]


def test_query_grammar(spark):
    texts = ["the quick brown fox", "quick fox, brown", "slow fox", "brown quick", "running foxes"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def found(query, analyzer="simple"):
        terms = df.withColumn("terms", fulltext.term_positions(F.col("t"), analyzer))
        return [r.i for r in terms.where(fulltext.matches(F.col("terms"), fulltext.parse_query(query, analyzer))).orderBy("i").collect()]

    assert found("quick fox") == [0, 1]
    assert found('"quick brown"') == [0]
    assert found("slow or brown") == [0, 1, 2, 3]
    assert found("fox -quick") == [2]
    assert found("run fox", "english") == [4] and found("the of", "english") == []


def test_cover_density_prefers_close_words(spark):
    df = spark.createDataFrame([("a b",), ("a x x x b",), ("a b x a b",)], "t string").withColumn("terms", fulltext.term_positions(F.col("t")))
    scores = [r.s for r in df.select(fulltext.cover_density(F.col("terms"), fulltext.parse_query("a b", "simple")).alias("s")).collect()]
    assert scores[0] == pytest.approx(0.5) and scores[1] == pytest.approx(0.2) and scores[2] > scores[0]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "relational": "relat", "conflated": "conflat", "happy": "happi", "rational": "ration", "controlling": "control", "generalizations": "gener"}
    assert {w: fulltext.stem(w) for w in pairs} == pairs


def plain_word_similarity(q, text):
    grams = [f"  {w} "[i : i + 3] for w in re.findall(r"\w+", text.lower()) for i in range(len(w) + 1)]
    return brute(list(dict.fromkeys(f"  {w} "[i : i + 3] for w in re.findall(r"\w+", q.lower()) for i in range(len(w) + 1))), grams) if q.strip() else 0.0


def plain_density(words, wanted):
    """By trying every stretch: those that hold all words, and none that is shorter inside."""
    full = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(wanted) <= set(words[i : j + 1])]
    return sum(1 / (j - i + 1) for i, j in full if not any((a, b) != (i, j) and i <= a and b <= j for a, b in full))


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(8)
    vocabulary = "whales sing singing song deep deeper the of blue bluer krill eaten eating ocean oceans".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 14))) for _ in range(90)]
    return texts, embedding.hashed(spark.createDataFrame([(f"s{i % 3}", f"{i:03d}", t) for i, t in enumerate(texts)], "space_key string, chunk_id string, content string"), "content", dimension=16)


QUESTIONS = {"a": "singing whales", "b": '"blue ocean" or krill -eating', "c": "the of", "d": ""}


def test_english_matches_against_plain_words(spark, library):
    texts, chunks = library
    asked = spark.createDataFrame(list(QUESTIONS.items()), "query_id string, query_text string")
    want = {}
    for i, t in enumerate(texts):
        words = [fulltext.stem(w) if w not in fulltext.STOP_WORDS else "" for w in t.split()]
        if score := plain_density(words, ["sing", "whale"]):
            want["a", f"{i:03d}"] = score
        phrase = sum((x, y) == ("blue", "ocean") for x, y in zip(words, words[1:]))
        krill = words.count("krill") if "eat" not in words else 0
        if phrase or krill:
            want["b", f"{i:03d}"] = max(phrase, krill)
    for given in (chunks, chunks.withColumn("terms", fulltext.term_positions(F.col("content"), "english"))):
        got = {(r.query_id, r.chunk_id): r.text_score for r in retrieval.fulltext_matches(given, asked, "english").collect()}
        assert got == pytest.approx(want, abs=1e-8) and {q for q, _ in got} == {"a", "b"}
    columns = chunks.withColumn("terms", fulltext.term_positions(F.col("content"), "english"))
    for q in QUESTIONS:
        parsed = fulltext.parse_query(QUESTIONS[q])
        by_column = {r.chunk_id: r.s for r in columns.where(fulltext.matches(F.col("terms"), parsed)).select("chunk_id", fulltext.cover_density(F.col("terms"), parsed).alias("s")).collect()}
        assert set(by_column) == {c for x, c in want if x == q}


def test_hybrid_against_plain_lists(spark, library):
    """Every list, rank and score of hybrid(), from brute-force scores of every chunk."""
    texts, chunks = library
    asked = embedding.hashed(spark.createDataFrame(list(QUESTIONS.items()), "query_id string, query_text string"), "query_text", "query_embedding", 16)
    vectors = {(r.space_key, r.chunk_id): list(r.embedding) for r in chunks.collect()}
    queries = {r.query_id: list(r.query_embedding) for r in asked.collect()}
    full = {(r.query_id, r.space_key, r.chunk_id): r.text_score for r in retrieval.fulltext_matches(chunks, asked, "english").collect()}

    def distance(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 1 - sum(x * y for x, y in zip(a, b)) / n if n else math.inf

    want = {}
    for q, v in queries.items():
        far = {k: distance(x, v) for k, x in vectors.items()}
        similar = {k: plain_word_similarity(QUESTIONS[q], texts[int(k[1])]) for k in vectors}
        lists = [
            sorted(vectors, key=lambda k: (round(far[k], 12), k))[:20],
            sorted((k for k in vectors if (q, *k) in full), key=lambda k: (-full[q, *k], k))[:20],
            sorted((k for k in vectors if similar[k] >= 0.2), key=lambda k: (-round(similar[k], 12), k))[:20],
        ]
        ranks = {k: [x.index(k) + 1 if k in x else None for x in lists] for k in set().union(*lists)}
        scores = {k: sum(1 / (60 + r) for r in x if r) for k, x in ranks.items()}
        for ref, k in enumerate(sorted(scores, key=lambda k: (-round(scores[k], 12), round(far[k], 12), k))[:5], 1):
            want[q, ref] = (k, scores[k], ranks[k])
    got = {(r.query_id, r.ref): ((r.space_key, r.chunk_id), r.rrf_score, [r.vector_rank, r.fts_rank, r.trgm_rank]) for r in retrieval.hybrid(chunks, asked).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][1] == pytest.approx(want[k][1], abs=1e-9), k
        if got[k][0] != want[k][0]:  # equal up to rounding
            assert sum(v[1] == pytest.approx(want[k][1], abs=1e-9) for q, v in want.items() if q[0] == k[0]) > 1, k
        else:
            assert got[k][2][1:] == want[k][2][1:], k


def test_trigram_joins_against_all_pairs(spark):
    rng = random.Random(2)
    sets = [[sorted(set(rng.choices("abcdefghijklmnop", k=rng.randrange(0, 9)))) for _ in range(60)] for _ in range(2)]
    left, right = (spark.createDataFrame(list(enumerate(x)), f"{n}_id int, trigrams array<string>") for x, n in zip(sets, ("left", "right")))
    for least in (0.3, 0.5, 1.0):
        pairs = [(i, j, a, b) for i, a in enumerate(map(set, sets[0])) for j, b in enumerate(map(set, sets[1])) if a and b]
        got = {(r.left_id, r.right_id): r.similarity for r in retrieval.similar_sets(left, right, least).collect()}
        assert got == pytest.approx({(i, j): len(a & b) / len(a | b) for i, j, a, b in pairs if len(a & b) >= least * len(a | b)})
        held = {(r.left_id, r.right_id) for r in retrieval.holding_sets(left, right, least).collect()}
        assert held == {(i, j) for i, j, a, b in pairs if len(a & b) >= least * len(b)}
    assert retrieval.similar_sets(left, right.where("false"), 0.5).count() == 0 == retrieval.holding_sets(left, right.where("false"), 0.5).count()
    plan = retrieval.similar_sets(left, right, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 4)
    chunks = spark.createDataFrame([("A", f"{i:02d}", [float(i), 1.0]) for i in range(20)], "space_key string, chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(11)], "query_id int, query_embedding array<double>")
    got = retrieval.vector_candidates(chunks, asked, 2).collect()
    assert len(got) == 22 and {(r.query_id, int(r.chunk_id)) for r in got if r.vector_rank == 1} == {(i, i) for i in range(11)}


def test_plan_uses_limits(spark):
    chunks = spark.createDataFrame([("A", str(i), [float(i), 1.0]) for i in range(20)], "space_key string, chunk_id string, embedding array<double>")
    plan = retrieval.search(chunks, [1.0, 0.0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_embedding array<double>")
    plan = retrieval.vector_candidates(chunks, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
