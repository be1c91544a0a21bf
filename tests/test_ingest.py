"""Markdown documents to chunks and embeddings."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions import embedding
from spindrift.operators import chunking
from spindrift.sources import markdown
from spindrift.streaming import ingest

HEAD = "---\nsource_id: w7\ntitle: Whale watch\nspace_key: SEA\nbreadcrumb: North > Bay\n---\n"
DOC = "space_key string, source_id string, title string, breadcrumb string, body string"


def chunks(spark, body, **options):
    docs = spark.createDataFrame([("SEA", "w7", "Whale watch", "North > Bay", body)], DOC)
    return chunking.chunks(docs, **options).orderBy("seq").collect()


def test_header_is_parsed(spark):
    texts = [HEAD + "\nblow!\n", "blow!", "---\ntitle: w\n", "---\ntitle: w\n---\nb", "---\n- w\n---\nb", "---\ntitle: 0\nspace_key: SEA\n---\nb", "---\ntitle: [\n---\nb", "\n ---\ntitle: T\nspace_key: SEA\n---\n\n a \n"]
    rows = markdown.parse(spark.createDataFrame([(t, "stem") for t in texts], "text string, fallback string")).collect()
    assert (rows[0].source_id, rows[0].title, rows[0].space_key, rows[0].breadcrumb, rows[0].body, rows[0].error) == ("w7", "Whale watch", "SEA", "North > Bay", "blow!", None)
    assert [bool(r.error) for r in rows] == [False, True, True, True, True, True, True, False]
    assert "unterminated" in rows[2].error and "mapping" in rows[4].error and (rows[7].source_id, rows[7].body) == ("stem", "a")
    with pytest.raises(Exception, match="missing"):
        markdown.parse(spark.createDataFrame([("x", "y")], "text string, fallback string"), strict=True).collect()


def test_files_and_streams_name_sources_alike(spark, tmp_path):
    for name in ("a b+c.md", "d.e.md", "백.md"):
        (tmp_path / name).write_text("---\ntitle: T\nspace_key: SEA\n---\nx")
    batch = sorted(r.source_id for r in markdown.read(spark, str(tmp_path)).collect())
    stream = ingest.stream_markdown(spark, str(tmp_path)).writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted(r.fallback for r in spark.table("files").collect()) == batch == ["a b+c", "d.e", "백"]


def test_preamble_and_sections(spark):
    rows = chunks(spark, "seen from shore\n\n## Humpback\n\nsings\n\n## Minke\n\nhides")
    assert [(r.heading, r.chunk_id) for r in rows] == [(None, "w7#0"), ("Humpback", "w7#1"), ("Minke", "w7#2")]
    assert rows[1].content == "## Humpback\n\nsings" and rows[1].embedding_text == "[North > Bay > Whale watch > Humpback]\n## Humpback\n\nsings"


def test_documents_with_one_key_are_not_mixed(spark):
    docs = spark.createDataFrame([("SEA", "k", "T", None, "# one\nalpha\nbeta"), ("SEA", "k", "T", None, "# two\ngamma\ndelta"), ("AIR", "k", "T", None, "own")], DOC)
    got = sorted((r.space_key, r.chunk_id, r.heading, r.content) for r in chunking.chunks(docs).collect())
    assert got == [("AIR", "k#0", None, "own"), ("SEA", "k#0", "two", "# two\ngamma\ndelta")]
    first = chunking.chunks(docs.withColumn("position", F.when(F.col("body").contains("one"), 2).otherwise(1))).where("space_key = 'SEA'").collect()
    assert [r.content for r in first] == ["# one\nalpha\nbeta"]


def test_nested_paths_and_level_jumps(spark):
    rows = chunks(spark, "# Whales\na\n## Song\nb\n# Seals\nc\n## Song\nd\n##### Pups\ne\n### Moult\nf")
    assert [r.heading for r in rows] == ["Whales", "Whales > Song", "Seals", "Seals > Song", "Seals > Song > Pups", "Seals > Song > Moult"]


def test_headings_in_fences_and_alone(spark):
    assert [r.heading for r in chunks(spark, "## Code\n~~~\n# comment\n~~~\nafter")] == ["Code"]
    assert [r.heading for r in chunks(spark, "# Bare\n\n## Kept\nkrill\n## Last")] == ["Bare > Kept"]


def test_oversize_sections_split(spark):
    body = "# Log\n" + "\n".join(f"{h:02d}:00{' spout' * (h % 9)}" for h in range(72))
    rows = chunks(spark, body, max_chars=300)
    assert [r.chunk_id for r in rows] == [f"w7#{i}" for i in range(len(rows))] and len(rows) > 5 and {r.heading for r in rows} == {"Log"}
    for one, two in zip(rows, rows[1:]):  # two lines are shared
        assert one.content.split("\n")[-2:] == two.content.split("\n")[:2]


def packed(lines, most, overlap=2):
    """The packing rule in plain Python."""
    if sum(len(x) + 1 for x in lines) <= most:
        return [lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i > start and sum(len(x) + 1 for x in lines[start : i + 1]) > most:
            out.append(lines[start:i])
            start = max(start, i - overlap)
    return [*out, lines[start:]]


def test_packing_against_plain_python(spark):
    rng = random.Random(5)
    cases = [["x" * rng.choice([0, 3, 10, 40, 90]) for _ in range(rng.randrange(1, 12))] for _ in range(150)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, lines array<string>")
    got = {r.i: r.p for r in df.select("i", chunking.pieces(F.col("lines"), 60).alias("p")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == packed(c, 60), c


def test_line_boundaries_as_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "\n\n", "a\n\nb\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    got = {i: [] for i in range(len(texts))}
    for r in chunking.lines(docs).orderBy("i", "pos").collect():
        got[r.i].append(r.line)
    assert [got[i] for i in range(len(texts))] == [t.splitlines() for t in texts]


def plain_vector(text, d):
    v = [0.0] * d
    for t in re.findall(r"\w+", text.lower()):
        h = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(h[:4], "big") % d] += 1 if h[4] % 2 == 0 else -1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def test_hashed_embedding(spark):
    texts = ["Krill krill blow", "", "고래 노래 a_b 12", "!!!", None, "é\u0301x ₂ ½ ー"]
    rows = embedding.hashed(spark.createDataFrame([(t,) for t in texts], "t string"), "t", dimension=32).collect()
    for r, t in zip(rows, texts):
        assert r.embedding == pytest.approx(plain_vector(t or "", 32))
    long = embedding.hashed_table(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), ["i"], "t", 32).collect()
    assert sorted((r.i, r.bucket, round(r.weight, 9)) for r in long) == [(i, b, round(x, 9)) for i, t in enumerate(texts) for b, x in enumerate(plain_vector(t or "", 32)) if x]


def test_model_embedding_and_retries(spark):
    class Lengths:
        dimension = 2

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r.embedding for r in embedding.by_model(df, "t", Lengths()).collect()] == [[2.0, 1.0], [0.0, 1.0]]

    class Busy(Exception):
        code = 503

    waits = []

    def busy(times):
        replies = [Busy()] * times
        def call():
            if replies:
                raise replies.pop()
            return ["done"]
        return call

    assert embedding.retried(busy(2), sleep=waits.append) == ["done"] and waits == [2.0, 4.0]
    with pytest.raises(Busy):
        embedding.retried(busy(3), sleep=waits.append)
    assert waits == [2.0, 4.0, 2.0, 4.0]
    with pytest.raises(KeyError):
        embedding.retried(lambda: {}["x"], sleep=waits.append)
    with pytest.raises(ValueError):
        embedding.retried(busy(0), attempts=0)
    assert len(waits) == 4


def test_equal_texts_are_embedded_once_over_runs(spark, tmp_path):
    asked = str(tmp_path / "asked")

    class Counting:
        dimension = 2

        def embed(self, texts):
            with open(asked, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

    def run(rows):
        df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "id int, t string, digest string").repartition(3)
        found = embedding.by_content(df, "t", Counting(), str(tmp_path / "vectors"))
        assert found.columns == ["id", "t", "digest", "embedding"]
        assert sorted((r.id, r.t or "", r.digest, tuple(r.embedding)) for r in found.collect()) == [(i, t or "", "clash", (float(len(t or "")), 1.0)) for i, t in enumerate(rows)]

    run(["whale", "krill", "whale", None, "", "whale"])
    run(["krill", "plankton", "krill"])
    run(["whale", ""])
    assert sorted(open(asked).read().split("\n")[:-1]) == ["", "krill", "plankton", "whale"]
    run([])
