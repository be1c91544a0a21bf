"""The SQL guard, the registry, and streaming ingest."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import embedding, sql
from spindrift.plans import guard, registry
from spindrift.sources import markdown, shared, warehouse
from spindrift.sources.chunk_store import ChunkStore
from spindrift.streaming import ingest, windows


@pytest.mark.parametrize("sql", ["sElEcT 7 AS lucky", "WITH far AS (SELECT 9 AS n) SELECT n FROM far", "-- the harbour's ships\n  SELECT name FROM ships -- drop it", "SELECT name FROM ships ;;  ", "SELECT created, call_sign, updates FROM ships"])
def test_statements_that_pass(sql):
    assert guard.static_error(sql) is None


@pytest.mark.parametrize("sql, word", [
    ("TRUNCATE TABLE ships", "SELECT"), ("(SELECT name FROM ships)", "SELECT"), ("", "SELECT"), ("-- SELECT", "SELECT"), ("SELECT 7; ;", "multiple"), ("SELECT ';' AS c", "multiple"), ("DROP TABLE ships; SELECT 7", "SELECT"),
    ("SELECT name AS call FROM ships", "read-only"), ("SELECT 'please GRANT me'", "read-only"), ("WITH x AS (SELECT 1) MERGE INTO ships", "read-only"), ("SELECT a--;\n;delete", "multiple"),
])
def test_statements_that_do_not(sql, word):
    assert word in guard.static_error(sql)


def test_databases_from_the_environment(monkeypatch):
    monkeypatch.setenv(guard.DATASETS, " a.b , c ,, d e")
    assert guard.allow_listed() == ["a.b", "c", "d e"]
    monkeypatch.delenv(guard.DATASETS)
    assert guard.allow_listed() == ["spark_catalog.default"]


def test_only_built_in_functions(spark, tables):
    own = spark.newSession()
    own.udf.register("ship_udf", lambda x: x, "long")
    own.udf.register("upper", lambda x: "shadowed")
    for statement in ("SELECT ship_udf(id) FROM shop.orders", "SELECT upper('a') AS a", "SELECT * FROM shop.orders WHERE id IN (SELECT ship_udf(1))", "SELECT version()"):
        assert "not allowed" in guard.run(own, statement, tables)["error"]
    assert guard.run(own, "SELECT n FROM range(3) AS r(n) ORDER BY lower(string(n))", tables)["row_count_returned"] == 3
    assert guard.run(spark, "SELECT upper('a') AS a", tables)["rows"] == [{"a": "A"}]


@pytest.mark.parametrize("kind", ["csv", "json", "orc"])
def test_files_of_other_formats(spark, tmp_path, kind):
    rows = spark.range(9).selectExpr("id", "concat('n', id) as name")
    rows.write.format(kind).option("header", True).save(str(tmp_path / kind))
    found = guard.checked(spark, "SELECT count(*) AS n FROM ships", {"ships": str(tmp_path / kind)}, {"ships": kind}).first()
    assert found.n in (9, 9 + len(list((tmp_path / kind).glob("*.csv"))))  # a header counts where no option says that it is one


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("""SELECT cosine_distance(array(1D, 0D), array(0D, 2D)) AS d, isnan(cosine_distance(array(0D), array(1D))) AS z, trigram_set('Cat') AS t, trigram_similarity('cat', 'cat') AS s,
        rrf(60, array(1, null, 3)) AS r, word_similarity('word', 'two words') AS w, hashed_embedding('a b', 8) AS e, vector_norm(array(3D, 4D)) AS n""").first()
    assert row.d == 1.0 and row.z and row.t == ["  c", " ca", "cat", "at "] and row.s == 1.0 and row.r == pytest.approx(1 / 61 + 1 / 63) and row.w == pytest.approx(0.8) and row.n == 5.0
    plain = embedding.hashed(spark.createDataFrame([("a b",)], "t string"), "t", dimension=8).first().embedding
    assert list(row.e) == plain


@pytest.fixture(scope="module")
def tables(spark):
    spark.sql("create database if not exists shop")
    spark.sql("create database if not exists secret")
    spark.range(60).selectExpr("id", "id % 3 as k", "cast(null as string) as n").write.mode("overwrite").saveAsTable("shop.orders")
    spark.range(5).write.mode("overwrite").saveAsTable("secret.keys")
    return ["spark_catalog.shop"]


def test_runs_and_caps(spark, tables):
    out = guard.run(spark, "SELECT id, n FROM shop.orders ORDER BY id", tables)
    assert out["referenced_tables"] == ["spark_catalog.shop.orders"] and out["row_count_returned"] == 50 and out["rows"][0] == {"id": "0", "n": "None"} and out["estimated_bytes"] > 0
    with pytest.raises(ValueError, match="bytes"):
        guard.run(spark, "SELECT * FROM shop.orders", tables, max_bytes=1)
    assert guard.run(spark, "SELECT 1 AS one", tables)["rows"] == [{"one": "1"}]
    (row,) = warehouse.tables(spark, ["shop"]).collect()
    assert row["columns"] == ["id:bigint", "k:bigint", "n:string"] and row["rows"] == 60


@pytest.mark.parametrize("sql", [
    "SELECT * FROM secret.keys", "SELECT * FROM shop.orders o WHERE EXISTS (SELECT 1 FROM secret.keys s WHERE s.id = o.id)", "SELECT * FROM shop.orders WHERE id IN (SELECT id FROM secret.keys)",
    "WITH x AS (SELECT * FROM secret.keys) SELECT * FROM x", "SELECT (SELECT max(id) FROM secret.keys) AS m FROM shop.orders", "WITH t AS (SELECT 1) FROM secret.keys SELECT *",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT java_method('java.lang.System', 'nanoTime') FROM shop.orders",
])
def test_ways_around_are_closed(spark, tables, sql):
    assert "error" in guard.run(spark, sql, tables)


def test_files_are_not_tables(spark, tables, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)not.*found|unsupported|cannot"):
        guard.run(spark, f"SELECT * FROM parquet.`{tmp_path}/x`", tables)


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 40


def test_streaming_ingest(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("---\ntitle: A\nspace_key: S\n---\n## One\ntext\n## Two\nmore")
    store = ChunkStore(spark, str(tmp_path / "store"), 8)
    store.ensure()
    ingest.ingest(markdown.parse(ingest.stream_markdown(spark, str(docs))), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.chunk_id for r in store.read("S").collect()) == ["a#0", "a#1"]
    (docs / "b.md").write_text("---\ntitle: B\nspace_key: S\n---\njust text")
    ingest.ingest(markdown.parse(ingest.stream_markdown(spark, str(docs))), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.chunk_id for r in store.read("S").collect()) == ["a#0", "a#1", "b#0"]


def test_windows_over_a_stream(spark, tmp_path):
    """Several batches, late events and ones that are too late, against a plain count of what came in time."""
    source = tmp_path / "events"
    source.mkdir()
    batches = [[("a", "2024-01-01 00:10:00", 1.0), ("b", "2024-01-01 00:20:00", 2.0)], [("a", "2024-01-01 02:30:00", 4.0), ("a", "2024-01-01 00:50:00", 8.0)], [("b", "2023-12-31 00:00:00", 16.0), ("a", "2024-01-01 02:40:00", 32.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(source / f"n{i}"))
        stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("recursiveFileLookup", True).parquet(str(source))
        windows.keep_latest(windows.totals(stream, late="2 hours"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = sorted((r.event_type, r.start.hour, r.n, r.total) for r in windows.latest(spark.read.parquet(str(tmp_path / "out"))).collect())
    assert got == [("a", 0, 2, 9.0), ("a", 2, 2, 36.0), ("b", 0, 1, 2.0)]


def test_shared_folder(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_sketches_beside_distinct_keys(spark, tmp_path):
    """No row may hold a customer and a price, or every customer has sketches of prices to be merged one by one (F6); the aggregates are as over the plain table."""
    rows = [("F", i % 700, float(i * 37 % 5003)) for i in range(6000)] + [("O", None, 5.0), ("O", None, 7.0), (None, 3, 1.0), (None, 3, None), (None, 4, 2.0), ("P", 9, None), ("N", None, None), ("F", 1, float("nan"))]
    spark.createDataFrame(rows, "o_orderstatus string, o_custkey long, o_totalprice double").repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    for name in set(registry._TABLES) - {"orders"}:
        spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    query = registry.queries()["guarded_sql_approx"](spark, str(tmp_path))
    assert query.sparkSession.table("orders").where("o_custkey is not null and o_totalprice is not null").isEmpty()
    statement = """SELECT o_orderstatus, approx_count_distinct(o_custkey, 0.01) AS a, count(DISTINCT o_custkey) AS d, approx_percentile(o_totalprice, 0.5, 10000) AS p, median(o_totalprice) AS m, count(o_totalprice) AS n
        FROM orders GROUP BY o_orderstatus"""
    views = {"orders": str(tmp_path / "orders.parquet")}
    told = {"layouts": registry._LAYOUTS["guarded_sql_approx"], "settings": registry._SETTINGS["guarded_sql_approx"]}
    plain, apart = ({r.o_orderstatus: r for r in guard.checked(spark, statement, views, **more).collect()} for more in ({}, told))
    assert len(apart) == 5 and set(plain) == set(apart)
    for k, r in apart.items():
        assert [r.a, r.d, r.m, r.n] == [plain[k].a, plain[k].d, plain[k].m, plain[k].n] and (r.p == plain[k].p or abs(r.p - r.m) <= 0.001 * r.m), k
    assert sorted(map(str, query.collect())) == sorted(map(str, guard.checked(spark, registry._GUARDED_TWICE["guarded_sql_approx"][0], views).collect()))
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"
