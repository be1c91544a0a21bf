"""The table of chunks: immutable segments, delete vectors and a log of versions.

A write adds a segment, which holds its own rows and inverted tables, and a delete vector: which rows of older
segments are dead from then on. Both follow the size of the write, not that of the table. A version in the log names
the segments and delete vectors that make it, so readers see all of a write or nothing of it, and older versions
can be read until vacuum() removes them. Reads merge: the segments' rows without the dead ones. Once enough segments are of like
size they are merged to one, without their dead rows, and so are their inverted tables: searches always have an index.

Writers don't wait for each other. Each prepares its segment and tries to add the next version; one that finds
it taken looks at what came between. Where that touched a space of its own, it works out anew which rows die; else what it has
still holds. Then it tries again. So the result is that of some order of all writes. Rows have the key
(space_key, chunk_id).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions import fulltext as FT
from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.operators import retrieval
from spindrift.sources.commit_log import CommitLog, Files

SCHEMA = "space_key string, chunk_id string, source_id string, title string, heading string, breadcrumb string, content string, embedding array<float>, updated_at timestamp"
_COLUMNS = [x.split()[0] for x in SCHEMA.replace(", ", "\n").split("\n")]
_STORED = f"{SCHEMA}, norm double, terms map<string,array<int>>"
_DEAD = "segment string, space_key string, chunk_id string"
KEY = ["space_key", "chunk_id"]
_SOURCE = ["space_key", "source_id"]
#: Buckets of terms and trigrams in inverted tables, by which their rows are sorted.
BUCKETS = 64
#: Segments of like size that are merged to one, the share of dead rows from which a segment is rewritten, and how often a commit is tried.
FAN, DEAD_SHARE, TRIES = 8, 0.3, 50
#: The most sources of a write that its version lists one by one; of a larger write it lists spaces, and beyond as many spaces nothing, which stands for all.
MOST_LISTED = 1000


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with one key, the last by the column `position`."""
    turn = Window.partitionBy(*key).orderBy(F.col("position").desc())
    return rows.withColumn("__n", F.row_number().over(turn)).where("__n = 1").drop("__n", "position")


def merged(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """current with new's rows inserted, or in the place of those with their key."""
    return current.join(new.select(*key), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def without_source(rows: DataFrame, space_key: str, source_id: str) -> DataFrame:
    """rows but those of one source in one space."""
    return rows.where(~(F.col("space_key").eqNullSafe(space_key) & F.col("source_id").eqNullSafe(source_id)))


class ChunkStore:
    """Chunks under a folder that all executors share, with vectors of one dimension from one embedder."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int, embedder: str = "hashed", analyzer: str = "english", fan: int = FAN) -> None:
        self.spark, self.folder, self.dimension = spark, folder.rstrip("/"), dimension
        self.embedder, self.analyzer, self.fan = embedder, analyzer, fan
        self.files = Files(spark, self.folder)
        self.log = CommitLog(self.files)

    def ensure(self) -> None:
        """Makes an empty store where there is none; raises ValueError for another dimension or embedder."""
        version, state = self.log.state()
        if not version and not self.log.commit(1, {"dimension": self.dimension, "embedder": self.embedder, "analyzer": self.analyzer, "segments": [], "dead": [], "did": "create", "touched": []}):
            version, state = self.log.state()
        if state and (state["dimension"], state["embedder"]) != (self.dimension, self.embedder):
            raise ValueError(f"the store holds embeddings of dimension {state['dimension']} by {state['embedder']}")

    # reading

    def read(self, space_key: str | None = None, version: int | None = None) -> DataFrame:
        """The chunks of a version, by default the last, of one space or, for None or '', of all; with `terms`, positions by the store's analyzer."""
        return self._live(self.log.state(version)[1], space_key).drop("segment")

    def history(self) -> list[tuple[int, str, int]]:
        """version, what it did, and its number of live rows, of the versions that are still there."""
        out = []
        for v in self.log.versions():
            state = self.log.state(v)[1]
            out.append((v, state["did"], sum(s["rows"] - s["gone"] for s in state["segments"])))
        return out

    def _paths(self, state: dict, name: str) -> list[str]:
        return [f"{self.folder}/segments/{s['id']}/{name}" for s in state.get("segments", []) if s["rows"]]

    def _table(self, state: dict, name: str, schema: str) -> DataFrame:
        paths = self._paths(state, name)
        found = self.spark.read.schema(f"{schema}, segment string")
        return found.parquet(*paths) if paths else self.spark.createDataFrame([], f"{schema}, segment string")

    def _dead(self, state: dict) -> DataFrame | None:
        """The delete vectors of a version as one table, sent to every task where it has at most MOST_SENT rows."""
        vectors = state.get("dead", [])
        if not vectors:
            return None
        table = self.spark.read.schema(_DEAD).parquet(*(f"{self.folder}/{d['path']}" for d in vectors))
        return F.broadcast(table) if sum(d["rows"] for d in vectors) <= retrieval.MOST_SENT else table

    def _live(self, state: dict, space_key: str | None = None) -> DataFrame:
        rows = retrieval.in_space(self._table(state, "rows", _STORED), space_key)
        dead = self._dead(state)
        return rows if dead is None else rows.join(dead, ["segment", *KEY], "left_anti")

    def index(self, version: int | None = None) -> retrieval.Index | None:
        """The inverted tables of all segments of a version, with its delete vectors; None for an empty store."""
        state = self.log.state(version)[1]
        if not self._paths(state, "rows"):
            return None
        key = "space_key string, chunk_id string, bucket int"
        return retrieval.Index(self._table(state, "terms", f"term string, positions array<int>, n int, {key}"), self._table(state, "trigrams", f"trigram string, {key}"), BUCKETS, self._dead(state))

    def search(self, query_embedding: list[float], space_key: str | None = None, top_k: int = 5) -> DataFrame:
        retrieval.check_arguments(top_k, vector=query_embedding, dimension=self.dimension)
        return retrieval.search(self.read(space_key).drop("terms"), query_embedding, None, top_k)

    def search_hybrid(self, query_embedding: list[float], query_text: str, space_key: str | None = None, **options) -> DataFrame:
        retrieval.check_arguments(**{"top_k": retrieval.TOP_K, "candidate_k": retrieval.CANDIDATE_K} | options, vector=query_embedding, dimension=self.dimension)
        query = retrieval.one_query(self.spark, query_text, query_embedding)
        version = self.log.state()[0]  # rows and index of one version
        hits = retrieval.hybrid(self.read(space_key, version), query, space_key, analyzer=self.analyzer, index=self.index(version), **options)
        return hits.drop("updated_at").orderBy("ref")

    # writing

    def validate(self, chunks: DataFrame, sources: DataFrame | None = None) -> int:
        """The number of chunks; raises ValueError for a vector of another length, a chunk without key, or of none of the sources."""
        keyless = F.col("space_key").isNull() | F.col("chunk_id").isNull()
        wrong = F.coalesce(F.size("embedding"), F.lit(-1)) != self.dimension
        n, bad, no_key = chunks.agg(F.count("*"), F.count_if(wrong), F.count_if(keyless)).first()
        if bad:
            raise ValueError(f"{bad} chunks have an embedding whose dimension is not {self.dimension}")
        if no_key:
            raise ValueError(f"{no_key} chunks lack space_key or chunk_id")
        if sources is not None and (strange := chunks.join(sources, _SOURCE, "left_anti").count()):
            raise ValueError(f"{strange} chunks do not belong to the sources that are replaced")
        return n

    def _staged(self, chunks: DataFrame, sources: DataFrame | None) -> tuple[DataFrame, int, str]:
        """The batch as a table of its own, so that embeddings are made once; its number of rows; its name."""
        name = f"staged/{uuid.uuid4().hex}"
        fields = [F.col(c).cast("array<float>") if c == "embedding" else F.col(c) for c in _COLUMNS if c != "updated_at"]
        order = [F.col("position").cast("long").alias("position")] if "position" in chunks.columns else []
        chunks.select(*fields, *order).write.parquet(f"{self.folder}/{name}")
        batch = self.spark.read.parquet(f"{self.folder}/{name}")
        try:
            n = self.validate(batch, sources)
            if not order and batch.groupBy(*KEY).count().where("count > 1").limit(1).count():
                raise ValueError("chunks repeat a key: a column position must tell which is the last")
        except ValueError:
            self.files.remove(name)
            raise
        return batch, n, name

    def _segment(self, rows: DataFrame) -> dict:
        """Writes rows (with norms and terms) and their inverted tables as a new segment."""
        own = uuid.uuid4().hex
        folder = f"{self.folder}/segments/{own}"
        # sorted, so that Parquet's ranges tell spaces, buckets and terms apart; a large space spreads over several files
        rows.withColumn("segment", F.lit(own)).repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.parquet(f"{folder}/rows")
        written = self.spark.read.schema(f"{_STORED}, segment string").parquet(f"{folder}/rows")
        n = written.count()
        if n:
            for name, column, found in (("terms", "term", postings(written)), ("trigrams", "trigram", trigram_postings(written))):
                found = found.withColumn("bucket", retrieval.Index.bucket(column, BUCKETS)).withColumn("segment", F.lit(own))
                order = ["bucket", column, *KEY]
                found.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/{name}")
        else:
            self.files.remove(f"segments/{own}")
        return {"id": own, "rows": n, "gone": 0}

    def _touched(self, pairs: DataFrame) -> list | None:
        """The sources of a write as [space, source], of many the spaces as [space], of many of these None."""
        for columns in (_SOURCE, ["space_key"]):
            found = pairs.select(*columns).distinct().limit(MOST_LISTED + 1).collect()
            if len(found) <= MOST_LISTED:
                return [list(r) for r in found]
        return None

    def _killed(self, state: dict, touched: list | None, victims: Callable[[DataFrame], DataFrame]) -> tuple[list[dict], dict[str, int]]:
        """Writes the delete vector of the live rows that victims() picks; the vector if there are any, and their numbers by segment."""
        keys = self._live(state).select("segment", *KEY, "source_id")
        if touched is not None:  # files of other spaces are not read
            keys = keys.where(F.col("space_key").isin(sorted({t[0] for t in touched if t[0] is not None})))
        name = f"dead/{uuid.uuid4().hex}"
        victims(keys).select("segment", *KEY).distinct().write.parquet(f"{self.folder}/{name}")
        counts = {r[0]: r[1] for r in self.spark.read.schema(_DEAD).parquet(f"{self.folder}/{name}").groupBy("segment").count().collect()}
        if not counts:
            self.files.remove(name)
            return [], {}
        return [{"path": name, "rows": sum(counts.values()), "segments": sorted(counts)}], counts

    def _commit(self, did: str, segment: dict | None, touched: list | None, victims: Callable[[DataFrame], DataFrame]) -> int:
        """Adds a version with a segment and without the rows that victims() picks of the others; returns how many these are."""
        vectors: list[dict] = []
        counts: dict[str, int] = {}
        base = -1
        for _ in range(TRIES):
            version, state = self.log.state()
            if base < 0 or self._met(base, version, touched, counts):
                for v in vectors:
                    self.files.remove(v["path"])
                vectors, counts = self._killed(state, touched, victims)
            base = version
            segments = [s | {"gone": s["gone"] + counts.get(s["id"], 0)} for s in state["segments"]]
            segments = [s for s in segments if s["gone"] < s["rows"]]  # one that is all dead goes
            there = {s["id"] for s in segments}
            dead = [d for d in state["dead"] + vectors if there & set(d["segments"])]
            new = state | {"segments": segments + ([segment] if segment and segment["rows"] else []), "dead": dead, "did": did, "touched": touched}
            if self.log.commit(version + 1, new):
                return sum(counts.values())
        raise RuntimeError(f"{TRIES} other writers came first")

    def _met(self, base: int, version: int, touched: list | None, counts: dict[str, int]) -> bool:
        """Whether what came after version `base` may change which rows a write kills: it touched the write's spaces or merged segments that it counts on."""
        spaces = None if touched is None else {t[0] for t in touched}
        for v in range(base + 1, version + 1):
            try:
                state = self.log.state(v)[1]
            except ValueError:  # forgotten meanwhile
                return True
            if not set(counts) <= {s["id"] for s in state["segments"]}:
                return True
            other = state["touched"]
            if other != [] and (other is None or spaces is None or spaces & {t[0] for t in other}):
                return True
        return False

    def _write(self, did: str, batch: DataFrame, sources: DataFrame | None) -> None:
        analyzer = self.log.state()[1]["analyzer"]
        new = latest(batch, KEY) if "position" in batch.columns else batch
        segment = self._segment(with_norms(new.withColumn("updated_at", F.current_timestamp())).withColumn("terms", FT.term_positions(F.col("content"), analyzer)))
        own = batch.select(*KEY).distinct()
        pairs = batch.select(*_SOURCE) if sources is None else sources

        def victims(keys: DataFrame) -> DataFrame:
            same = keys.join(own, KEY, "left_semi")
            return same if sources is None else same.unionByName(keys.join(sources, _SOURCE, "left_semi"))

        self._commit(did, segment, self._touched(pairs), victims)
        self.compact()

    def replace_sources(self, sources: DataFrame, chunks: DataFrame) -> int:
        """Puts chunks in the place of all chunks of sources(space_key, source_id), in one atomic write.

        A source without chunks is deleted. Returns the number of chunks.
        """
        sources = sources.select(*_SOURCE).distinct()
        batch, n, name = self._staged(chunks, sources)
        self._write("replace", batch, sources)
        self.files.remove(name)
        return n

    def replace_source(self, space_key: str, source_id: str, chunks: DataFrame) -> int:
        """The same for one source."""
        return self.replace_sources(self.spark.createDataFrame([(space_key, source_id)], "space_key string, source_id string"), chunks)

    def upsert(self, chunks: DataFrame) -> int:
        """Inserts chunks, or replaces those with their key, in one atomic write. Returns their number.

        Of chunks with one key the one with the largest position counts; without that column, keys that repeat raise ValueError.
        """
        batch, n, name = self._staged(chunks, None)
        self._write("upsert", batch, None)
        self.files.remove(name)
        return n

    def delete_source(self, space_key: str, source_id: str) -> int:
        """Removes a source from one space; returns how many chunks went."""
        own = (F.col("space_key") == space_key) & (F.col("source_id") == source_id)
        if self._live(self.log.state()[1], space_key).where(own).limit(1).count() == 0:
            return 0
        return self._commit("delete", None, [[space_key, source_id]], lambda keys: keys.where(own))

    # upkeep

    def _due(self, state: dict) -> list[str]:
        """Segments to be merged now: `fan` and more of one order of size, and those of which too much is dead."""
        live = {s["id"]: s["rows"] - s["gone"] for s in state["segments"]}
        tiers: dict[int, list[str]] = {}
        for i, n in live.items():
            tiers.setdefault(int(math.log(max(n, 1), self.fan)), []).append(i)
        for tier in sorted(tiers):
            if len(tiers[tier]) >= self.fan:
                return tiers[tier]
        return [s["id"] for s in state["segments"] if s["gone"] > DEAD_SHARE * s["rows"]]

    def compact(self, everything: bool = False) -> int:
        """Merges segments that are due, or all of them, to one without their dead rows; returns how many were merged.

        Rows are written once for each order of size that they pass. What other writers delete of the merged segments
        meanwhile makes it start again.
        """
        done = 0
        for _ in range(TRIES):
            version, state = self.log.state()
            due = [s["id"] for s in state["segments"]] if everything else self._due(state)
            if not due or (everything and len(due) == 1 and not state["dead"]):
                return done
            own = state | {"segments": [s for s in state["segments"] if s["id"] in due]}
            one = self._segment(self._live(own).drop("segment"))
            while True:
                rest = [s for s in state["segments"] if s["id"] not in due]
                there = {s["id"] for s in rest}
                dead = [d for d in state["dead"] if there & set(d["segments"])]
                new = state | {"segments": rest + ([one] if one["rows"] else []), "dead": dead, "did": "compact", "touched": []}
                if self.log.commit(version + 1, new):
                    done += len(due)
                    break
                before = {s["id"]: s["gone"] for s in state["segments"] if s["id"] in due}
                version, state = self.log.state()
                if before != {s["id"]: s["gone"] for s in state["segments"] if s["id"] in due}:  # of the merged rows some have died
                    self.files.remove(f"segments/{one['id']}")
                    break
            if everything and done:
                return done
        raise RuntimeError(f"{TRIES} other writers came first")

    def vacuum(self, keep: int = 1) -> int:
        """Forgets all versions but the last `keep` and removes folders that none of these reads; returns their number.

        Readers of forgotten versions, and writers that have not yet committed, lose theirs.
        """
        versions = self.log.versions()[-max(keep, 1) :]
        states = [self.log.state(v)[1] for v in versions]
        used = {"segments": {s["id"] for state in states for s in state["segments"]}, "dead": {d["path"].split("/")[1] for state in states for d in state["dead"]}, "staged": set()}
        self.log.forget(versions[0] if versions else 0)
        gone = 0
        for folder, names in used.items():
            for name in self.files.names(folder):
                if name not in names:
                    self.files.remove(f"{folder}/{name}")
                    gone += 1
        return gone


def postings(chunks: DataFrame) -> DataFrame:
    """term, space_key, chunk_id, positions, n (their number): the inverted table of `terms`."""
    return chunks.select(*KEY, F.explode("terms").alias("term", "positions")).select("term", *KEY, "positions", F.size("positions").alias("n"))


def trigram_postings(chunks: DataFrame) -> DataFrame:
    """trigram, space_key, chunk_id: the inverted table of contents' trigrams."""
    return chunks.select(F.explode(T.trigram_set(F.col("content"))).alias("trigram"), *KEY)


def with_norms(chunks: DataFrame) -> DataFrame:
    """chunks with the lengths of their vectors."""
    return chunks.withColumn("norm", V.norm(V.doubles(F.col("embedding"))))
