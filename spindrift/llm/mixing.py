"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a pseudo-random order that follows from doc_id alone, make blocks. Block j
(from 1) of a source with weight w is released at slot floor((j - 1) / w) and due by slot ceil(j / w); in
each slot the released block with the earliest deadline runs. Weights add up to one, so every block meets
its deadline and no prefix of slots holds a block more or less of a source than its weight asks for.

With whole weights that add up to a period, the schedule repeats after it. The driver lays out one period, of
a bounded number of slots; where a document goes is then arithmetic
on its number in its source. A source that ends leaves its slots out; no document is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents in a block, slots in a period at least and at most, the flattening of sizes to weights, and the most sources.
BLOCK, PERIOD, MOST_PERIOD, FLATTEN, MOST_SOURCES = 16, 1000, 1 << 18, 0.5, 20_000
#: Hexadecimal digits of md5 that split a source for numbering.
_DIGITS = 3


def whole_weights(sizes: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole weights in proportion to sizes that add up to a period, 1 at least; the largest remainders round up.

    The period grows to ten times the number of sources where it is shorter.
    """
    if not sizes:
        return {}
    if min(sizes.values()) <= 0:
        raise ValueError("weights must be positive")
    period = max(period, 10 * len(sizes))
    total = sum(sizes.values())
    exact = {k: period * v / total for k, v in sizes.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    over = sum(out.values()) - period
    if over < 0:  # fewer slots than sources are missing
        for k in sorted(sizes, key=lambda k: (out[k] - exact[k], k))[:-over]:
            out[k] += 1
    waiting = [(-n, k) for k, n in out.items()]
    heapq.heapify(waiting)
    for _ in range(over):  # sources that were raised to one slot: the largest make room
        n, k = heapq.heappop(waiting)
        out[k] = -n - 1
        heapq.heappush(waiting, (n + 1, k))
    return out


def schedule(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of a period: the earliest deadline among released blocks, ties by source."""
    period = sum(weights.values())
    waiting = [(0, k, 1) for k in sorted(weights)]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // weights[k]), k, j))
        deadline, k, j = heapq.heappop(ready)
        if deadline <= slot:
            raise RuntimeError("a deadline passed")
        out.append(k)
        if j < weights[k]:
            heapq.heappush(waiting, (j * period // weights[k], k, j + 1))
    return out


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def target_weights(docs: DataFrame, flatten: float = FLATTEN, period: int | None = None, block: int = BLOCK) -> dict[str, int]:
    """Whole weights for the sources in docs, in proportion to their numbers of rows to the power `flatten`.

    The period is by default as long as the whole mixture, from PERIOD to MOST_PERIOD slots. Weights are within
    one slot of a period of their targets, so a source is within two blocks of its target in a prefix as long
    as a period, and within one more for each further period.
    """
    rows = docs.groupBy(_source().alias("source")).count().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if period is None:
        period = min(max(PERIOD, sum(-(-r["count"] // block) for r in rows)), MOST_PERIOD)
    return whole_weights({r["source"]: float(r["count"]) ** flatten for r in rows}, period)


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """docs with block_no long, slot long, in_block int beside its own columns: its place in the mixture.

    The mixture is docs ordered by (slot, in_block). weights gives each source a whole number, by default
    target_weights(docs). A null source is the source ''; one without a weight fails the job. Within a
    source, documents come by (md5 of doc_id, doc_id, text), null doc_ids by their texts' md5; the order of repeated
    rows among themselves is open and makes no difference. Columns named as the new ones are replaced. No
    rows give no rows. Only rows of one source and one of 4,096 parts of it are numbered together.
    """
    names = [c for c in docs.columns if c not in ("block_no", "slot", "in_block")]
    weights = dict(weights) if weights is not None else target_weights(docs, block=block)
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights must be whole numbers from 1")
    slots = schedule(weights) if weights else []
    period = max(1, len(slots))
    where: dict[str, list[int]] = {k: [] for k in weights}
    for slot, k in enumerate(slots):
        where[k].append(slot)
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, len(v), v) for k, v in where.items()], "__source string, __weight long, __slots array<long>")  # a period's slots

    own_text = F.coalesce(F.col("text").cast("string"), F.lit("")) if "text" in names else F.lit("")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), own_text)))
    part = F.substring(order, 1, _DIGITS)
    own = docs.select(*names, _source().alias("__source"), order.alias("__order"), part.alias("__part"))
    sizes = own.groupBy("__source", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__source", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))  # 4,096 rows of a source at most
    inside = Window.partitionBy("__source", "__part").orderBy("__order", "doc_id", *(["text"] if "text" in names else []))
    numbered = own.withColumn("__number", F.row_number().over(inside).cast("long") - 1)
    placed = numbered.join(starts, ["__source", "__part"]).join(F.broadcast(table), "__source", "left")
    number = F.col("__number") + F.col("__start")
    block_no = F.floor(number / block).cast("long")
    known = F.when(F.col("__weight").isNull(), F.raise_error(F.concat(F.lit("no weight for source "), F.col("__source")))).otherwise(F.col("__weight"))
    slot = F.floor(block_no / known).cast("long") * period + F.element_at("__slots", (F.pmod(block_no, known) + 1).cast("int"))
    return placed.select(*names, block_no.alias("block_no"), slot.alias("slot"), F.pmod(number, F.lit(block)).cast("int").alias("in_block"))


def mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs in the order of the mixture, with its own columns, those named as mix()'s too.

    A writer keeps that order by file and row, but a reader that splits files does not: mix() of the same rows gives their places again.
    """
    own = {c: f"__own_{c}" for c in ("block_no", "slot", "in_block") if c in docs.columns}
    out = mix(docs.withColumnsRenamed(own), weights, block).orderBy("slot", "in_block").drop("block_no", "slot", "in_block")
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
