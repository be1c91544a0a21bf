"""Nearest vectors of a block of queries by matrix products, with the distances that the Column functions give.

A product tells which pairs can be among a query's k nearest; these are worked out once more term by term in the order of
vectors.cosine_distance(), so distances and ties are the same to the last bit. A task keeps the k best of each query
of all that it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["space_key", "chunk_id"]
#: Vectors and queries that are multiplied at once; what a product's distances may be off by rounding.
ROWS, QUERIES, OFF = 5000, 512, 1e-9
#: Lengths between which neither a product nor a square overflows or vanishes.
SHORT, LONG = 1e-150, 1e150


class Vectors(NamedTuple):
    """Vectors x of one width with their lengths: plain ones, odd ones of extreme length, and blank ones that have no distance (zero, null or with a null)."""

    x: np.ndarray
    norms: np.ndarray
    plain: np.ndarray
    odd: np.ndarray

    @staticmethod
    def of(lists: pa.Array, norms: pa.Array, width: int) -> tuple[Vectors, np.ndarray]:
        """The vectors, zeros where they can't be used, and which are of another width."""
        n = norms.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        fits = (size == width) & ((n > 0) | np.isnan(n))
        x = np.zeros((len(n), width))
        if fits.any():
            x[fits] = lists.filter(pa.array(fits)).flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
        plain = fits & (n > SHORT) & (n < LONG)
        return Vectors(x, n, plain, fits & ~plain), (size >= 0) & (size != width) & (n > 0)


def distances(v: Vectors, q: Vectors, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of the a-th of v and the b-th of q, pair by pair, summed as the Column functions sum."""
    dot = np.zeros(len(a))
    for i in range(v.x.shape[1]):
        dot += v.x[a, i] * q.x[b, i]
    lengths = v.norms[a] * q.norms[b]
    with np.errstate(all="ignore"):
        return np.where((lengths > 0) | np.isnan(lengths), 1.0 - dot / lengths, np.nan)


def _best(query: np.ndarray, distance: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which come among the first k of their query by distance, NaN last, and place."""
    lost = np.isnan(distance)
    order = np.lexsort((place, np.where(lost, 0.0, distance), lost, query))
    own = query[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)])) < k]


class _Kept:
    """The k best of each query so far, a null distance as minus infinity."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.parts, self.held = n, k, [], 0
        self.limit = np.full(n, np.inf)

    def add(self, query: np.ndarray, distance: np.ndarray, row: np.ndarray, keys: pa.Table) -> None:
        best = _best(query, distance, row, self.k)
        self.parts.append((query[best], distance[best], keys.take(pa.array(row[best]))))
        self.held += len(best)

    def settle(self) -> None:
        query, distance = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        keys = pa.concat_tables([p[2] for p in self.parts]).combine_chunks()
        place = np.empty(len(query), np.int64)
        place[pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in KEY], null_placement="at_start").to_numpy()] = np.arange(len(query))
        best = _best(query, distance, place, self.k)
        self.parts, self.held = [(query[best], distance[best], keys.take(pa.array(best)))], len(best)
        last = np.r_[query[best][1:] != query[best][:-1], True] if len(best) else np.zeros(0, bool)
        full = np.bincount(query[best], minlength=self.n) >= self.k
        kth = np.full(self.n, np.inf)
        kth[query[best][last]] = distance[best][last]
        self.limit = np.where(full & ~np.isnan(kth), kth, np.inf)


def _given(kept: _Kept, table: pa.Table, name: str) -> Iterator[pa.RecordBatch]:
    """What was kept, with the queries' ids."""
    if not kept.parts:
        return
    kept.settle()
    query, distance, keys = kept.parts[0]
    far, ids = pa.array(distance, mask=np.isneginf(distance)), table["query_id"].combine_chunks()
    for i in range(0, len(query), 10_000):
        own = keys.slice(i, 10_000).combine_chunks()
        columns = [ids.take(pa.array(query[i : i + 10_000])), *(own[c].combine_chunks() for c in KEY), far.slice(i, 10_000)]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["query_id", *KEY, name])


def nearest(vectors: DataFrame, asked: DataFrame, k: int, touched: Callable[[np.ndarray, np.ndarray, pa.Table], np.ndarray] | None = None, numbers: np.ndarray | None = None) -> DataFrame:
    """query_id, key, distance: of each task's vectors(key, v, n, cell if `touched`) the k nearest of each of asked(query_id, q, m, ...).

    asked goes to every task: its caller bounds the number of its rows. v and q are arrays of double, n and m their lengths.
    touched(x, lengths, asked's rows) tells which cells of `numbers` (ascending) a query has to look at: a row for each query.
    """
    spark, kind = vectors.sparkSession, asked.schema["query_id"].dataType.simpleString()
    columns = [*KEY, "v", "n"] + (["cell"] if touched else [])
    shape = f"query_id {kind}, space_key string, chunk_id string, distance double"
    table = asked.toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        lists = table["q"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
        groups = []
        for width in np.unique(sizes):
            at = np.flatnonzero(sizes == width)
            own = table.take(pa.array(at))
            q, _ = Vectors.of(own["q"].combine_chunks(), own["m"].combine_chunks(), max(int(width), 0))
            groups.append((at, q, touched(q.x, q.norms, own) if touched else None))
        kept = _Kept(len(table), k)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                block = pa.Table.from_batches([batch.slice(i, ROWS)])
                block = block.take(pc.sort_indices(block, sort_keys=[(c, "ascending") for c in KEY], null_placement="at_start")).combine_chunks()
                for group in groups:
                    _meet(kept, block, *group)
                if kept.held > 3 * k * max(len(table), 1) or not np.isfinite(kept.limit).any():
                    kept.settle()
        yield from _given(kept, table, "distance")

    def _meet(kept: _Kept, block: pa.Table, at: np.ndarray, q: Vectors, looks: np.ndarray | None) -> None:
        keys = block.select(KEY)
        v, other = Vectors.of(block["v"].combine_chunks(), block["n"].combine_chunks(), q.x.shape[1])
        cell = np.searchsorted(numbers, block["cell"].to_numpy()) if looks is not None else None
        here = np.unique(cell) if cell is not None else None

        def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return looks[b, cell[a]] if looks is not None else np.ones(len(a), bool)

        def pairs(a: np.ndarray, b: np.ndarray, distance: np.ndarray | float | None = None) -> None:
            """Of all pairs of rows a and queries b those that are allowed."""
            a, b = np.tile(a, len(b)), np.repeat(b, len(a))
            good = allowed(a, b)
            a, b = a[good], b[good]
            if len(a):
                kept.add(at[b], distances(v, q, a, b) if distance is None else np.full(len(a), distance), a, keys)

        k, rows, good = kept.k, np.flatnonzero(v.plain), np.flatnonzero(q.plain)
        if here is not None:
            good = good[looks[np.ix_(good, here)].any(1)]
        xt = v.x[rows]
        for i in range(0, len(good) if len(rows) else 0, QUERIES):
            some = good[i : i + QUERIES]
            near = 1.0 - (q.x[some] / q.norms[some][:, None]) @ (xt / v.norms[rows][:, None]).T
            if looks is not None:
                near[~looks[np.ix_(some, cell[rows])]] = np.inf
            limit = kept.limit[at[some]]
            free = np.flatnonzero((near <= limit[:, None] + OFF).sum(1) > 4 * k)
            if len(free) and near.shape[1] > k:
                limit[free] = np.minimum(limit[free], np.partition(near[free], k - 1, axis=1)[:, k - 1] + OFF)
            b, a = np.nonzero((near <= limit[:, None] + OFF) & np.isfinite(near))
            a, b = rows[a], some[b]
            kept.add(at[b], distances(v, q, a, b), a, keys)
        odd, strange = np.flatnonzero(v.odd), np.flatnonzero(q.odd)
        usable, full = np.flatnonzero(v.plain | v.odd), np.flatnonzero(q.plain | q.odd)
        for b in full if len(odd) else ():
            pairs(odd, np.array([b]))
        for b in strange:
            pairs(rows, np.array([b]))
        # what has no distance comes last: the first k by key will do; another width gives null, which comes first
        blank = np.setdiff1d(np.arange(len(keys)), np.r_[usable, np.flatnonzero(other)])
        open_ = full[np.isinf(kept.limit[at[full]])]
        if looks is None:
            if len(blank) and len(open_):
                pairs(blank[:k], open_)
            lost = np.setdiff1d(np.arange(len(q.norms)), full)
            if len(lost):
                pairs(np.arange(min(k, len(keys))), lost, np.nan)
            if other.any() and len(full):
                pairs(np.flatnonzero(other)[:k], full, -np.inf)

    return vectors.select(*columns).mapInArrow(run, shape)


def closest(values: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, key, gap: of each task's values(key, x double) the k with the smallest |x - y| of each of asked(query_id, y double), null first, NaN last.

    asked goes to every task: its caller bounds the number of its rows.
    """
    kind = asked.schema["query_id"].dataType.simpleString()
    sent = values.sparkSession.sparkContext.broadcast(asked.toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        y, absent = table["y"].fill_null(0.0).to_numpy(), table["y"].is_null().to_numpy()
        kept = _Kept(len(table), k)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                block = pa.Table.from_batches([batch.slice(i, ROWS)])
                block = block.take(pc.sort_indices(block, sort_keys=[(c, "ascending") for c in KEY], null_placement="at_start")).combine_chunks()
                x, lost = block["x"].fill_null(0.0).to_numpy(), block["x"].is_null().to_numpy()
                for j in range(0, len(y), QUERIES):
                    s = slice(j, j + QUERIES)
                    with np.errstate(invalid="ignore"):
                        gap = np.abs(x[None, :] - y[s, None])
                    gap[:, lost] = -np.inf
                    gap[absent[s]] = -np.inf
                    limit = kept.limit[s].copy()
                    free = np.flatnonzero((gap <= limit[:, None]).sum(1) > 4 * k)
                    if len(free) and gap.shape[1] > k:
                        limit[free] = np.minimum(limit[free], np.partition(gap[free], k - 1, axis=1)[:, k - 1])  # NaN sorts last
                    limit = np.where(np.isnan(limit), np.inf, limit)
                    nowhere = np.isnan(gap)
                    some = (gap <= limit[:, None]) | (nowhere & (np.cumsum(nowhere, axis=1) <= k) & np.isinf(kept.limit[s])[:, None])
                    b, a = np.nonzero(some)
                    kept.add(b + j, gap[b, a], a, block.select(KEY))
                if kept.held > 3 * k * max(len(table), 1) or not np.isfinite(kept.limit).any():
                    kept.settle()
        yield from _given(kept, table, "gap")

    return values.select(*KEY, "x").mapInArrow(run, f"query_id {kind}, space_key string, chunk_id string, gap double")
