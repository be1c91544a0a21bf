"""N-gram Jaccard join by count-vector R-trees.

A document is its set of distinct word shingles, as 64-bit hashes. Two documents link when
den * |A & B| >= num * |A | B|. No link is lost and no pair that doesn't link makes one.

1. Texts with the same set are one node, named by a hash of the set, so copies are never compared.
2. Dealing out. A tree over all sets would be one machine's work, so exact keys first bring together what can
   link. Sizes fall in bands, growing by a factor below num / den. If the larger of two linked sets lies in a
   band, they differ in at most d shingles (d follows from the band's upper edge). With shingles dealt
   to d + 1 + s classes by hash, at least s + 1 classes hold the same shingles in both. A node's keys are its
   classes' contents, in its own band and, where a partner can be there, the next one. Of these it leaves
   out the s that most nodes have, empty classes before all others: in any order that is the same for all nodes, two
   that share s + 1 keys still share one. Passages of many documents make such keys, so they gather no groups.
3. Candidates. In each group of nodes that share a key, an R-tree over count vectors (how many shingles hash
   to each dimension) finds the pairs that can link: the sum over dimensions of the smaller count bounds
   an overlap, that of the smaller upper edge bounds the overlaps between two boxes. Each task reports a
   spanning forest of its pairs, so rows stay in proportion to members. Components of these are clusters.
4. Links. Every cluster gets each member's whole set once. A finer R-tree in the cluster finds pairs again,
   and the sets themselves decide, until every pair has been pruned, verified or is inside one component.

Groups and clusters beyond a block are dealt to blocks twice, in two random ways; where that leaves more than one
component, all pairs of blocks that hold different ones are searched too.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._shared import components, saved, scratch
from spindrift.llm._words import U64, chunks, distinct, mix, shingle_hashes, word_hashes

#: Shingles for each dimension of a group's count vectors, children of a box, nodes and shingles of a block.
PER_DIMENSION, FAN, BLOCK, BLOCK_SHINGLES = 4, 16, 8192, 4 << 20
#: Bytes of count vectors that are compared at once, and groups that need no tree.
_AT_ONCE, _FLAT = 1 << 22, 24
_GROWTH = 0.6


class Rule:
    """Link when den * |A & B| >= num * |A | B|; shingles of `words` words."""

    def __init__(self, words: int, num: int, den: int) -> None:
        if not 0 < num <= den or num / den <= _GROWTH:
            raise ValueError(f"the least similarity must be in ({_GROWTH}, 1], got {num}/{den}")
        if words < 1:
            raise ValueError(f"words must be at least 1, got {words}")
        self.words, self.num, self.den = words, num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] / _GROWTH)))
        self.edges = np.array(edges, np.int64)

    def differences(self, band: np.ndarray) -> np.ndarray:
        """The most shingles by which linked sets can differ whose larger one lies in a band."""
        return 2 * (self.edges[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def dimensions(self, band: np.ndarray) -> np.ndarray:
        """The dimensions of count vectors for pairs whose larger set lies in a band: a power of two."""
        most = np.maximum((self.edges[band + 1] - 1) // PER_DIMENSION, 8)
        return 1 << np.ceil(np.log2(most)).astype(np.int64)

    def enough(self, overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether overlaps make links of pairs whose sizes add up to `sizes`."""
        return overlap * (self.num + self.den) >= self.num * sizes


def spare(differences: np.ndarray) -> np.ndarray:
    """Classes beyond differences + 1, and so the keys that a node may leave out: the more, the larger its set."""
    return np.where(differences > 0, 1 + differences // 4, 0)


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges and their distinct shingles."""
    for i, j, data, at in chunks(column):
        h, bounds, _, _ = word_hashes(data, at)
        s, bounds = shingle_hashes(h, bounds, words)
        yield i, j, *distinct(s, bounds)


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _names(u: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row's set."""
    return mix(_sum_by(mix(u, 31), bounds) ^ (np.diff(bounds).astype(U64) << U64(40)), 32).view(np.int64)


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key long, n_shingles long, node long, counts binary: hash of every text; size, name and count vector of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, u, bounds in _sets(batch.column(1), rule.words):
                doc_id, key = (batch.column(k).slice(i, j - i) for k in (0, 2))
                counts = count_vectors(u, bounds, rule)
                yield _batch(doc_id=doc_id, text_key=key, n_shingles=pa.array(np.diff(bounds)), node=pa.array(_names(u, bounds)), counts=pa.array(counts, pa.binary()))

    return _texts(docs).withColumn("text_key", text_key()).mapInArrow(run, "doc_id long, text_key long, n_shingles long, node long, counts binary")


def text_key() -> Column:
    """A hash of the column text, to tell rows apart that share a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def _keys_of(u: np.ndarray, bounds: np.ndarray, names: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their nodes, and how many more of its keys in the band a node may leave out.

    The last six bits of a key are its band. Empty classes are left out first, and come only where there are
    more of them than a node may leave out.
    """
    n = np.diff(bounds)
    own = np.searchsorted(rule.edges, n, "right") - 1
    keys, nodes, left = [], [], []
    for step in (0, 1):
        rows = np.flatnonzero((n > 0) & ((step == 0) | (n * rule.den >= rule.num * rule.edges[own + 1])))
        band = own[rows] + step
        most = rule.differences(band)
        rows, band, most = rows[most > 0], band[most > 0], most[most > 0]  # else linked sets are equal
        if not len(rows):
            continue
        free = spare(most)
        m = most + 1 + free
        first = np.concatenate([[0], np.cumsum(m)])
        of = np.repeat(np.arange(len(rows)), n[rows])
        take = np.zeros(len(n), bool)
        take[rows] = True
        x = u[np.repeat(take, n)]
        cell = first[of] + ((mix(x, 41) >> U64(32)) * m[of].astype(U64) >> U64(32)).astype(np.int64)
        total = np.zeros(first[-1], U64)
        np.add.at(total, cell, mix(x, 42))
        filled = np.zeros(first[-1], bool)
        filled[cell] = True
        row = np.repeat(np.arange(len(rows)), m)
        empty = np.add.reduceat((~filled).astype(np.int64), first[:-1])
        kept = filled
        if (empty > free).any():
            rank = np.cumsum(~filled) - np.concatenate([[0], np.cumsum(empty)])[row]  # of empty classes in a row, from 1
            kept = filled | (rank > free[row])
        number = np.arange(first[-1]) - first[row]
        key = mix(total ^ mix(number.astype(U64) + (band[row].astype(U64) << U64(40)), 43), 44)
        key = (key & ~U64(63)) | band[row].astype(U64)
        keys.append(key[kept])
        nodes.append(names[rows][row[kept]])
        left.append(np.maximum(free - empty, 0)[row[kept]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(left).astype(np.int32)


def _fresh(names: np.ndarray, seen: set, most: int = 200_000) -> np.ndarray:
    """Which names are new; `seen` is emptied beyond `most`, so a name may be new again."""
    new = np.zeros(len(names), bool)
    for i, x in enumerate(names.tolist()):
        if x not in seen:
            seen.add(x)
            new[i] = True
    if len(seen) > most:
        seen.clear()
    return new


def _keyed(docs: DataFrame, rule: Rule) -> DataFrame:
    """key long, node long, spare int; each task leaves copies of a node out that it has seen lately."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, u, bounds in _sets(batch.column(0), rule.words):
                names, n = _names(u, bounds), np.diff(bounds)
                new = _fresh(names, seen)
                key, node, left = _keys_of(u[np.repeat(new, n)], np.concatenate([[0], np.cumsum(n[new])]), names[new], rule)
                for a in range(0, len(key), 1 << 17):
                    b = a + (1 << 17)
                    yield _batch(key=pa.array(key[a:b]), node=pa.array(node[a:b]), spare=pa.array(left[a:b]))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "key long, node long, spare int")


def groups(docs: DataFrame, rule: Rule) -> DataFrame:
    """gid long, node long: nodes that share a key, once for each set of nodes.

    Keys are counted first, combined inside tasks. Only keys of two nodes or more are joined back, a join that
    adaptive execution splits where a key is hot.
    """
    keyed = _keyed(docs, rule)
    often = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("often"))
    shared = saved(often.where("low <> high").select("key", "often"), "shared")
    order = Window.partitionBy("node", F.col("key").bitwiseAND(63)).orderBy(F.desc("often"), "key")
    own = keyed.join(shared, "key").dropDuplicates(["key", "node"]).withColumn("place", F.row_number().over(order))
    own = saved(own.where("place > spare").select("key", "node"), "keys")
    named = own.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    chosen = named.groupBy(F.xxhash64("x", "n").alias("gid")).agg(F.min("key").alias("key"))
    return own.join(chosen, "key").select("gid", "node")


def count_vectors(u: np.ndarray, bounds: np.ndarray, rule: Rule) -> list[bytes]:
    """How many of each row's shingles hash to each dimension, as many as the next band has, in a byte.

    A shingle's dimension is the first bits of a hash, so vectors fold to fewer dimensions by adding neighbours.
    Should a count not fit a byte, all of that row are 255: the bound is then the other set's size, still a bound.
    """
    n = np.diff(bounds)
    d = rule.dimensions(np.searchsorted(rule.edges, np.maximum(n, 1), "right"))
    first = np.concatenate([[0], np.cumsum(d)])
    counts = np.bincount(_cells(u, np.repeat(np.arange(len(n)), n), d, first), minlength=first[-1])
    small = np.minimum(counts, 255).astype(np.uint8)
    for r in np.flatnonzero(np.maximum.reduceat(counts, first[:-1]) > 255) if len(n) else ():
        small[first[r] : first[r + 1]] = 255
    return [small[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]


def _cells(u: np.ndarray, of: np.ndarray, d: np.ndarray, first: np.ndarray) -> np.ndarray:
    return first[of] + ((mix(u, 61) >> U64(32)) * d[of].astype(U64) >> U64(32)).astype(np.int64)


def folded(vectors: list[bytes]) -> np.ndarray:
    """Count vectors in a matrix, all with as few dimensions as the shortest has."""
    d = min(map(len, vectors))
    if d == max(map(len, vectors)):
        return np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, d)
    return np.array([np.frombuffer(v, np.uint8).reshape(d, -1).sum(axis=1, dtype=np.int32) for v in vectors])


def _fine(sets: list[np.ndarray]) -> np.ndarray:
    """Count vectors of whole sets, with about as many dimensions as the middle one has shingles."""
    n = np.array([len(x) for x in sets])
    d = 1 << int(np.ceil(np.log2(max(8, np.median(n)))))
    of = np.repeat(np.arange(len(sets)), n)
    where = _cells(np.concatenate(sets) & ~U64(0xFFFF), of, np.full(len(sets), d), np.arange(len(sets)) * d)
    counts = np.bincount(where, minlength=len(sets) * d).reshape(-1, d)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32)


def near_pairs(counts: np.ndarray, sizes: np.ndarray, rule: Rule, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs that `wanted` lets through and whose count bound makes a link possible, a part at a time.

    An R-tree, packed in order of size: a box has its members' largest count in each dimension and their least
    and largest size. Pairs of boxes are followed down from the root. `wanted` is asked when a part's turn comes.
    """
    n = len(sizes)
    if n <= _FLAT:
        order = np.arange(n)
        stack = [(0, *np.triu_indices(n, 1))]
    else:
        order = np.lexsort((counts[:, : counts.shape[1] // 2].sum(axis=1), sizes))
        stack = []
    levels = [(counts[order], sizes[order], sizes[order])]
    while n > _FLAT and len(levels[-1][1]) > 1:
        high, low, top = levels[-1]
        cut = np.arange(0, len(low), FAN)
        levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)))
    stack = stack or [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = max(16, _AT_ONCE // (counts.shape[1] * counts.itemsize))
    child = np.arange(FAN)
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            stack.append((level, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        if level == 0:
            ask = (i != j) & wanted(order[i], order[j])
            i, j = i[ask], j[ask]
        high, low, top = levels[level]
        overlap = np.minimum(np.minimum(high[i], high[j]).sum(axis=1, dtype=np.int64), np.minimum(top[i], top[j]))
        good = rule.enough(overlap, low[i] + low[j])
        i, j = i[good], j[good]
        if not len(i):
            continue
        if level == 0:
            yield order[i], order[j]
            continue
        x = np.repeat(i[:, None] * FAN + child, FAN, axis=1).ravel()
        y = np.tile(j[:, None] * FAN + child, (1, FAN)).ravel()
        there = (y < len(levels[level - 1][1])) & (x <= y)  # i <= j, so x is there if y is
        stack.append((level - 1, x[there], y[there]))


def forest(counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, side: np.ndarray | None, rule: Rule, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect what all pairs would: those that the count bound leaves, or with sets those that link.

    labels are components known before; with side, only pairs across its two values come.
    """
    root = np.unique(labels, return_inverse=True)[1]
    out: list[tuple[int, int]] = []

    def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = root[i] != root[j]
        return apart if side is None else apart & (side[i] != side[j])

    for i, j in near_pairs(counts, sizes, rule, wanted):
        at = np.argsort(i, kind="stable")
        i, j = i[at], j[at]
        cut = [0, *(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)]
        for s, e in zip(cut[:-1], cut[1:]):
            a = int(i[s])
            others = j[s:e][root[j[s:e]] != root[a]]
            if sets is not None and len(others):
                others = others[_linked(sets[a], [sets[b] for b in others], rule)]
            if not len(others):
                continue
            gone, first = np.unique(root[others], return_index=True)
            out += [(a, int(b)) for b in others[first]]
            root[np.isin(root, gone) if len(gone) > 1 else root == gone[0]] = root[a]
        if root[0] == root[-1] and (root == root[0]).all():
            break
    return out


def _linked(one: np.ndarray, others: list[np.ndarray], rule: Rule) -> np.ndarray:
    n = np.array([len(x) for x in others])
    items = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, items), len(one) - 1)
    overlap = np.add.reduceat((one[at] == items).astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
    return rule.enough(overlap, n + len(one))


_ITEM = 6


def _packed(u: np.ndarray) -> bytes:
    """Ascending hashes, cut to their first 48 bits."""
    return np.ascontiguousarray(u.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_ITEM]).tobytes()


def _items(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _ITEM, 8), np.uint8)
    wide[:, :_ITEM] = np.frombuffer(data, np.uint8).reshape(-1, _ITEM)
    return wide.view(">u8").ravel().astype(U64)


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Columns (node, label, size, side, data) of one task after another; rows come sorted by task."""
    parts: list[tuple] = []
    current = None
    for batch in batches:
        task, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1])
        data = batch.columns[-1].to_pylist()
        cut = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)] if len(task) else [0]
        for s, e in zip(cut[:-1], cut[1:]):
            if parts and task[s] != current:
                yield _whole(parts)
                parts = []
            current = task[s]
            parts.append((*(c[s:e] for c in rest), data[s:e]))
    if parts:
        yield _whole(parts)


def _whole(parts: list[tuple]) -> tuple:
    if len(parts) == 1:
        return parts[0]
    *columns, data = zip(*parts)
    return (*(np.concatenate(c) for c in columns), list(itertools.chain.from_iterable(data)))


def _edges(rows: DataFrame, rule: Rule, exact: bool) -> DataFrame:
    """a, b: forests of tasks from rows (task, node, label, size, side, data); side is -1 where all pairs count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        a, b = [], []
        for node, label, size, side, data in _by_task(batches):
            if len(node) < 2 or (label == label[0]).all():
                continue
            sets = [_items(x) for x in data] if exact else None
            counts = _fine(sets) if exact else folded(data)
            for p, q in forest(counts, size, label, None if side[0] < 0 else side, rule, sets):
                pair = (min(node[p], node[q]).item(), max(node[p], node[q]).item())
                if pair not in seen:
                    seen.add(pair)
                    a.append(pair[0])
                    b.append(pair[1])
            if len(a) > 10_000:
                yield _batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))
                a, b = [], []
            if len(seen) > 200_000:
                seen.clear()
        yield _batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("task", "node", "label", "size", "side", "data").repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _connected(members: DataFrame, payload: DataFrame, rule: Rule, exact: bool, block: int) -> DataFrame:
    """node, label of the components that the pairs inside groups make, from members(gid, node, size) and payload(node, data)."""
    totals = members.groupBy("gid").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    large = saved(totals.select("gid", blocks.alias("blocks")).where("blocks > 1"), "large")
    some = not large.isEmpty()
    dealt = members.join(large, "gid", "left") if some else members.withColumn("blocks", F.lit(None).cast("int"))
    own = lambda salt: F.when(F.col("blocks").isNull(), F.col("gid")).otherwise(F.xxhash64("gid", F.pmod(F.xxhash64("node", F.lit(salt)), "blocks")))

    def found(rows: DataFrame) -> DataFrame:
        return saved(_edges(rows.join(payload, "node"), rule, exact), "edges")

    edges = found(_labelled(dealt, None).withColumn("task", own(0)).withColumn("side", F.lit(-1)))
    labels = components(edges)
    if not some:
        return labels
    dealt = saved(dealt.where("blocks is not null"), "large")
    edges = edges.union(found(_labelled(dealt, labels).withColumn("task", own(1)).withColumn("side", F.lit(-1))))
    labels = components(edges)
    rest = _block_pairs(_labelled(dealt, labels), block)
    if rest.isEmpty():
        return labels
    return components(edges.union(found(rest)))


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Rows of large groups with more than one label, for each pair of blocks that holds different ones.

    A label of many nodes has blocks of its own, which never meet each other; the others share blocks.
    """
    split = members.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gid")
    members = members.join(split, "gid", "left_semi")
    sizes = members.groupBy("gid", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    parts = F.ceil(F.greatest(2 * F.col("n") / block, 2 * F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.withColumn("parts", parts)
    pools = sizes.where("parts = 1").groupBy("gid").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).select("gid", parts.alias("pools"))
    sizes = sizes.select("gid", "label", "parts").join(pools, "gid", "left")
    own = F.xxhash64("label", F.pmod(F.xxhash64("node"), "parts"))
    pool = F.xxhash64(F.pmod(F.xxhash64("label"), "pools"))
    alone = F.col("parts") > 1
    placed = saved(members.join(sizes, ["gid", "label"]).select("gid", "node", "label", "size", F.when(alone, own).otherwise(pool).alias("block"), F.when(alone, F.col("label")).alias("owner")), "blocks")
    kinds = placed.select("gid", "block", "owner").distinct()
    left, right = (kinds.select("gid", F.col("block").alias(f"block_{x}"), F.col("owner").alias(f"owner_{x}")) for x in "lr")
    pairs = left.join(right, "gid").where("block_l <= block_r and (owner_l is null or owner_r is null or owner_l <> owner_r)")
    pairs = pairs.select("gid", "block_l", "block_r", F.xxhash64("gid", "block_l", "block_r").alias("task"))
    same = F.col("block_l") == F.col("block_r")
    one = pairs.select("gid", F.col("block_l").alias("block"), "task", F.when(same, -1).otherwise(0).alias("side"))
    two = pairs.where(~same).select("gid", F.col("block_r").alias("block"), "task", F.lit(1).alias("side"))
    return placed.join(one.union(two), ["gid", "block"]).select("task", "node", "label", "size", "side")


def whole_sets(docs: DataFrame, rule: Rule, wanted: DataFrame) -> DataFrame:
    """node long, data binary: the whole sets of wanted(node, doc_id), maybe twice where doc_ids repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_numpy()
            for i, j, u, bounds in _sets(batch.column(0), rule.words):
                node = _names(u, bounds)
                rows = np.flatnonzero(node == asked[i:j])
                yield _batch(node=pa.array(node[rows]), data=pa.array([_packed(u[bounds[r] : bounds[r + 1]]) for r in rows], pa.binary()))

    return _texts(docs).join(wanted.select("doc_id", "node"), "doc_id").select("text", "node").mapInArrow(run, "node long, data binary")


def links(docs: DataFrame, rule: Rule, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, label of the components of nodes that links connect, from nodes(node, doc_id, size, counts)."""
    with scratch() as kept:
        sizes = nodes.select("node", "size")
        members = saved(groups(docs, rule).join(sizes, "node"), "members")
        clusters = _connected(members, nodes.select("node", F.col("counts").alias("data")), rule, False, block)
        wanted = saved(clusters.join(nodes.select("node", "doc_id", "size"), "node"), "wanted")
        sets = saved(whole_sets(docs, rule, wanted), "sets")
        found = saved(_connected(wanted.select(F.col("label").alias("gid"), "node", "size"), sets, rule, True, block), "found")
        kept.append(found)
    return found


def labelled(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key long, n_shingles long, label long of every row: rows that links connect share a label; null without shingles.

    Rows with a null doc_id start no link, but share the label of rows with the same set where there are any.
    """
    rule = Rule(words, num, den)
    profile = saved(profiles(docs, rule), "profiles")
    some = profile.where("n_shingles > 0 and doc_id is not null")
    nodes = saved(some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("counts").alias("counts")), "nodes")
    found = links(docs.where("text is not null and doc_id is not null"), rule, nodes, block)
    full = _labelled(profile.where("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "node"), found).drop("node")
    return full.unionByName(profile.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("label")))


def _saved_labels(docs: DataFrame, words: int, num: int, den: int, block: int) -> DataFrame:
    with scratch() as kept:
        rows = saved(labelled(docs, words, num, den, block), "labelled")
        kept.append(rows)
    return rows


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles long, component_id long of every row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Words are lower-cased
    (A-Z) runs of bytes that are not white space. A text of fewer words than `words` is one shingle; null,
    empty and blank texts have no shingle and stand alone. A row with a null doc_id starts no link; it gets
    the component of rows with the same set, or null. Repeated rows come repeatedly.
    Columns other than doc_id and text are left out; no rows give no rows. `block` is the most nodes that
    one task compares with each other; the result does not depend on it.
    """
    rows = _saved_labels(docs, words, num, den, block)
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full = rows.where("label is not null").join(least, "label").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """The rows of docs without near-duplicates: one row of each component stays, and every row without shingles.

    It is the row with the smallest doc_id (nulls last), of those the one with the smallest text_key, of
    repeated rows the smallest by all columns, whose types must have an order. Decisions are by doc_id and text together, so rows of other texts
    that share a doc_id are safe. A null doc_id counts as in labelled(): such rows are copies of rows with the
    same set only. No rows give no rows.
    """
    rows = _saved_labels(docs, words, num, den, block)
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r"))
    alone = rows.where("label is null").select("doc_id", "text_key").distinct()
    stay = saved(first.select("r.doc_id", "r.text_key").withColumn("full", F.lit(True)).unionByName(alone.withColumn("full", F.lit(False))), "stay")
    counts = rows.where("label is not null").join(stay.where("full"), _same_row(rows, stay), "left_semi").groupBy("doc_id", "text_key").count()
    many = saved(counts.where("count > 1").drop("count"), "repeated")
    # the caller's columns travel as one, so none of their names meets one from here
    own = docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("own"), docs["doc_id"], docs["text"]).withColumn("row_key", text_key())
    kept = own.join(stay, own["doc_id"].cast("long").eqNullSafe(stay["doc_id"]) & (own["row_key"] == stay["text_key"]), "left_semi")
    if many.isEmpty():
        return kept.select("own.*")
    again = kept["doc_id"].cast("long").eqNullSafe(many["doc_id"]) & (kept["row_key"] == many["text_key"])
    once = kept.join(many, again, "left_semi").groupBy("row_key", "doc_id").agg(F.min("own").alias("own"))
    return kept.join(many, again, "left_anti").select("own.*").unionByName(once.select("own.*"))


def _same_row(one: DataFrame, two: DataFrame) -> Column:
    return one["doc_id"].eqNullSafe(two["doc_id"]) & (one["text_key"] == two["text_key"])
