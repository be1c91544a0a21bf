"""Repair of the structure of conversations at least cost, by layers of reachable grammar states.

The roles of a good conversation begin (s?(ua)+)?: nothing, or an optional system turn and pairs of user and
assistant. A turn is kept, given another role or deleted, and empty turns are inserted. For every cost from 0
on, a layer holds a bitset of grammar states for each turn: the states from which what follows can be repaired at
that cost. The first layer that has the start state gives the cost; a walk through the layers' bits gives the
edits, at each step the first by ASCII that stays within the cost.

A conversation is cut to segments of 64 turns, wherever its rows are. Of conversations with more than one, the
layers are computed for each end state at once: a segment is then a matrix of costs between states. Products of
matrices by levels of 64 tell each segment what lies behind it, and the segments' walks, as maps of states,
tell it in the same way where it begins. So no task ever holds a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.llm._shared import saved, scratch

#: Turns of a segment, and nodes under a node of the next level.
SEGMENT, FAN = 64, 64
#: Costs of edits: delete, insert, another role; what a truncated turn that stays adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
_SOLID = r"[^\x20\x09-\x0D]"
#: Bits of a turn's code above the role's initial (0 s, 1 u, 2 a, 3 another).
_CUT, _BLANK, _AGAIN = 4, 8, 16
#: States: 0 nothing yet, 1 system, 2 user, 3 assistant. Costs of ending in each: pairs are completed.
END = np.array([0, 6, 3, 0])
_NONE = 1 << 40
#: The state after keeping an initial, or -1; the state after a turn of the role that the grammar wants.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_WANTED = np.array([2, 2, 3, 2])
_OPS = np.frombuffer(b"DIKR", np.uint8)
#: The most bytes of layers that a task holds at a time.
_MOST = 32 << 20


class Repair(NamedTuple):
    """summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; turns: conv_id, pos, place, role, text, ordered by pos and place."""

    summary: DataFrame
    turns: DataFrame


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of turns after faults that crc32 of `conv_id:turn` chooses; nulls count as one space.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 removes [.!?] from it, 3 repeats the row, 4 makes it the user's.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    code = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", code.alias("code"), role.alias("role"), text.alias("text")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _pre(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The states from which a system, user or assistant turn leads into x; x has four bits for each of up to four end states."""
    return (x >> 1) & 0x1111, ((x >> 2) & 0x1111) * 0b1011, ((x >> 3) & 0x1111) << 2


def layers(codes: np.ndarray, n: np.ndarray, start: Callable[[int], np.ndarray], most: int, done: Callable[[np.ndarray], bool]) -> np.ndarray:
    """Bitsets by cost, turns from the end and segment: the states from which the turns can be repaired at that cost or less.

    codes[j] are the codes of the turns that have j behind them, n the numbers of turns; start(cost) gives the bitsets
    after the last turn. Layers are added until done(bitsets of whole segments) or `most`.
    """
    length, size = codes.shape
    role, cut, must = codes & 3, (codes & _CUT) > 0, (codes & (_BLANK | _AGAIN)) > 0
    wants = [np.where((role == r) & ~must, 0xFFFF, 0).astype(np.uint16) for r in range(3)]
    free = np.where(must, 0, 0xFFFF).astype(np.uint16)
    none = np.zeros((length + 1, size), np.uint16)
    out: list[np.ndarray] = []

    def at(cost: int) -> np.ndarray:
        return out[cost] if cost >= 0 else none

    for cost in range(most + 1):
        now = np.zeros((length + 1, size), np.uint16)
        out.append(now)
        now[0] = start(cost)
        # what does not depend on this layer, for all turns at once
        dear = np.where(cut, at(cost - REROLE - TRUNCATED)[:-1], at(cost - REROLE)[:-1])
        _, u, a = _pre(dear)
        now[1:] = at(cost - DELETE)[:-1] | ((u | a) & free)
        _, u, a = _pre(at(cost - INSERT)[1:])
        now[1:] |= u | a
        cheap = at(cost - TRUNCATED)
        for j in range(length):
            s, u, a = _pre(np.where(cut[j], cheap[j], now[j]))
            now[j + 1] |= (s & wants[0][j]) | (u & wants[1][j]) | (a & wants[2][j])
        if done(now[n, np.arange(size)]):
            break
    return np.stack(out)


def _groups(lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of the lists, their codes from the end, their lengths, in groups of like length whose layers fit."""
    sizes = np.array([len(x) for x in lists], np.int64)
    order = np.argsort(sizes, kind="stable")
    first = 0
    while first < len(order):
        most = max(2 * int(sizes[order[first]]), 8)
        room = max(1, _MOST // (2 * (most + 1) * (4 * most + 20)))
        last = first + int(np.searchsorted(sizes[order[first : first + room]], most, "right"))
        which = order[first:last]
        longest = int(sizes[which[-1]])
        codes = np.zeros((longest, len(which)), np.int64)
        for g, i in enumerate(which.tolist()):
            codes[: sizes[i], g] = lists[i][::-1]
        yield which, codes, sizes[which]
        first = last


def matrices(lists: list[np.ndarray]) -> np.ndarray:
    """For each list of codes the least costs from state to state (4 x 4), _NONE where there is no way."""
    out = np.full((len(lists), 4, 4), _NONE, np.int64)
    for which, codes, n in _groups(lists):
        whole = 4 * codes.shape[0] + 2 * INSERT
        bits = layers(codes, n, lambda cost: np.full(len(which), 0x8421, np.uint16), whole, lambda x: False)
        ends = bits[:, n, np.arange(len(which))]
        for p in range(4):
            for q in range(4):
                has = (ends >> (4 * q + p)) & 1
                out[which, p, q] = np.where(has.any(0), has.argmax(0), _NONE)
    return out


def walks(lists: list[np.ndarray], begin: np.ndarray, behind: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each list of codes, the state it begins in and the costs behind it by end state: the first of the cheapest edits.

    Of each: the edits as indices into DIKR, the turn that each consumes or comes before, the states before them, and the end state.
    """
    out: list = [None] * len(lists)
    for which, codes, n in _groups(lists):
        low = behind[which].min(1)
        rest = np.minimum(behind[which] - low[:, None], 1 << 20)
        g = np.arange(len(which))
        state = begin[which].copy()
        bit = state.copy()
        weights = 1 << np.arange(4)
        most = 4 * codes.shape[0] + 4 * INSERT + int(rest[rest < 1 << 20].max(initial=0))
        bits = layers(codes, n, lambda cost: ((rest <= cost) * weights).sum(1).astype(np.uint16), most, lambda x: bool(((x >> bit) & 1).all()))
        ends = (bits[:, n, g] >> bit) & 1
        left, j = ends.argmax(0), n.copy()
        steps: list[tuple[np.ndarray, ...]] = []
        while (some := np.flatnonzero(j > 0)).size:
            d, at, q = left[some], j[some], state[some]
            code = codes[at - 1, some]
            role, cut, must = code & 3, np.where(code & _CUT, TRUNCATED, 0), (code & (_BLANK | _AGAIN)) > 0

            def has(cost: np.ndarray, turn: np.ndarray, to: np.ndarray, some: np.ndarray = some, d: np.ndarray = d) -> np.ndarray:
                return (d >= cost) & (to >= 0) & ((bits[np.maximum(d - cost, 0), turn, some] >> np.maximum(to, 0)) & 1 > 0)

            moves = [(DELETE + 0 * d, at - 1, q), (INSERT + 0 * d, at, _WANTED[q]), (cut, at - 1, np.where(must, -1, _KEPT[q, role])), (REROLE + cut, at - 1, np.where(must, -1, _WANTED[q]))]
            op = np.argmax(np.stack([has(*m) for m in moves]), 0)
            costs, turns, states = (np.choose(op, [m[k] for m in moves]) for k in range(3))
            steps.append((some, op, n[some] - at, q))
            left[some], j[some], state[some] = d - costs, turns, states
        if steps:
            flat = [np.concatenate([s[k] for s in steps]) for k in range(4)]
            order = np.argsort(flat[0], kind="stable")
            flat = [x[order] for x in flat]
        else:
            flat = [np.zeros(0, np.int64)] * 4
        cuts = np.searchsorted(flat[0], np.arange(len(which) + 1))
        for k, i in enumerate(which.tolist()):
            own = slice(cuts[k], cuts[k + 1])
            out[i] = flat[1][own], flat[2][own], flat[3][own], int(state[k])
    return out


def price(ops: np.ndarray, turn: np.ndarray, codes: np.ndarray) -> int:
    """What edits cost."""
    stays = (ops == 2) | (ops == 3)
    cut = (codes[turn[stays]] & _CUT) > 0
    return int((ops == 0).sum() * DELETE + (ops == 1).sum() * INSERT + (ops == 3).sum() * REROLE + cut.sum() * TRUNCATED)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in column.to_pylist()]


def _mapped(df: DataFrame, columns: list[str], run: Callable[[dict[str, list]], dict[str, list]], result: str) -> DataFrame:
    """conv and result columns of df by run(), a function of lists, in Arrow batches; conv goes along as it is."""
    names = [x.split()[0] for x in result.split(", ")]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out = run({c: batch.column(i + 1) for i, c in enumerate(columns)})
            at = out.pop("at", None)
            conv = batch.column(0) if at is None else batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([conv, *(pa.array(out[c]) if not isinstance(out[c], pa.Array) else out[c] for c in names)], ["conv", *names])

    kind = df.schema["conv"].dataType.simpleString()
    return df.select("conv", *columns).mapInArrow(batches, f"conv {kind}, {result}")


def _scanned(nodes: DataFrame, levels: int, fan: int, first: list[int], fold: Callable[[np.ndarray, np.ndarray], np.ndarray], step: Callable[[np.ndarray, np.ndarray], np.ndarray], back: bool) -> DataFrame:
    """conv, node, c: what step() makes of `first` by way of all nodes(conv, node, x) before a node, or with `back` behind it.

    fold() makes one x of two neighbours. Both directions go by levels of `fan` nodes, so that a group has so many of them at most.
    """

    def families(table: DataFrame) -> DataFrame:
        return table.groupBy("conv", F.floor(F.col("node") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "x"))).alias("kin"))

    def folded(cols: dict[str, pa.Array]) -> dict[str, list]:
        out = []
        for kin in cols["kin"].to_pylist():
            x = np.array(kin[0]["x"], np.int64)
            for k in kin[1:]:
                x = fold(x, np.array(k["x"], np.int64))
            out.append(x.tolist())
        return {"node": cols["up"], "x": pa.array(out, pa.list_(pa.int64()))}

    def spread(cols: dict[str, pa.Array]) -> dict[str, list]:
        at, node, found = [], [], []
        for i, (kin, c) in enumerate(zip(cols["kin"].to_pylist(), cols["c"].to_pylist())):
            now = np.array(c, np.int64)
            for k in reversed(kin) if back else kin:
                at.append(i)
                node.append(k["node"])
                found.append(now.tolist())
                now = step(now, np.array(k["x"], np.int64))
        return {"at": at, "node": pa.array(node, pa.int64()), "c": pa.array(found, pa.list_(pa.int64()))}

    tables = [nodes]
    for _ in range(levels):
        tables.append(saved(_mapped(families(tables[-1]), ["up", "kin"], folded, "node bigint, x array<bigint>"), "nodes"))
    carried = tables[-1].select("conv", "node", F.lit(first).cast("array<bigint>").alias("c"))
    for table in reversed(tables[:-1]):
        kin = families(table).join(carried.withColumnRenamed("node", "up"), ["conv", "up"])
        carried = saved(_mapped(kin, ["kin", "c"], spread, "node bigint, c array<bigint>"), "carried")
    return carried


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs through two nodes."""
    return np.minimum((a.reshape(4, 4, 1) + b.reshape(1, 4, 4)).min(1), _NONE).reshape(16)


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with `at`, ascending in the order of their conversations, as a table: by turn (nulls first), then role, then md5 of the text."""
    rows = turns.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("h", F.md5("text")).withColumn("salt", F.monotonically_increasing_id())  # repeated rows are dealt to several tasks too
    keys = ["conv", "turn", "role", "h", "salt"]
    return saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id()), "turns")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(_SOLID)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return (role + F.when(blank, _BLANK).when(cut, _CUT).otherwise(0)).cast("int")


def repair(turns: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> Repair:
    """The faults, cheapest edits and repaired turns of conversations; turns has conv_id, turn, role and text.

    Turns go by `turn`, nulls first, ties by role and md5 of the text; repeated rows are duplicates, null roles and texts
    are one space, a null conv_id is a conversation of its own. Other columns are left out, whatever their
    names. Texts can have any length. No rows give no rows.
    """
    with scratch() as kept:
        rows = _numbered(turns)
        kept.append(rows)
        part = F.shiftright("at", 33)
        runs = rows.groupBy("conv", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
        # a conversation has a run for each partition that it reaches into
        runs = runs.select("conv", "part", (F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("conv")).alias("total"))
        again = rows.groupBy("conv", "role", "h").agg(F.min("at").alias("seen"), F.count("*").alias("times")).where("times > 1").drop("times")
        light = rows.select("conv", "role", "h", "at", part.alias("part"), _code().alias("code"))
        steps = light.join(runs, ["conv", "part"]).join(again, ["conv", "role", "h"], "left")
        repeated = (F.col("at") > F.col("seen")) & (F.col("code").bitwiseAND(F.lit(_BLANK)) == 0)
        code = F.when(repeated, F.col("code").bitwiseAND(F.lit(3)) + _AGAIN).otherwise(F.col("code"))
        steps = steps.select("conv", "total", (F.col("at") + F.col("shift")).alias("pos"), code.cast("int").alias("code"))
        segments = steps.groupBy("conv", "total", F.floor(F.col("pos") / segment).alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("own"))
        segments = saved(segments.select("conv", "total", "node", ((F.col("node") + 1) * segment >= F.col("total")).alias("last"), F.col("own.code").alias("codes")), "segments")
        traced = saved(_traced(segments, segment, fan), "traced")
        kept.append(traced)
        kept.append(segments)
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))

    def number(bits: int) -> Column:
        return F.size(F.filter("codes", lambda c: c.bitwiseAND(F.lit(bits)) > 0)).cast("long")

    before = segments.where(F.col("total") > segment).select("conv", (F.col("node") + 1).alias("node"), F.element_at("codes", -1).alias("before"))
    initials = F.when(F.col("before").isNull(), F.col("codes")).otherwise(F.concat(F.array("before"), "codes"))
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials)), lambda a, b: a.bitwiseAND(F.lit(3)) * 4 + b.bitwiseAND(F.lit(3)))
    faults = segments.join(before, ["conv", "node"], "left").select("conv", number(_BLANK).alias("blank"), number(_AGAIN).alias("duplicate"), number(_CUT).alias("truncated"), F.size(F.filter(pairs, lambda p: ~p.isin(1, 6, 9))).cast("long").alias("illegal"))
    faults = faults.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    summary = gaps.join(faults, "conv").join(_edits(traced), "conv").select("conv.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    places = traced.select("conv", F.posexplode("stays").alias("place", "stay"), "node").select("conv", (F.col("node") * segment + F.col("stay.turn")).alias("pos"), "place", F.col("stay.role").alias("role"), F.col("stay.own").alias("own"))
    texts = rows.withColumn("part", part).join(runs, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), F.col("role").alias("had"), "text")
    # an inserted turn has the position of the one that it comes before; behind the last there is none
    full = places.join(texts, ["conv", "pos"], "left")
    out = full.select("conv.conv_id", "pos", "place", F.coalesce("role", "had").alias("role"), F.when(F.col("own"), F.col("text")).otherwise("").alias("text"))
    return Repair(summary, out)


def _edits(traced: DataFrame) -> DataFrame:
    own = traced.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("node", "audit"))).alias("own"))
    return own.select("conv", "cost", F.array_join("own.audit", "").alias("audit"))


def _traced(segments: DataFrame, segment: int, fan: int) -> DataFrame:
    """conv, node, cost, audit, stays of every segment; stays are the turns that its repaired part has."""
    alone = segments.where(F.col("total") <= segment).select("conv", "node", "last", "codes", F.lit([0]).cast("array<bigint>").alias("begin"), F.lit(END.tolist()).cast("array<bigint>").alias("behind"))
    long = segments.where(F.col("total") > segment)
    most = long.agg(F.max("total")).first()[0]
    if most is None:
        return _mapped(alone, ["node", "last", "codes", "begin", "behind"], _walked, _RESULT)
    levels, n = 0, -(-most // segment)
    while n > 1:
        levels, n = levels + 1, -(-n // fan)

    def priced(cols: dict[str, pa.Array]) -> dict[str, list]:
        return {"node": cols["node"], "x": pa.array(matrices(_lists(cols["codes"])).reshape(-1, 16).tolist(), pa.list_(pa.int64()))}

    def mapped(cols: dict[str, pa.Array]) -> dict[str, list]:
        lists, behind = _lists(cols["codes"]), np.array(cols["behind"].to_pylist(), np.int64).reshape(-1, 4)
        ends = [[w[3] for w in walks(lists, np.full(len(lists), q), behind)] for q in range(4)]
        return {"node": cols["node"], "x": pa.array([list(x) for x in zip(*ends)], pa.list_(pa.int64()))}

    costs = saved(_mapped(long, ["node", "codes"], priced, "node bigint, x array<bigint>"), "nodes")
    behind = _scanned(costs, levels, fan, END.tolist(), _product, lambda v, m: np.minimum((m.reshape(4, 4) + v[None, :]).min(1), _NONE), back=True)
    known = saved(long.join(behind.withColumnRenamed("c", "behind"), ["conv", "node"]), "known")
    ways = saved(_mapped(known, ["node", "codes", "behind"], mapped, "node bigint, x array<bigint>"), "nodes")
    begin = _scanned(ways, levels, fan, [0], lambda f, g: g[f], lambda q, f: f[q], back=False)
    cut = known.join(begin.withColumnRenamed("c", "begin"), ["conv", "node"]).select(*alone.columns)
    return _mapped(alone.unionByName(cut), ["node", "last", "codes", "begin", "behind"], _walked, _RESULT)


_RESULT = "node bigint, cost bigint, audit string, stays array<struct<turn:bigint,role:string,own:boolean>>"


def _walked(cols: dict[str, pa.Array]) -> dict[str, list]:
    lists = _lists(cols["codes"])
    begin = np.array([x[0] for x in cols["begin"].to_pylist()], np.int64)
    behind = np.array(cols["behind"].to_pylist(), np.int64).reshape(-1, 4)
    costs, audits, stays = [], [], []
    for codes, last, (ops, turn, state, end) in zip(lists, cols["last"].to_pylist(), walks(lists, begin, behind)):
        cost = price(ops, turn, codes)
        audit = _OPS[ops].tobytes().decode()
        own = [{"turn": t, "role": None if o == 2 else "assistant" if q == 2 else "user", "own": o != 1} for o, t, q in zip(ops.tolist(), turn.tolist(), state.tolist()) if o]
        if last and END[end]:  # the last pair is completed
            for q in (1, 2) if end == 1 else (2,):
                own.append({"turn": len(codes), "role": "assistant" if q == 2 else "user", "own": False})
                audit += "I"
            cost += int(END[end])
        costs.append(cost)
        audits.append(audit)
        stays.append(own)
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("own", pa.bool_())]))
    return {"node": cols["node"], "cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string()), "stays": pa.array(stays, kind)}


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the `role:text` of repaired turns, joined by newlines.

    A digest is one pass over a conversation: its turns are sorted in one task, which may spill, and read one
    batch after the other, so no conversation is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None
        for batch in batches:
            kind = batch.column(0).type
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or conv != now:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv", "sha"])
                    now, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv", "sha"])

    rows = turns.select(F.struct("conv_id").alias("conv"), "pos", "place", F.concat_ws(":", "role", "text").alias("line"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "pos", "place").select("conv", "line")
    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, sha string").select("conv.conv_id", F.col("sha").alias("repaired_sha256"))


def report(turns: DataFrame, ids: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Of every conv_id of ids (each once): repair()'s summary of turns, and repaired_sha256. Without turns: zeros, no edits, the digest of nothing."""
    done = repair(turns, segment, fan)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    key = F.struct("conv_id").alias("conv")
    every = ids.select(key).distinct()
    found = every.join(done.summary.select(key, *numbers, "audit"), "conv", "left").join(digests(done.turns).select(key, "repaired_sha256"), "conv", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv.conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
