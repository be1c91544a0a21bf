"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Words become
64-bit hashes without a Python object for each: a polynomial prefix sum over randomised byte values
gives every word's hash as a difference of two prefixes. All hashes are fixed functions of the text,
the same on every machine and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of a fresh copy of x."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random odd-free value for each byte; the multiplier is 5 modulo 8, so that its powers stay apart.
_BYTE = mix(np.arange(256, dtype=U64), 11)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept up to the usual size."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n, CHUNK_BYTES) + 1, base, U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 4 * CHUNK_BYTES:
            return out
        _powers[base] = have = out
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows data[at[i]:at[i+1]]: hashes of all words in order, the rows' bounds in them, and the words' byte ranges."""
    base = int(at[0])
    raw = data[base : int(at[-1])]
    rel = at - base
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(at), np.int64), none, none
    solid = ~SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = rel[(rel > 0) & (rel < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    values = _BYTE[LOWER[raw] if lower else raw]
    values *= _power(_BASE, n)[:n]
    total = np.zeros(n + 1, U64)
    np.cumsum(values, out=total[1:])
    h = total[ends]
    h -= total[starts]
    h *= _power(_INVERSE, n)[starts]
    h ^= (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h), np.searchsorted(starts, rel), starts + base, ends + base


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `size` bytes, one row at least: first, end, data, offsets of the range."""
    data, at = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data, at[i : j + 1]
        i = j


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, in order and with repeats, and the rows' bounds in them.

    A row of fewer words has one shingle, its whole sequence; a row without words has none.
    """
    weights = mix(np.arange(k, dtype=U64), 23) | U64(1)
    n = len(h)
    counts = np.diff(bounds)
    full = np.zeros(max(n - k + 1, 0), U64)
    for j in range(k):
        full += h[j : j + len(full)] * weights[j]
    valid = np.ones(n, bool)
    for j in range(1, k):
        ends = bounds[1:][counts >= j] - j
        valid[ends] = False
    short = np.flatnonzero((counts > 0) & (counts < k))
    out = np.zeros(n, U64)
    out[: len(full)] = full
    for r in short:
        a, b = bounds[r], bounds[r + 1]
        out[a] = int((h[a:b] * weights[: b - a]).sum(dtype=U64)) + int(b - a) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF
        valid[a] = True
        valid[a + 1 : b] = False
    kept = np.concatenate([[0], np.cumsum(valid)])
    return mix(out[valid], 1), kept[bounds]


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and the new bounds."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][bounds[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[bounds]
