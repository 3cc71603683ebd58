"""Whole columns of text as NumPy arrays: words, their hashes, runs of words.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Null texts count
as empty. All functions work on a batch at once; none loops over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
with contextlib.suppress(OSError, AttributeError):  # glibc: large arrays go back to the system when they are freed, as workers live on
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict = {}


def _powers(n: int):
    """P**i and P**-i modulo 2**64, for i up to n."""
    if len(_POWERS.get("p", ())) <= n:
        for k, b in (("p", _P), ("i", _PINV)):
            x = np.full(n + 1, b, U)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["i"]


def give_back() -> None:
    """What was freed goes back to the system: a worker lives on when its task has ended."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (a bijection: the finaliser of the public MurmurHash3)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and n + 1 offsets that begin at 0."""
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of some MB of text; a longer row stands alone, whole."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = utf8(b.column(column))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
    give_back()


def spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes not in ``space``), and the n + 1 offsets of texts in these."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    gap = space[data]
    word = ~gap
    first, last = word.copy(), word.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    full = off[1:] > off[:-1]
    a, z = off[:-1][full], off[1:][full] - 1
    first[a], last[z] = word[a], word[z]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever it stands: eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = ends - starts
    h = (size.astype(U) + U(seed)) * U(_P)
    h = mix(h ^ eight[starts] & _MASK[np.minimum(size, 8)])
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        left = size[more] - k
        h[more] = mix(h[more] * U(_P) ^ eight[starts[more] + k] & _MASK[np.minimum(left, 8)])
        more, k = more[left > 8], k + 8
    return h


def words(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of texts in these."""
    data, off = utf8(col)
    if lower:
        data = LOWER[data]
    starts, ends, at = spans(data, off)
    return span_hashes(data, starts, ends), at


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run values[at[i]:at[i + 1]]; 0 for an empty run."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def inside(at: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of n words begins that stays in its text."""
    size = np.maximum(np.diff(at) - n + 1, 0)
    first = np.cumsum(size) - size
    return np.repeat(at[:-1] - first, size) + np.arange(size.sum())


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: np.unique hashes, which takes several times as long here)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of one row of each distinct (a, b), in that order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order


def run_hashes(w: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place i on."""
    p, _ = _powers(len(w) + 1)
    inv = np.full(len(w) + 1, _PINV, U)
    inv[0] = 1
    inv = np.multiply.accumulate(inv)
    total = np.zeros(len(w) + 1, U)
    np.cumsum(w * p[: len(w)], out=total[1:])
    return mix((total[i + n] - total[i]) * inv[i])


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: All but ASCII letters, digits and the bytes of other characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like words(), but marks and signs part words as spaces do: ``Erth,`` and ``erth***`` are one word."""
    data, off = utf8(col)
    data = LOWER[data]
    starts, ends, at = spans(data, off, NO_LETTER)
    return span_hashes(data, starts, ends), at
