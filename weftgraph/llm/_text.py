"""Text of Arrow batches as numpy arrays: words, their hashes, and hashes of runs of units.

All functions take one byte array that holds the texts of several rows back to back, and the
offsets of the rows in it.  Nothing here loops over rows or characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multiplier of the run hashes; and of the final mix.
P, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def table(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


#: Bytes between words: white space; or all ASCII but digits and a-z (after lower-casing).
WHITE = table(b" \t\n\x0b\x0c\r")
NON_WORD = table(bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values under which all bits depend on all."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def texts(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n), raw[off[lo] : off[min(hi, n)]], off[lo : min(hi, n) + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of the rows in them) of the words."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start, end = inside.copy(), np.zeros(len(data) + 1, bool)
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[1:] = inside
    end[1:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end), np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight of them at a time."""
    if not len(s):
        return np.empty(0, U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    n = e - s
    h = n.astype(U) * P
    at, j = np.arange(len(s)), 0
    while len(at):
        left = np.minimum(n[at] - j, 8).astype(U)
        x = lanes[s[at] + j] & (~U(0) >> (U(64) - left * U(8)))
        h[at] = mix(h[at] ^ x) + P
        j += 8
        at = at[n[at] > j]
    return h


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """For each i, a hash of h[i : i + k]; by doubling, so in about 2 log2(k) steps."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, done, power, size, scale = None, 0, h, 1, P
    while True:
        if k & size:
            if out is None:
                out, done = power, size
            else:
                m = len(power) - done
                out = out[:m] * scale + power[done : done + m]
                done += size
        if 2 * size > k:
            return mix(out[:n])
        m = len(power) - size
        power = power[:m] * scale + power[size : size + m]
        size, scale = 2 * size, U(int(scale) ** 2 % (1 << 64))


def run_checks(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """32 bits of what h[i : i + k] sums up to, for each i of ``at``: told apart otherwise than by run_hashes."""
    total = np.r_[U(0), np.cumsum(mix(h ^ M2))]
    return mix(total[at + k] - total[at]) >> U(32)


def full(off: np.ndarray, k: int) -> np.ndarray:
    """Positions at which a run of k units starts and ends in one row, for rows with offsets ``off``."""
    return np.flatnonzero(np.arange(int(off[-1])) + k <= np.repeat(off[1:], np.diff(off)))


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n units are inside a run of k units from one of ``starts``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:-1]) > 0


def least(h: np.ndarray, w: int) -> np.ndarray:
    """For each i, the place of the first least of h[i : i + w], w a power of two."""
    best, size = np.arange(len(h), dtype=np.int64), 1
    value = h
    while size < w:
        later = value[size:] < value[:-size]
        best = np.where(later, best[size:], best[:-size])
        value = np.where(later, value[size:], value[:-size])
        size *= 2
    return best


def flags(column: pa.Array, lo: int, hi: int, off: np.ndarray) -> np.ndarray:
    """Which units of rows lo..hi have their place in the row listed in the row's int64 block."""
    out = np.zeros(int(off[-1]) + 1, bool)
    for i, x in enumerate(column.slice(lo, hi - lo).to_pylist()):
        if x:
            out[off[i] + np.frombuffer(x, "<i8")] = True
    return out[:-1]


def row_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, at, "right") - 1
