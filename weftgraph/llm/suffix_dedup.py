"""Removal of long byte strings that occur more than once, by distributed prefix doubling.

Positions are ranked by the strings that start there, at growing lengths: the rank of a string of 2n
bytes is made from the pair of the ranks at i and i + n.  Each round sorts (rank, position) in ranges
over the cluster; positions whose rank is unique leave; and the offset doubles, until the strings are as
long as the threshold.  A rank is a 64-bit name instead of a dense number, so a map task that holds
a string a million times can tell that itself, and no task has to hand a number back to all of them.

A round need not rank every position that is left.  While strings are shorter than the threshold, it
takes those whose name is the least of a window of them: that depends on nothing but the bytes around,
so a repeated string of the threshold's length has them at the same places, wherever it stands, and it
goes on if those at its start and its end do.  The last round ranks every position left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import _packed as K
from weftgraph.llm import _text as T
from weftgraph.llm._work import keyed, ranges, real_id, removed, text_bytes, written

_NAMES = T.mix(np.arange(1, 257, dtype=T.U))


def rounds(length: int) -> list[tuple[int, int]]:
    """Bytes of the strings and positions of a window of each round, such that both fit into ``length``."""
    longest = length - 15
    sizes = [-(-longest // 4), -(-longest // 2), longest]
    return [(k, 1 << ((length - k + 1).bit_length() - 1)) for k in sizes] + [(length, 1)]


def _ranks(data: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Of each size, the ranks of all positions, from pairs of those of the size before."""
    out = [T.run_hashes(_NAMES[data], sizes[0])]
    for k, longer in zip(sizes[:-1], sizes[1:], strict=True):
        n = max(0, len(out[-1]) - (longer - k))
        out.append(T.mix(out[-1][:n] * T.P + out[-1][longer - k : longer - k + n]))
    return out


def _ends(h: np.ndarray, at: np.ndarray, k: int, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions stand for the start and the end of the strings of ``length`` bytes at ``at``."""
    least = T.least(h, window)
    return least[at], least[at + length - k - window + 1]


def _round(steps: list[tuple[int, int]], length: int):
    """Postings of the last of ``steps``; rows have the positions that the one before left."""

    def of(batch):
        for lo, hi, data, off in T.texts(batch.column("text"), 1 << 20):
            at = T.full(off, length)
            if not len(at):
                continue
            ranks = _ranks(data, [k for k, _ in steps])
            if len(steps) > 1:
                left = T.flags(batch.column("positions"), lo, hi, off)
                a, b = _ends(ranks[-2], at, *steps[-2], length)
                at = at[left[a] & left[b]]
            if (k := steps[-1][0]) < length:
                take = np.zeros(len(ranks[-1]), bool)
                for x in _ends(ranks[-1], at, *steps[-1], length):
                    take[x] = True
                at = np.flatnonzero(take)
                yield K.postings(batch, lo, hi, off, ranks[-1][at], at)
            else:
                yield *K.postings(batch, lo, hi, off, ranks[-1][at], at), T.run_checks(_NAMES[data], at, k)

    return of


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of each row of ``docs`` (doc_id, text).

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it starts at another
    place, too, of any row; strings stay within a row and are judged on the input.  n_spans counts the
    maximal runs of removed bytes; kept holds the others, which need not be whole characters.  A null
    text has no bytes; rows that repeat are copies of each other, so lose all bytes if they have
    ``length`` at least.  A null doc_id stays null.  Shorter texts, and an empty table, lose nothing.
    """
    if length < 64:
        raise ValueError("length is 64 at least")
    rows, amount = keyed(docs), text_bytes(docs)
    steps, every, left = rounds(length), None, rows
    for i, (k, window) in enumerate(steps):
        # postings to expect: all positions only of the quarter of the text that is left, or so
        n, width = (ranges(amount * 2 / (window + 1), 1e6), 6) if k < length else (ranges(amount / 8, 1.5e6), 8)
        found = K.found_twice(K.sent(left, _round(steps[: i + 1], length), n, width), n, width)
        if every is None:
            every = written(K.with_found(rows, found))
            left = every.filter("open").select("dkey", "tkey", "text", "positions")
        elif k < length:
            before, left = left, written(left.drop("positions").join(found.hint("shuffle_hash"), ["dkey", "tkey"]))
            if i > 1:
                removed(before)
    found = written(found)
    removed(left)
    some = every.filter("open").drop("positions").join(found.hint("shuffle_hash"), ["dkey", "tkey"], "left").select("dkey", "text", "positions", "copied")
    rest = every.filter("not open").select("dkey", "text", F.lit(None).cast("binary").alias("positions"), "copied")
    return some.unionByName(rest).mapInArrow(lambda b: _results(b, length), "dkey long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").select(real_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _results(batches, length: int):
    for batch in batches:
        out: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        copied = batch.column("copied").to_numpy(zero_copy_only=False)
        for lo, hi, data, off in T.texts(batch.column("text")):
            size = np.diff(off)
            gone = T.covered(np.flatnonzero(T.flags(batch.column("positions"), lo, hi, off)), length, len(data))
            gone |= np.repeat(copied[lo:hi] & (size >= length), size)
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            begin[off[:-1][size > 0]] |= gone[off[:-1][size > 0]]
            kept, ends = data[~gone].tobytes(), np.r_[0, np.cumsum(~gone)][off]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                out["kept"].append(kept[a:b])
                out["kept_sha256"].append(hashlib.sha256(kept[a:b]).hexdigest())
            out["n_bytes"] += size.tolist()
            out["n_removed"] += (size - np.diff(ends)).tolist()
            out["n_spans"] += np.diff(np.r_[0, np.cumsum(begin)][off]).tolist()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("dkey"), *(pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True))], names=["dkey", *out])
