"""Removal of long word passages that occur more than once, found from difference-cover anchors.

A cover D modulo v holds two members at every difference.  So for any two starts i and j of one
35-word passage there is an offset below v at which both i and j land on members of D: hashing only
the windows at those positions (5 of 21) still gives every repeated passage an anchor that is shared
and aligned.  Passages are then extended from shared anchors: all 35-word windows around them, and no
others, are hashed whole (to 96 bits), and a window is removed if its hash is found at another place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import _packed as K
from weftgraph.llm import _text as T
from weftgraph.llm._work import keyed, ranges, real_id, text_bytes, written

#: A perfect difference cover: its differences are all residues modulo the period.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _cells(batch: pa.RecordBatch):
    """(row range, bytes, offsets, starts, ends, word offsets, word hashes) of runs of rows."""
    for lo, hi, data, off in T.texts(batch.column("text")):
        s, e, w = T.words(data, off, T.WHITE)
        yield lo, hi, data, s, e, w, T.word_hashes(data, s, e)


def _anchors(window: int):
    size = window - PERIOD + 1

    def of(batch):
        for lo, hi, _, _, _, w, h in _cells(batch):
            at = T.full(w, size)
            at = at[_IN_COVER[(at - w[T.row_of(w, at)]) % PERIOD]]
            yield K.postings(batch, lo, hi, w, T.run_hashes(h, size)[at], at)

    return of


def _windows(window: int):
    """Whole windows that hold a shared anchor."""
    size = window - PERIOD + 1

    def of(batch):
        for lo, hi, _, _, _, w, h in _cells(batch):
            shared = np.r_[0, np.cumsum(T.flags(batch.column("positions"), lo, hi, w))]
            at = T.full(w, window)
            at = at[shared[at + window - size + 1] > shared[at]]
            yield *K.postings(batch, lo, hi, w, T.run_hashes(h, window)[at], at), T.run_checks(h, at, window)

    return of


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row of ``docs`` (doc_id, text).

    Words are what stands between ASCII white space.  A word goes if a window of ``window`` words that
    covers it starts at another place, too, of any row; windows are judged on the input.  A null text
    has no words; rows that repeat are copies of each other, so lose every word that a window covers.
    A null doc_id stays null.  Texts of fewer words than a window, and an empty table, lose nothing.
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window has {PERIOD + 4} words at least")
    rows = keyed(docs)
    amount = text_bytes(docs)
    n = ranges(amount * len(COVER) / PERIOD / 6, 1e6)
    shared = K.found_twice(K.sent(rows, _anchors(window), n, 6), n, 6)
    every = written(K.with_found(rows, shared))
    some = every.filter("open")
    m = ranges(amount / 6 / 4, 1e6)
    starts = K.found_twice(K.sent(some, _windows(window), m, 8), m, 8)
    some = some.drop("positions").join(starts, ["dkey", "tkey"], "left")
    rest = every.filter("not open").withColumn("positions", F.lit(None).cast("binary")).select(*some.columns)
    return some.unionByName(rest).mapInArrow(lambda b: _results(b, window), "dkey long, n_words long, n_removed long, kept_sha256 string, kept_text string").select(real_id(), "n_words", "n_removed", "kept_sha256", "kept_text")


def _results(batches, window: int):
    for batch in batches:
        out: dict[str, list] = {x: [] for x in ("n_words", "n_removed", "kept_sha256", "kept_text")}
        copied = batch.column("copied").to_numpy(zero_copy_only=False)
        for lo, hi, data, s, e, w, _ in _cells_plain(batch):
            gone = T.covered(np.flatnonzero(T.flags(batch.column("positions"), lo, hi, w)), window, int(w[-1]))
            n = np.diff(w)
            gone |= np.repeat(copied[lo:hi] & (n >= window), n)
            keep = np.zeros(len(data) + 1, np.int8)
            np.add.at(keep, s[~gone], 1)
            np.add.at(keep, e[~gone], -1)
            inside = np.cumsum(keep[:-1], dtype=np.int8) > 0
            # one space before each kept word but the first of a row
            kept = np.flatnonzero(~gone)
            row = T.row_of(w, kept)
            sizes = (e - s)[kept] + np.r_[False, row[1:] == row[:-1]][: len(kept)]
            text = np.full(int(sizes.sum()), 32, np.uint8)
            at = np.cumsum(sizes) - (e - s)[kept]
            word = np.ones(len(text), bool)
            word[(at - 1)[sizes > (e - s)[kept]]] = False
            text[word] = data[inside]
            ends = np.r_[0, np.cumsum(sizes)][np.searchsorted(row, np.arange(hi - lo + 1))]
            raw = text.tobytes()
            for i in range(hi - lo):
                x = raw[ends[i] : ends[i + 1]]
                out["kept_sha256"].append(hashlib.sha256(x).hexdigest())
                out["kept_text"].append(x.decode("utf-8"))
            out["n_words"] += n.tolist()
            out["n_removed"] += np.diff(np.r_[0, np.cumsum(gone)][w]).tolist()
        yield pa.RecordBatch.from_arrays([batch.column("dkey"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept_text"], pa.string())], names=["dkey", *out])


def _cells_plain(batch):
    for lo, hi, data, off in T.texts(batch.column("text")):
        s, e, w = T.words(data, off, T.WHITE)
        yield lo, hi, data, s, e, w, None
