"""Benchmark passages in documents, by a positional inverted index over the documents.

The index stores postings (term, position) of the terms of the test items, in shards of whole documents,
so each shard answers on its own.  Terms are ordered by how often the corpus has them.  A posting of the
rarest term of a window is what a match has to start from, so of the other terms only postings within
reach of such a posting are stored.  The index is built once for all items.  A search takes each window's
lists from the rarest term on: for an exact phrase it moves them by the terms' offsets and intersects
them, for a proximity match it asks of each list whether a posting is near.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import _text as T
from weftgraph.llm._work import key_columns, keyed, real_id, removed, written

#: Bytes of test text that one search of the index takes: its windows are what a task holds.
BLOCK = 2 << 20
#: Terms of the items of one index, which each task gets; items with more terms go to several indexes.
TERMS = 4_000_000


@dataclass
class Tests:
    """Windows of one length each, as indexes into the sorted hashes of all terms; and the items that have them."""

    groups: dict[int, np.ndarray]
    items: dict[int, list[tuple[str, ...]]]


def _hashes(text: str) -> np.ndarray:
    for _, _, data, off in T.texts(pa.array([text])):
        data = T.LOWER[data]
        s, e, _ = T.words(data, off, T.NON_WORD)
        return T.word_hashes(data, s, e)
    return np.empty(0, T.U)


def windows_of(items: list[tuple[str, str]], size: int, terms: np.ndarray) -> Tests:
    found: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        h = np.searchsorted(terms, _hashes(text or "")).tolist()
        for i in range(max(1, len(h) - size + 1) if h else 0):
            found[tuple(h[i : i + size])].add(item)
    groups, names = defaultdict(list), defaultdict(list)
    for w, who in found.items():
        groups[len(w)].append(w)
        names[len(w)].append(tuple(sorted(who)))
    return Tests({n: np.array(x) for n, x in groups.items()}, dict(names))


def _lookup(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in terms, or -1."""
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1)


def _words(batch: pa.RecordBatch):
    for lo, hi, data, off in T.texts(batch.column("text")):
        data = T.LOWER[data]
        s, e, w = T.words(data, off, T.NON_WORD)
        yield lo, hi, w, T.word_hashes(data, s, e)


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often the corpus has each of ``terms``: one sum a term from each task."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        n = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for _, _, _, h in _words(b):
                at = _lookup(shared.value, h)
                n += np.bincount(at[at >= 0], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in keyed(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def rarest(tests: Tests, counts: np.ndarray) -> np.ndarray:
    """Which terms are the rarest of a window."""
    out = np.zeros(len(counts), bool)
    for w in tests.groups.values():
        out[w[np.arange(len(w)), np.argmin(counts[w], axis=1)]] = True
    return out


def build_index(docs: DataFrame, terms: np.ndarray, pivot: np.ndarray, reach: int) -> DataFrame:
    """dkey, tkey, n_words, and the document's postings: terms and positions (int32 blocks, by position), of
    terms at most ``reach`` words from one of ``pivot``."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, pivot))

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"n_words": [], "terms": [], "positions": []}
            for lo, hi, w, h in _words(b):
                t = _lookup(shared.value[0], h)
                from_ = np.flatnonzero((t >= 0) & shared.value[1][t])
                near = T.covered(from_, reach, len(t)) | T.covered(len(t) - 1 - from_[::-1], reach, len(t))[::-1]
                at = np.flatnonzero(near & (t >= 0))
                cut = np.searchsorted(at, w)
                t, p = t[at].astype("<i4"), (at - w[T.row_of(w, at)]).astype("<i4")
                for a, z in zip(cut[:-1], cut[1:], strict=True):
                    out["terms"].append(t[a:z].tobytes())
                    out["positions"].append(p[a:z].tobytes())
                out["n_words"] += np.diff(w).tolist()
            yield pa.RecordBatch.from_arrays([b.column("dkey"), b.column("tkey"), pa.array(out["n_words"], pa.int64()), pa.array(out["terms"], pa.binary()), pa.array(out["positions"], pa.binary())], names=["dkey", "tkey", *out])

    return keyed(docs).mapInArrow(run, "dkey long, tkey long, n_words long, terms binary, positions binary")


def _starts(w: np.ndarray, counts: np.ndarray, key: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of every exact match of the windows ``w`` among postings:
    ``key`` is the place of a posting, ascending, over all documents of the part; ``term`` its term."""
    order = np.argsort(counts[w], axis=1, kind="stable")
    by_term = np.argsort(term, kind="stable")
    first = np.searchsorted(term[by_term], np.arange(len(counts) + 1))
    rarest = w[np.arange(len(w)), order[:, 0]]
    n = first[rarest + 1] - first[rarest]
    which = np.repeat(np.arange(len(w)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = key[by_term[first[rarest[which]] + place]] - order[which, 0]
    for k in range(1, w.shape[1]):
        if not len(which):
            break
        off = order[which, k]
        at = np.minimum(np.searchsorted(key, start + off), len(key) - 1)
        ok = (key[at] == start + off) & (term[at] == w[which, off])
        which, start = which[ok], start[ok]
    return which, start


def _near(w: np.ndarray, counts: np.ndarray, key: np.ndarray, term: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) where each of the window's terms has a posting within ``span`` of it,
    on either side; arguments as for ``_starts``."""
    order = np.argsort(counts[w], axis=1, kind="stable")
    by_term = np.argsort(term, kind="stable")
    far = int(key[-1]) + 2 * span if len(key) else 1
    cell = term[by_term].astype(np.int64) * far + key[by_term] + span
    pivot = w[np.arange(len(w)), order[:, 0]].astype(np.int64)
    first, last = np.searchsorted(cell, pivot * far), np.searchsorted(cell, (pivot + 1) * far)
    which = np.repeat(np.arange(len(w)), last - first)
    at = np.arange(len(which)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    place = key[by_term[first[which] + at]]
    for k in range(1, w.shape[1]):
        if not len(which):
            break
        low = w[which, order[which, k]].astype(np.int64) * far + place + 1
        i = np.searchsorted(cell, low)
        ok = (i < len(cell)) & (cell[np.minimum(i, len(cell) - 1)] < low + 2 * span - 1)
        which, place = which[ok], place[ok]
    return which, place


def _within(need: set[int], place: int, key: np.ndarray, term: np.ndarray, span: int) -> bool:
    """Whether some ``span`` words around ``place`` have all the terms."""
    a, z = np.searchsorted(key, [place - span + 1, place + span])
    near, what = key[a:z].tolist(), term[a:z].tolist()
    return any(need <= {t for x, t in zip(near, what, strict=True) if s <= x < s + span} for s in near if s <= place)


def search(index: DataFrame, tests: Tests, counts: np.ndarray, span: int) -> DataFrame:
    """dkey, tkey, n_words, hits (words inside a match: runs as start, end), items, near_items, of each indexed row."""
    shared = index.sparkSession.sparkContext.broadcast((tests, counts))

    def run(batches):
        tests, counts = shared.value
        for b in batches:
            n = b.column("n_words").to_numpy().astype(np.int64)
            base = np.r_[0, np.cumsum(n + span)]
            terms = [np.frombuffer(x, "<i4") for x in b.column("terms").to_pylist()]
            size = np.array([len(x) for x in terms], np.int64)
            term = np.concatenate([np.empty(0, np.int64), *terms])
            place = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, "<i4") for x in b.column("positions").to_pylist())])
            key = np.repeat(base[:-1], size) + place
            items: list[set[str]] = [set() for _ in range(len(n))]
            runs: list[list[tuple[int, int]]] = [[] for _ in range(len(n))]
            for length, w in tests.groups.items():
                which, start = _starts(w, counts, key, term)
                row = np.searchsorted(base, start, "right") - 1
                for x, s, r in zip(which.tolist(), (start - base[row]).tolist(), row.tolist(), strict=True):
                    items[r].update(tests.items[length][x])
                    runs[r].append((s, s + length))
            close = [set(x) for x in items]
            for length, w in tests.groups.items():
                which, at = _near(w, counts, key, term, span)
                for x, p, r in zip(which.tolist(), at.tolist(), (np.searchsorted(base, at, "right") - 1).tolist(), strict=True):
                    if not close[r].issuperset(who := tests.items[length][x]) and _within(set(w[x].tolist()), p, key, term, span):
                        close[r].update(who)
            hits = []
            for r in runs:
                merged: list[list[int]] = []
                for s, e in sorted(r):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                hits.append([{"start": s, "end": e} for s, e in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("dkey"), b.column("tkey"), b.column("n_words"), pa.array(hits, kind), *(pa.array([sorted(x) for x in y], pa.list_(pa.string())) for y in (items, close))], names=["dkey", "tkey", "n_words", "hits", "items", "near_items"])

    return index.mapInArrow(run, "dkey long, tkey long, n_words long, hits array<struct<start:bigint,end:bigint>>, items array<string>, near_items array<string>")


def _union(runs):
    """Runs (start, end), those that overlap or touch made one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(runs), none, add)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("text")).filter("i is not null")


def blocks_of(items: DataFrame, block: int):
    """Items (id, text) in lists of about ``block`` bytes: one list, and only it, is on the driver at a time."""
    have, size = [], 0
    for r in items.toLocalIterator():
        have.append((r.i, r.text))
        size += len(r.text.encode()) + 1
        if size >= block:
            yield have
            have, size = [], 0
    yield have


def parts_of(items: DataFrame, most: int, deep: int = 0):
    """(items, hashes of all their terms, sorted), in parts of at most ``most`` terms; one item has one part."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, T.U), *(h for _, _, _, h in _words(b))])).view(np.int64))], names=["h"])

    terms = written(items.select("text").mapInArrow(run, "h long").distinct())
    if terms.count() <= most or deep == 16:
        yield items, np.sort(terms.toArrow().column("h").to_numpy().view(T.U))
    else:
        for half in range(2):
            yield from parts_of(items.filter(F.pmod(F.xxhash64("i", F.lit(deep)), F.lit(2)) == half), most, deep + 1)
    removed(terms)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, span: int = 15, block: int = BLOCK, most_terms: int = TERMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_sha256, items, near_items, hits
    of each row of ``docs`` (doc_id, text), against the texts of ``benchmark`` (item_id, text).

    Words are runs of non-ASCII characters, digits and letters, A-Z lower-cased.  A window is ``size``
    consecutive words of an item, or all of them if it has fewer.  n_hit counts the document's words
    inside any occurrence of any window, n_items the items with such a window.  near_items are those with
    a window all of whose words, in any order, stand within some ``span`` consecutive words (``size`` at
    least), so items are among them; n_near counts them.  A null text has no words; an item without words,
    or without id, is never found; items that repeat count once.  Without items nothing is hit.  Rows that
    repeat get the same result each.
    """
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = _found(docs, benchmark, size, span, block, most_terms)
    joined = lambda c: F.sha2(F.array_join(c, ","), 256)
    return out.select(real_id(), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), joined("items").alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"), joined("near_items").alias("near_sha256"), "items", "near_items", "hits")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, word for word.

    Null and empty texts have no words and stay, null ids as well; rows that repeat stay or go together.  Items
    without words have no window, and an empty benchmark lets all rows stay.
    """
    bad = written(_found(docs, benchmark, size, size, BLOCK, TERMS).filter(F.size("hits") > 0).select("dkey", "tkey").distinct())
    d, t = key_columns()[:2]
    rows = docs.select(F.struct("*").alias("row"), d, t)
    return rows.join(bad, ["dkey", "tkey"], "left_anti").select("row.*")


def _found(docs: DataFrame, benchmark: DataFrame, size: int, span: int, block: int, most_terms: int) -> DataFrame:
    span, searches = max(size, span), []
    for items, terms in parts_of(_items(benchmark), most_terms):
        if not len(terms):
            terms = np.zeros(1, T.U)
        counts = term_counts(docs, terms)
        pivot = np.zeros(len(terms), bool)
        for b in blocks_of(items, block):
            pivot |= rarest(windows_of(b, size, terms), counts)
        index = written(build_index(docs, terms, pivot, span))
        searches += [search(index, windows_of(b, size, terms), counts, span) for b in blocks_of(items, block)]
    if len(searches) == 1:
        return searches[0]
    # a search at a time, of which what was found is kept
    some = (written(s.filter(F.size("near_items") > 0).withColumn("k", F.lit(k))) for k, s in enumerate(searches))
    found = reduce(DataFrame.unionByName, some).dropDuplicates(["dkey", "tkey", "k"])
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy("dkey", "tkey").agg(_union(F.flatten(F.collect_list("hits"))).alias("hits"), names("items"), names("near_items"))
    out = searches[0].select("dkey", "tkey", "n_words").join(found, ["dkey", "tkey"], "left")
    none = {"hits": "array<struct<start:bigint,end:bigint>>", "items": "array<string>", "near_items": "array<string>"}
    return out.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})
