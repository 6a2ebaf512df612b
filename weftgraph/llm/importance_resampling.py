"""Documents drawn so that their hashed n-grams are spread like those of a target table.

Arrow's kernels cut texts into terms and encode these as a dictionary; n-grams are pairs of an n-1-gram and
a term, made by shifting the indices, and each different pair is hashed once.  Two passes read the texts: one
counts buckets, one sums the gains of each document's features.  The draw adds Gumbel noise that depends on
the document's id alone and takes the greatest scores, ranked over the cluster in ranges of the score.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._work import NULL_ID, keyed, ranges, real_id, written

#: What lies between terms: the characters below 128 that are no letters or digits, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(texts: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket and row of each run of 1 to ``order`` terms, and the number of terms of each row."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    term, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(term), 0)  # separators at an end leave an empty string there
    term, row = term.filter(full).dictionary_encode(), row.filter(full).to_numpy()
    at, strings = term.indices.to_numpy().astype(np.int64), [x.encode() for x in term.dictionary.to_pylist()]
    n_terms = np.bincount(row, minlength=len(texts))
    crc = np.fromiter((zlib.crc32(s) for s in strings), np.int64, len(strings))
    gram, out_bucket, out_row = at, [crc[at] % buckets], [row]
    spaced = [b" " + s for s in strings] if order > 1 else []
    for k in range(1, order):
        whole = row[: len(row) - k] == row[k:]
        pair = gram[: len(row) - k] * len(strings) + at[k:] if len(row) > k else np.empty(0, np.int64)
        pairs, inverse = np.unique(pair, return_inverse=True)
        left, last = pairs // max(1, len(strings)), pairs % max(1, len(strings))
        crc = np.fromiter((zlib.crc32(spaced[b], a) for a, b in zip(crc[left].tolist(), last.tolist(), strict=True)), np.int64, len(pairs))
        gram = inverse
        out_bucket.append((crc[gram] % buckets)[whole])
        out_row.append(row[: len(row) - k][whole])
    return np.concatenate(out_bucket), np.concatenate(out_row), n_terms


def bucket_counts(table: DataFrame, order: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends a row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(features(b.column("text"), order, buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    sums = keyed(table.select(F.lit(None).cast("long").alias("doc_id"), "text")).select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the log of how much likelier the target has it, with one count added to each, in thousandths."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def ranked(rows: DataFrame, order: list, parts: int) -> DataFrame:
    """``rows`` with ``place``, 1 for the first in ``order``: sorted in ranges, which are then counted."""
    ordered = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, least = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a range
    before, at = [], 0
    for p, n in sizes:
        before.append((p, at))
        at += n
    starts = rows.sparkSession.createDataFrame(before or [(0, 0)], "part long, before long")
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + least + 1).drop("part", "before")


def importance_resampling(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10, keep: bool = False) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs`` (doc_id, text); with ``keep`` the text.

    Features are the runs of 1 to ``order`` terms, with repeats; ``weight`` sums the gains of a row's features
    (0 without any), ``score`` adds noise made of ``seed`` and the id.  Of the N rows with ``min_words`` terms
    or more the floor(``percent`` * N / 100) greatest scores are drawn and ranked from 1, ties by the smaller
    id; ``rank`` is null for all others.  A null text is empty.  A null id counts as an empty string in the
    noise and comes last among ties.  Rows that repeat count in N and in the counts each, and are drawn each;
    ties between rows of one id go by n_features and weight, then either way.  An empty target has no counts,
    so that common features weigh least; empty documents give no rows.
    """
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))

    def run(batches):
        for b in batches:
            bucket, row, n_words = features(b.column("text"), order, buckets)
            at = np.argsort(row, kind="stable") if order > 1 else slice(None)
            sums = np.r_[0, np.cumsum(gain[bucket[at]])]
            n = np.bincount(row, minlength=len(n_words))
            end = np.cumsum(n)
            out = [b.column("dkey"), pa.array(n), pa.array(n_words), pa.array(sums[end] - sums[end - n])]
            yield pa.RecordBatch.from_arrays([*out, *([b.column("text")] if keep else [])], names=["dkey", "n_features", "n_words", "weight", *(["text"] if keep else [])])

    texts = ["text"] if keep else []
    rows = keyed(docs).select("dkey", "text").mapInArrow(run, "dkey long, n_features long, n_words long, weight long" + ", text string" * keep)
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.when(F.col("dkey") != NULL_ID, F.col("dkey").cast("string")).otherwise("")), 256), 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / 4294967296.0))))
    rows = written(rows.withColumn("u", F.monotonically_increasing_id()))
    many = F.col("n_words") >= min_words
    n, every = rows.agg(F.coalesce(F.sum(many.cast("long")), F.lit(0)), F.count("*")).first()
    drawn = n * percent // 100
    by = [F.desc("score"), F.when(F.col("dkey") != NULL_ID, F.col("dkey")).asc_nulls_last(), F.asc("n_features"), F.asc("weight"), F.asc("u")]
    part = ranked(rows.filter(many), by, ranges(every, 500_000))
    columns = [real_id(), "n_features", "weight", "score", *texts]
    return part.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).union(rows.filter(~many).select(*columns, F.lit(None).cast("long").alias("rank")))
