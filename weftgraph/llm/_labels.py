"""Labelled rows for classifiers, and models that one task fits and every task applies."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._work import keyed, real_id


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(modulus))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """text and y of at most ``max_rows`` labelled rows that are not held out.

    The rows are those whose ids have the least hashes, so they do not depend on how tables are split.
    An id with several labels has the greatest, one with several texts the first in order of the bytes'
    hash; null ids and labels are left out.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("dkey")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.filter(remainder(F.col("dkey"), modulus) != held_out).orderBy(F.xxhash64("dkey"), "dkey").limit(max_rows)
    rows = keyed(docs).join(F.broadcast(y), "dkey")
    return rows.groupBy("dkey").agg(F.min(F.struct("tkey", "text")).alias("t"), F.first("y").alias("y")).select("dkey", "t.text", "y")


def fitted(rows: DataFrame, features, schema: str, fit):
    """``fit(table of features)``, run as one task; its size is bounded by that of the sample.

    ``features`` turns batches of (dkey, text, y) into batches of ``schema`` in parallel.
    """

    def run(batches):
        if batches := list(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(batches)))], pa.binary())], names=["model"])

    made = rows.mapInArrow(features, schema).repartition(1).sortWithinPartitions("dkey")
    row = made.mapInArrow(run, "model binary").first()
    return pickle.loads(row.model) if row else fit(None)


def scored(docs: DataFrame, score, modulus: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; ``score`` maps the text column to an array."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("dkey"), pa.array(score(b.column("text")), pa.float64())], names=["dkey", "score"])

    df = keyed(docs).select("dkey", "text").mapInArrow(run, "dkey long, score double").select(real_id(), "score")
    return df.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
