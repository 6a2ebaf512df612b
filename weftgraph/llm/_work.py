"""What the operators share: keys of rows, joins of hot keys, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.shared import removed, written  # noqa: F401

#: Stands for a null document id where rows are matched by id.
NULL_ID = -(1 << 63)


def joined(rows: DataFrame, groups: DataFrame, on: list[str], size: str, spread: str, few: int = 1000, most: int = 10_000) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row a key and in ``size`` how many of ``rows`` have it.

    A key with more than ``few`` rows, and more than one in ``most`` of all, is dealt over tasks by the
    hash of ``spread``.  There are ``most`` such keys at most, so that they are broadcast.
    """
    groups = written(groups)
    limit = max(few, (groups.agg(F.sum(size)).first()[0] or 0) // most)
    parts = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    hot = groups.filter(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, on)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.join(F.broadcast(hot.select(*on, parts.alias("salts"))), on, "left")
    rows = rows.withColumn("salt", F.pmod(F.hash(spread), F.coalesce("salts", F.lit(1)))).drop("salts")
    return rows.join(salted, [*on, "salt"]).drop("salt")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes the number of key ranges."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def ranges(amount: float, each: float, least: int = 24) -> int:
    """Into how many ranges of keys ``amount`` postings go, at ``each`` a range."""
    return max(least, int(amount / each) + 1)


def key_columns() -> list:
    """dkey (id, never null), tkey (hash of the text) and text (never null)."""
    text = F.coalesce("text", F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("dkey"), F.xxhash64(text).alias("tkey"), text.alias("text")]


#: Rows and bytes of an Arrow batch: texts are long, and a task holds a few batches at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def keyed(docs: DataFrame) -> DataFrame:
    """``key_columns`` of each row, for Python tasks; lowers the session's batch size to ``BATCH``."""
    conf = docs.sparkSession.conf
    for k, most in BATCH.items():
        try:
            small = 0 < int(conf.get(k)) <= most
        except ValueError:  # a size with a unit
            small = False
        if not small:
            conf.set(k, str(most))
    return docs.select(*key_columns())


def real_id(col: str = "dkey"):
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias("doc_id")
