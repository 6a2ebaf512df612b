"""Removal of lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._work import joined, removed, written

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_columns: bool = False) -> DataFrame:
    """Drops lines whose key is found in at least ``min_docs`` documents and has at least ``min_chars`` code points.

    Returns doc_id, n_lines (before), n_dropped, kept_sha256 and kept_text of each row of ``docs``
    (doc_id, text); with ``keep_columns`` the columns of ``docs`` instead, text being what is kept.
    Every line with such a key goes, in every row; the others stay in order, joined by a line feed.
    A document is a doc_id, or the text of a row that has none; rows of one doc_id count once.  A null or
    empty text has one empty line (keep_columns: null stays null).

    Keys are told apart by 96 bits of hash.  Each row sends each of its keys once, summed on the map
    side; what comes back to a document are its frequent keys.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))
    keys = docs.select(id_.alias("dkey"), F.explode(F.array_distinct(F.transform(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars), _hash))).alias("h"))
    keys = written(keys.select("dkey", "h.a", "h.b"))
    often = keys.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    hit = written(joined(keys, often, ["a", "b"], "n", "dkey").select("dkey", "a", "b").distinct())
    removed(keys)
    # so far rows were counted; where ids repeat, fewer documents may have a key
    few = hit.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") < min_docs)
    if not few.isEmpty():
        hit = hit.join(few, ["a", "b"], "left_anti")
    per_doc = hit.groupBy("dkey").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    rows = docs.select(id_.alias("dkey"), F.struct(*(docs.columns if keep_columns else ["doc_id", "text"])).alias("row")).join(per_doc.hint("shuffle_hash"), "dkey", "left")
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    stays = lambda line: (F.length(line_key(line)) < min_chars) | ~F.array_contains(F.col("gone"), _hash(line_key(line)))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, stays))
    kept_text = F.array_join(kept, "\n")
    if keep_columns:
        return rows.select(*(F.when(F.col("row.text").isNotNull(), kept_text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    out = rows.select(F.col("row.doc_id").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"), F.array_join("kept", "\n").alias("kept_text"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
