"""Results as documents: a header, then a record a line, so that no task holds a whole document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.review import worded

#: Roots that a traversal's row lists.
ROOTS = 64


def records(name: str, version: int, **parts: DataFrame) -> DataFrame:
    """ord, line: a header with ``name`` and ``version``, then the rows of each part in the order given; write
    the lines in the order of ord and line."""
    spark = next(iter(parts.values())).sparkSession
    head = spark.createDataFrame([(0, f'{{"format":"{name}","record":"header","version":{version}}}')], "ord int, line string")
    rows = [df.select(F.lit(i).alias("ord"), F.to_json(F.struct(F.lit(k).alias("record"), *df.columns)).alias("line")) for i, (k, df) in enumerate(parts.items(), 1)]
    return reduce(DataFrame.unionByName, rows, head)


def traversal(rows: DataFrame, limitations: DataFrame) -> DataFrame:
    """Reached nodes with their first ``ROOTS`` roots, and how many more there are."""
    cut = rows.withColumn("roots_omitted", F.greatest(F.lit(0), F.size("roots") - ROOTS)).withColumn("roots", F.slice("roots", 1, ROOTS))
    return records("language-traversal", 1, limitation=worded(limitations), node=cut)


def impact(seeds: DataFrame, summary: DataFrame, items: DataFrame, limitations: DataFrame) -> DataFrame:
    return records("change-impact", 1, seed=seeds, summary=summary, candidate=items, limitation=worded(limitations))


def enum_impact(candidates: DataFrame, reasons: DataFrame) -> DataFrame:
    return records("enum-decision-impact", 1, reason=reasons, candidate=candidates)


def source_uses(page: DataFrame, counts: DataFrame) -> DataFrame:
    return records("source-uses", 1, counts=counts, use=page)


def bridges(facts: DataFrame) -> DataFrame:
    return records("bridge-facts", 1, fact=facts)


def changed_files(text: str) -> list[str]:
    """Paths of a list of changed files: a line each, or between NUL characters; renames give the new path."""
    parts = text.split("\0") if "\0" in text else text.splitlines()
    names = (p.split("\t")[-1].strip().replace("\\", "/") for p in parts)
    return list(dict.fromkeys(n.removeprefix("./") for n in names if n))


def advice(rows: DataFrame, kind: str) -> DataFrame:
    """coordinate, line: dependency advice (coordinate, scope, rule, suggested) in one of ``sinks.FORMATS``."""
    said = F.concat_ws(" ", F.col("rule"), F.col("coordinate"), F.when(F.col("suggested").isNotNull(), F.concat(F.lit("-> "), "suggested")))
    text = {
        "text": said,
        "gradle": F.concat(F.lit("w: "), said),
        "github-actions": F.concat(F.lit("::warning title="), F.col("rule"), F.lit("::"), said),
        "markdown": F.concat(F.lit("| `"), "coordinate", F.lit("` | "), "rule", F.lit(" | "), F.coalesce("suggested", F.lit("")), F.lit(" |")),
        "json": F.to_json(F.struct("coordinate", "scope", "rule", "suggested")),
        "sarif": F.to_json(F.struct(F.col("rule").alias("ruleId"), F.lit("warning").alias("level"), F.struct(said.alias("text")).alias("message"))),
    }
    return rows.select("coordinate", text[kind].alias("line"))
