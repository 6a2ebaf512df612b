"""Secrets in texts, and who owns them, with DataFrame functions only.

Every candidate value is hashed and counted over the corpus by distinct rows (repositories) and
distinct sources (owners).  One that many owners or many rows have is a copied example; one that few of
both have, and whose characters look random, looks live.  Values of the known kinds are always reported; strings of no known
kind are reported as ``live`` when that count says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._work import NULL_ID, joined, key_columns, real_id, written

# Fixed patterns.  The letters of assign's key words match in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")
ASSIGN_MIN = 8


def _let(value: Column, body) -> Column:
    """``body(value)``, with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """struct(start, end, value) of the leftmost non-overlapping matches: what stands between the
    matches, and the matches, give all places by their lengths."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def places(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        rows = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))
        start = F.struct(F.lit(0).alias("at"), empty.alias("done"))

        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["match"])
            one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["done"], F.array(one)).alias("done"))

        return F.aggregate(rows, start, add)["done"]

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)).otherwise(empty)


def _spans(parts: list[tuple[int, Column]]) -> Column:
    """kind:start:end by start, then kind in the order of KINDS, comma-joined."""
    def marked(kind: int, x: Column) -> Column:
        return F.transform(x, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    both = F.concat(*(marked(k, x) for k, x in parts))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(both), lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, max_owners: int = 2, max_repositories: int = 4, min_distinct: int = 12) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of each row of ``docs``
    (doc_id, text, source).

    Places are code points, ends exclusive.  n_live counts the values, of any kind, that at most
    ``max_owners`` sources and at most ``max_repositories`` documents have, n_copied the others.  A
    document is a doc_id, or a text where that is null.  A string of 20 or more characters with digits
    and letters of both cases, ``min_distinct`` of them different, is a value of kind live if it is not
    inside another match and as few sources and documents have it.  A null text is empty; all null sources are one owner;
    without a source column all rows have one owner.  Rows that repeat get the same result each.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(*key_columns(), source.alias("owner"))
    text = F.col("text")
    assign = F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_MIN)
    access = F.when(text.contains("AKIA"), _matches(text, ACCESS)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    token = F.filter(
        _matches(text, TOKEN),
        lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]") & (F.size(F.array_distinct(F.split(m["value"], ""))) >= min_distinct),
    )
    rows = rows.select("dkey", "tkey", "owner", assign.alias("assign"), access.alias("access"), _matches(text, HEX).alias("hex"), token.alias("token"))
    known = F.concat("assign", "access", "hex")
    rows = rows.withColumn("token", F.filter("token", lambda t: ~F.exists(known, lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"]))))
    base = _spans([(0, F.col("assign")), (1, F.col("access")), (2, F.col("hex"))])
    value = lambda k, x: F.transform(x, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.sha2(m["value"], 256).alias("hash")))
    rows = written(
        rows.select("dkey", "tkey", "owner", "assign", "access", "hex", base.alias("base"), F.concat(*(value(k, F.col(x)) for k, x in enumerate(("assign", "access", "hex", "token")))).alias("found"))
        .withColumn("assign", F.transform("assign", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
        .withColumn("access", F.transform("access", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
        .withColumn("hex", F.transform("hex", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    )
    each = rows.filter(F.size("found") > 0).select("dkey", "tkey", "owner", F.explode("found").alias("f")).select("dkey", "tkey", "owner", "f.*")
    # rows without an id are told apart by their texts; what is counted is distinct before one task has a hash
    repository = F.struct("dkey", F.when(F.col("dkey") == NULL_ID, F.col("tkey")).alias("tkey")).alias("repository")
    owners = each.select("hash", "owner", repository).distinct().groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    judged = joined(each, owners, ["hash"], "n_repositories", "dkey")
    own = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    per_row = judged.groupBy("dkey", "tkey").agg(
        F.collect_set(F.when(own & (F.col("kind") == 3), F.struct("start", "end"))).alias("live"),
        F.count_distinct(F.when(own, F.struct("kind", "start", "end"))).alias("n_live"),
        F.count_distinct(F.when(~own, F.struct("kind", "start", "end"))).alias("n_copied"),
    )
    out = rows.drop("found").join(per_row, ["dkey", "tkey"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        real_id(),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2("base", 256).alias("base_sha256"),
        _spans([*((i, F.col(k)) for i, k in enumerate(("assign", "access", "hex"))), (3, F.coalesce("live", none))]).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
