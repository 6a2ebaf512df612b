"""Which classes and members reflective calls mean: constants carried along definitions and uses.

A variable is a local, parameter, result or field, by any name that is its own.  Rows say which constants
it starts with, from which others it is assigned, and how it is computed; a fixed point carries values
along them in joins, a round at a time.  A variable with too many values has none: what is known of it ends
there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import Levels, bfs, settled
from weftgraph.operators.dispatch import subtypes

CONSTANTS = "var string, kind string, value string"
COPIES = "source string, target string"
OPERATIONS = "target string, op string, left string, right string"
CALLS = "caller string, ordinal int, operation string, var string, arity int"
#: Values that a variable has at most.
LIMIT = 16

#: By op: kinds of operands (None: there is no second), kind and value of the result.  A member's value is its
#: class and name, with a mark if inherited ones do not count.
MEMBER = {"METHOD_OF": ("METHOD", "#"), "DECLARED_METHOD_OF": ("METHOD", "!"), "FIELD_OF": ("FIELD", "#"), "DECLARED_FIELD_OF": ("FIELD", "!")}


def _result(op: Column, left_kind: Column, left: Column, right_kind: Column, right: Column) -> Column:
    """kind and value of an operation; null if its operands are of other kinds."""
    value = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
    string, class_ = left_kind == "STRING", left_kind == "CLASS"
    out = F.when((op == "CLASS_OF_NAME") & string, value("CLASS", F.replace(left, F.lit("."), F.lit("/")))).when((op == "NAME_OF") & class_, value("STRING", F.replace(left, F.lit("/"), F.lit("."))))
    out = out.when((op == "CONCAT") & string & (right_kind == "STRING"), value("STRING", F.concat(left, right)))
    for name, (kind, mark) in MEMBER.items():
        out = out.when((op == name) & class_ & (right_kind == "STRING"), value(kind, F.concat(left, F.lit(mark), right)))
    return out


@dataclass(frozen=True)
class Values:
    """``known`` (var, kind, value), and ``uncertain`` (var): variables that can have other values, too."""

    known: DataFrame
    uncertain: DataFrame


def _propagated(constants: DataFrame, copies: DataFrame, unary: DataFrame, binary: DataFrame, over: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """All values, where those of ``over`` (var) go nowhere, and ``over`` with what got too many."""
    front = settled(constants.select("var", "kind", "value").distinct())
    seen = Levels(front)
    while True:
        counts = seen.all.groupBy("var").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("var")
        over = settled(over.union(counts).distinct())
        live = settled(front.join(over, "var", "left_anti"))
        every = seen.all.join(over, "var", "left_anti")
        side = lambda df, c: df.select(F.col("var").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("value").alias(f"{c}_value"))
        moved = live.join(copies.select(F.col("source").alias("var"), "target"), "var").select(F.col("target").alias("var"), "kind", "value")
        none = F.lit(None).cast("string")
        ones = unary.join(side(live, "left"), "left").select("target", _result(F.col("op"), F.col("left_kind"), F.col("left_value"), none, none).alias("r"))
        pairs = binary.join(side(live, "left"), "left").join(side(every, "right"), "right").unionByName(binary.join(side(every, "left"), "left").join(side(live, "right"), "right"))
        twos = pairs.select("target", _result(F.col("op"), *(F.col(c) for c in ("left_kind", "left_value", "right_kind", "right_value"))).alias("r"))
        made = ones.union(twos).filter("r IS NOT NULL").select(F.col("target").alias("var"), "r.kind", "r.value")
        front = settled(moved.unionByName(made).distinct().join(seen.all, ["var", "kind", "value"], "left_anti"))
        if front.isEmpty():
            return seen.all, over
        seen.add(front)


def propagate(constants: DataFrame, opaque: DataFrame, copies: DataFrame, operations: DataFrame, limit: int = LIMIT) -> Values:
    """Values of all variables; those of ``opaque`` (var) are set by what nobody sees.

    A variable with more than ``limit`` values has none.  What had come from it before is taken back by
    starting again without it, until no more variables have too many; so the result does not depend on how
    the rows are split.
    """
    constants, copies = settled(constants), settled(copies.select("source", "target").distinct())
    unary, binary = settled(operations.filter("right IS NULL").drop("right").distinct()), settled(operations.filter("right IS NOT NULL").distinct())
    over, n = settled(constants.select("var").limit(0)), 0
    while True:
        known, over = _propagated(constants, copies, unary, binary, over, limit)
        if (more := over.count()) == n:
            break
        n = more
    into = copies.union(unary.select("left", "target")).union(binary.select("left", "target")).union(binary.select("right", "target"))
    doubt = bfs(into, opaque.select(F.col("var").alias("id")).union(over.select("var")))
    return Values(settled(known.join(over, "var", "left_anti")), settled(doubt.select(F.col("id").alias("var"))))


def _members(g: Graph, wanted: DataFrame) -> DataFrame:
    """value, id of the methods and fields that ``wanted`` (kind, value) of members mean.

    Without the mark only public ones, of the class or what it inherits from: methods of all its types, a
    field of the nearest, interfaces first.
    """
    at = wanted.filter("kind IN ('METHOD', 'FIELD')").select("kind", "value", (F.instr("value", "!") > 0).alias("own"), F.regexp_extract("value", "^([^#!]*)[#!]", 1).alias("class"), F.regexp_extract("value", "[#!](.*)$", 1).alias("name"))
    up = subtypes(g).select(F.col("target").alias("owner"), F.col("source").alias("up"), "depth")
    owners = at.withColumn("owner", F.concat(F.lit("class:"), "class"))
    types = owners.withColumns({"up": F.col("owner"), "depth": F.lit(0)}).unionByName(owners.filter("NOT own").join(up, "owner"))
    nodes = g.nodes.filter(F.contains("id", F.lit("#"))).select("id", S.owner_class(F.col("id")).alias("up"), F.regexp_extract("id", "#([^(:]*)", 1).alias("name"), F.when(F.col("kind").isin("METHOD", "FUNCTION"), "METHOD").when(F.col("id").startswith("field:"), "FIELD").alias("kind"), "visibility")
    face = g.nodes.select(F.col("id").alias("up"), (F.col("kind") != "INTERFACE").alias("class_"))
    hit = types.join(nodes, ["up", "name", "kind"]).filter(F.col("own") | (F.col("visibility") == "PUBLIC")).join(face, "up", "left")
    order = F.struct(F.col("depth") > 0, F.coalesce("class_", F.lit(True)), "depth")
    near = hit.filter("kind = 'FIELD'").groupBy("value").agg(F.min_by("id", order).alias("id"))
    return hit.filter("kind = 'METHOD'").select("value", "id").distinct().unionByName(near)


def runtime_values(g: Graph, values: Values, calls: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges: source, target, kind REFERENCE, origin RUNTIME_MODEL, weight; counts: operation, state, n).

    ``calls`` (caller, ordinal, operation, var, arity) load classes, construct, load services (``services``:
    service, provider), invoke methods or access fields; ``arity``, where known, is that of the constructor or
    method.  A call is ``unresolved`` if its variable has no known value or may have others, even where the
    known ones have edges; ``outside`` if all its values are known and none is in the graph; else ``resolved``.
    """
    calls = settled(calls)
    asked = calls.join(values.known, "var", "left")
    fits = F.when(F.col("operation").isin("CLASS_LOADING", "CONSTRUCTION", "SERVICE_LOADING"), F.col("kind") == "CLASS").when(F.col("operation") == "METHOD_INVOCATION", F.col("kind") == "METHOD").otherwise(F.col("kind") == "FIELD")
    asked = settled(asked.filter(F.coalesce(fits, F.lit(False))))
    arity = lambda: F.col("arity").isNull() | (F.col("arity") == F.size(F.regexp_extract_all(F.regexp_extract("id", r"\((.*)\)", 1), F.lit(r"(\[*(?:L[^;]*;|[BCDFIJSZ]))"), 1)))
    class_id = F.concat(F.lit("class:"), "value")
    of = ["caller", "ordinal", "operation", "var"]
    nodes = g.nodes.select("id", "kind", "visibility").withColumnRenamed("kind", "node_kind")
    loaded = asked.filter("operation = 'CLASS_LOADING'").withColumn("id", class_id).join(nodes.select("id"), "id", "left_semi").select(*of, "id")
    made = asked.filter("operation = 'CONSTRUCTION'").withColumn("owner", class_id).join(nodes.filter("node_kind = 'CONSTRUCTOR'").withColumn("owner", S.owner_class(F.col("id"))), "owner").filter(arity()).select(*of, "id")
    served = asked.filter("operation = 'SERVICE_LOADING'").join(services.select(F.concat(F.lit("class:"), "service").alias("s"), F.concat(F.lit("class:"), "provider").alias("id")), class_id == F.col("s")).join(nodes.select("id"), "id", "left_semi").select(*of, "id")
    members = asked.filter("operation IN ('METHOD_INVOCATION', 'FIELD_ACCESS')")
    used = members.join(_members(g, members.select("kind", "value").distinct()), "value").filter((F.col("operation") == "FIELD_ACCESS") | arity()).select(*of, "id")
    found = settled(loaded.unionByName(made).unionByName(served).unionByName(used).distinct())
    edges = found.groupBy(F.col("caller").alias("source"), F.col("id").alias("target")).agg(F.count_distinct("ordinal").alias("weight")).select("source", "target", F.lit("REFERENCE").alias("kind"), F.lit("RUNTIME_MODEL").alias("origin"), "weight")
    doubt = values.uncertain.withColumn("doubt", F.lit(True))
    state = calls.join(doubt, "var", "left").join(asked.select(*of).distinct().withColumn("known", F.lit(True)), of, "left").join(found.select(*of).distinct().withColumn("hit", F.lit(True)), of, "left")
    name = F.when(F.col("doubt") | F.col("known").isNull(), "unresolved").when(F.col("hit"), "resolved").otherwise("outside")
    return edges, state.groupBy("operation", name.alias("state")).agg(F.count("*").alias("n"))
