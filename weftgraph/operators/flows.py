"""Callbacks through parameters: which method runs a lambda that another one hands to it.

A lambda is given to a parameter; from there its value goes on as an argument or a capture, is called, or
gets away.  Vertices of the search are parameters, found once for each parameter that lambdas are given to,
however many there are; only then do the lambdas join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import Levels, settled
from weftgraph.operators.dispatch import bodies, concrete_below, subtypes

ARGUMENTS = "caller string, lambda string, callee string, invocation string, argument int, sam string"
USES = "method string, parameter int, kind string, target string, invocation string, position int"
ESCAPES = "caller string, lambda string"
#: Steps that a value is followed for from the parameter it was given to.
DEPTH = 8

# Calls that only look at a value, methods of Object, and types whose calls run a function.
INSPECTIONS = {
    "kotlin/jvm/internal/Intrinsics": ("checkNotNull", "checkNotNullParameter", "checkNotNullExpressionValue", "checkParameterIsNotNull", "checkExpressionValueIsNotNull", "areEqual"),
    "java/util/Objects": ("equals", "hashCode", "isNull", "nonNull"),
    "androidx/compose/runtime/Composer": ("changed", "changedInstance"),
}
HARMLESS = ("toString()Ljava/lang/String;", "hashCode()I", "equals(Ljava/lang/Object;)Z", "getClass()Ljava/lang/Class;")
FUNCTIONAL = r"^(kotlin/jvm/functions/.+|kotlin/Function|kotlin/jvm/internal/FunctionBase|kotlin/reflect/K(Suspend)?Function\d*|java/util/function/.+|java/lang/Runnable|java/util/concurrent/Callable)$"

PAIR = ("method", "parameter")


def _owner(id_: Column) -> Column:
    return F.when(id_.startswith("method:"), F.regexp_replace(S.owner_class(id_), "^class:", ""))


def inspection_only(target: Column) -> Column:
    """A library call that compares a value and cannot give it back."""
    name, result = F.regexp_extract(target, r"#([^(]*)\(", 1), F.substring_index(target, ")", -1)
    known = F.lit(False)
    for owner, names in INSPECTIONS.items():
        known = known | ((_owner(target) == owner) & name.isin(*names))
    return F.coalesce(known & ~result.rlike(r"^[L\[]"), F.lit(False))


def virtual_bodies(nodes: DataFrame) -> DataFrame:
    """Methods that a virtual call can run."""
    none = lambda m: ~F.coalesce(F.array_contains("modifiers", m), F.lit(False))
    return nodes.filter(F.col("kind").isin("METHOD", "FUNCTION") & none("ABSTRACT") & none("STATIC") & (F.coalesce("visibility", F.lit("PUBLIC")) != "PRIVATE"))


def callees(g: Graph, calls: DataFrame, subs: DataFrame, runs: DataFrame) -> DataFrame:
    """target, invocation, scope (PROJECT, EXTERNAL, AMBIGUOUS), callee of distinct ``calls`` (target, invocation).

    A static or special call means the method it names, or the nearest declaration of a project superclass;
    a virtual one means a project method only if all concrete subtypes of its owner run the same.
    """
    virtual = F.col("invocation").isin("VIRTUAL", "INTERFACE")
    calls = calls.distinct().withColumns({"owner": S.owner_class(F.col("target")), "signature": S.member_signature(F.col("target"))})
    calls = settled(calls.join(g.nodes.select(F.col("id").alias("target"), F.lit(True).alias("there")), "target", "left").join(g.nodes.filter(F.col("id").startswith("class:")).select(F.col("id").alias("owner"), F.lit(True).alias("ours")), "owner", "left"))
    asked = calls.filter(virtual & F.col("ours")).select("owner", "signature").distinct()
    only = asked.join(concrete_below(g, subs), "owner").join(runs, ["type", "signature"], "left").groupBy("owner", "signature").agg(F.min("body").alias("only"), (F.count_distinct("body") + F.max(F.col("body").isNull().cast("int"))).alias("n")).filter("n = 1").select("owner", "signature", "only")
    classes = g.nodes.filter(F.col("kind").isin("CLASS", "OBJECT", "ENUM")).select(F.col("id").alias("up"))
    chain = subs.select(F.col("target").alias("owner"), F.col("source").alias("up"), "depth").join(classes, "up", "left_semi")
    inherited = calls.filter(~virtual & F.col("there").isNull() & F.col("ours")).select("owner", "signature").distinct().join(chain, "owner")
    inherited = inherited.withColumn("id", F.concat(F.regexp_replace("up", "^class:", "method:"), F.lit("#"), "signature")).join(g.nodes.select("id"), "id", "left_semi").groupBy("owner", "signature").agg(F.min_by("id", "depth").alias("above"))
    out = calls.join(only, ["owner", "signature"], "left").join(inherited, ["owner", "signature"], "left")
    callee = F.when(~virtual, F.coalesce(F.when(F.col("there"), F.col("target")), F.col("above"))).otherwise(F.col("only"))
    method = F.coalesce(F.col("target").rlike("^method:[^#]+#.+"), F.lit(False))
    scope = F.when(callee.isNotNull(), "PROJECT").when(method & F.col("ours").isNull(), "EXTERNAL").otherwise("AMBIGUOUS")
    return out.select("target", "invocation", scope.alias("scope"), callee.alias("callee"))


def _ambiguous() -> Column:
    return F.when(F.col("invocation").isin("VIRTUAL", "INTERFACE"), "dispatch").otherwise("unresolved-callee")


@dataclass(frozen=True)
class Parameters:
    """What happens to values of parameters (method, parameter): ``links`` to the next ones (to_method,
    to_parameter, closure), ``escapes`` (reason), ``handed`` to a library, and ``received`` (target) calls on them."""

    links: DataFrame
    escapes: DataFrame
    handed: DataFrame
    received: DataFrame


def parameters(g: Graph, uses: DataFrame, resolved: DataFrame) -> Parameters:
    declared = uses.filter("kind = 'DECLARED'").select(*PAIR).distinct()
    uses = settled(uses.filter("kind <> 'DECLARED'").join(declared, [*PAIR], "left_semi"))
    passed = uses.filter((F.col("kind") == "ARGUMENT") & ~inspection_only(F.col("target"))).join(resolved, ["target", "invocation"])
    caught = uses.filter("kind = 'CAPTURE'").join(g.nodes.select(F.col("id").alias("target"), F.lit(True).alias("there")), "target", "left")
    forward = passed.filter("scope = 'PROJECT'").select(*PAIR, F.col("callee").alias("to_method"), F.col("position").alias("to_parameter"), F.lit(False).alias("closure"))
    links = forward.unionByName(caught.filter("there").select(*PAIR, F.col("target").alias("to_method"), F.col("position").alias("to_parameter"), F.lit(True).alias("closure"))).distinct()
    links = links.join(declared.withColumn("known", F.lit(True)).withColumnsRenamed({"method": "to_method", "parameter": "to_parameter"}), ["to_method", "to_parameter"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    other = uses.filter(~F.col("kind").isin("ARGUMENT", "CAPTURE", "RECEIVER")).select(*PAIR, F.lower("kind").alias("reason"))
    escapes = passed.filter("scope = 'AMBIGUOUS'").select(*PAIR, _ambiguous().alias("reason")).unionByName(caught.filter("there IS NULL").select(*PAIR, F.lit("capture").alias("reason"))).unionByName(other)
    return Parameters(settled(links), settled(escapes.distinct()), settled(passed.filter("scope = 'EXTERNAL'").select(*PAIR).distinct()), settled(uses.filter("kind = 'RECEIVER'").select(*PAIR, "target").distinct()))


def _fixed_point(front: DataFrame, step, keys: list[str], rounds: int | None = None) -> DataFrame:
    """``front`` and all that ``step`` adds to it, a round at a time; ``step`` gets what is new and its round."""
    front = settled(front)
    seen, k = Levels(front), 0
    while rounds is None or k < rounds:
        k += 1
        front = settled(step(front, k).join(seen.all.select(*keys), keys, "left_anti"))
        if front.isEmpty():
            break
        seen.add(front)
    return seen.all


def callback_flows(g: Graph, arguments: DataFrame, uses: DataFrame, escapes: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(edges: source, target, tier; flows: the arguments with outcome and reasons).

    ``arguments`` say that ``caller`` gives ``lambda`` to a parameter of ``callee`` (``sam``: the signature that
    runs it, null if the lambda is a local class), ``uses`` what is done with parameters, where those without a
    DECLARED row are unknown, and ``escapes`` which lambdas are also used otherwise where they are made.  Each
    method on the way from the parameter to a call of the lambda, or to a library, has an edge to the body.
    BOUND: all calls of the lambda are known, for all that its maker does with it; else CANDIDATE.  A flow
    that only gets away has no edges and is ``unresolved``, with its reasons in order; one that does nothing
    with the value is ``unused``; a lambda given to a library right away is ``library``.
    """
    subs = settled(subtypes(g))
    runs = settled(bodies(g, subs))
    calls = arguments.select(F.col("callee").alias("target"), "invocation").unionByName(uses.filter("kind = 'ARGUMENT'").select("target", "invocation"))
    resolved = settled(callees(g, calls, subs, runs))
    p = parameters(g, uses, resolved)

    given = arguments.withColumn("flow", F.xxhash64("caller", "lambda", "callee", "invocation", "argument", F.coalesce("sam", F.lit("")))).dropDuplicates(["flow"])
    given = given.join(resolved.select(F.col("target").alias("callee"), "invocation", "scope", F.col("callee").alias("to")), ["callee", "invocation"])
    given = settled(given.withColumnsRenamed({"to": "s_method"}).withColumn("s_parameter", F.col("argument")))
    flows = given.filter("scope = 'PROJECT'").select("flow", "lambda", "sam", "s_method", "s_parameter")
    start = ["s_method", "s_parameter"]
    at = [*start, *PAIR]

    # parameters that values given to one reach, within ``depth`` steps
    seeds = flows.select(*start).distinct()
    first = seeds.select(*start, F.col("s_method").alias("method"), F.col("s_parameter").alias("parameter"), F.lit(0).alias("depth"))
    known = uses.filter("kind = 'DECLARED'").select(*PAIR).distinct().withColumn("known", F.lit(True))
    first = first.join(known, [*PAIR], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    onward = lambda front: front.join(p.links.withColumnRenamed("known", "to_known"), [*PAIR])
    moved = lambda df, *more: df.select(*start, F.col("to_method").alias("method"), F.col("to_parameter").alias("parameter"), *more)
    reach = settled(_fixed_point(first, lambda front, k: moved(onward(front.drop("known")), F.lit(k).alias("depth"), F.col("to_known").alias("known")).distinct(), at, depth))
    far = moved(onward(reach.filter(F.col("depth") == depth).drop("known"))).distinct().join(reach.select(*at), at, "left_anti")
    away = reach.filter("NOT known").select(*start, F.lit("unanalyzed").alias("reason")).unionByName(far.select(*start, F.lit("depth").alias("reason"))).unionByName(reach.join(p.escapes, [*PAIR]).select(*start, "reason")).distinct()

    # what runs a lambda: calls on the value that mean its body, and libraries that get it
    kinds = flows.select("lambda", "sam", *start).distinct()
    called = kinds.join(reach.join(p.received, [*PAIR]), start).withColumns({"signature": S.member_signature(F.col("target")), "type": F.col("lambda")})
    called = called.join(runs, ["type", "signature"], "left")
    body = F.when(F.col("sam").isNotNull(), F.when(F.col("signature") == F.col("sam"), F.col("lambda"))).otherwise(F.col("body"))
    of = ["lambda", "sam", *start]
    called = settled(called.select(*of, *PAIR, body.alias("body"), _owner(F.col("target")).rlike(FUNCTIONAL).alias("functional"), F.col("signature").isin(*HARMLESS).alias("harmless")))
    handed = called.filter("body IS NULL AND functional").select(*of, *PAIR).unionByName(kinds.join(reach.join(p.handed, [*PAIR]).select(*at), start).select(*of, *PAIR)).distinct()
    members = g.edges.filter("kind = 'MEMBER'").select(F.col("source").alias("lambda"), F.col("target").alias("id")).join(virtual_bodies(g.nodes).filter("kind = 'METHOD'").select("id"), "id", "left_semi")
    every = handed.filter("sam IS NOT NULL").withColumn("body", F.col("lambda")).unionByName(handed.filter("sam IS NULL").join(members.select("lambda", F.col("id").alias("body")), "lambda"))
    sites = settled(called.filter("body IS NOT NULL").select(*of, *PAIR, "body").unionByName(every.select(*of, *PAIR, "body")).distinct())

    # a capture that leads to calls which nothing else leads to: nobody knows who runs it, and when
    plain = p.links.filter("NOT closure").withColumnRenamed("known", "to_known")
    inside = reach.select(*at)
    without = _fixed_point(first.select(*at), lambda front, _: moved(front.join(plain, [*PAIR])).distinct().join(inside, at, "left_semi"), at)
    added = sites.join(without, at, "left_anti").select(*of).distinct()

    # back to where a value came from, along the links of its own start: a parameter can have those of all
    # callers.  The ways to a site are the same for all lambdas given to one parameter
    back = settled(onward(inside).select(*start, F.col("method").alias("from_method"), F.col("parameter").alias("from_parameter"), F.col("to_method").alias("method"), F.col("to_parameter").alias("parameter")).distinct())
    site = [*start, "x_method", "x_parameter"]
    up = lambda front, _: front.join(back, at).select(*site, F.col("from_method").alias("method"), F.col("from_parameter").alias("parameter")).distinct()
    placed = sites.withColumnsRenamed({"method": "x_method", "parameter": "x_parameter"})
    leads = _fixed_point(placed.select(*site, F.col("x_method").alias("method"), F.col("x_parameter").alias("parameter")).distinct(), up, [*site, *PAIR])
    pairs = settled(placed.join(leads, site).filter("method <> body").select(*of, F.col("method").alias("source"), F.col("body").alias("target")).distinct())

    own = kinds.join(away, start).select(*of, "reason").unionByName(called.filter("body IS NULL AND NOT coalesce(functional, false) AND NOT coalesce(harmless, false) AND functional IS NOT NULL").select(*of, F.lit("receiver").alias("reason"))).unionByName(added.withColumn("reason", F.lit("closure")))
    reasons = own.groupBy(*of).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    join = lambda a, b, how: a.join(b.withColumn("sam", F.coalesce("sam", F.lit(""))), of, how)
    plainly = given.withColumnRenamed("sam", "sam_").withColumn("sam", F.coalesce("sam_", F.lit("")))
    state = join(join(join(plainly, reasons, "left"), handed.select(*of).distinct().withColumn("handed", F.lit(True)), "left"), pairs.select(*of).distinct().withColumn("edges", F.lit(True)), "left")
    clean = F.when(F.col("scope") == "PROJECT", F.col("reasons").isNull() & F.col("handed").isNull()).when(F.col("scope") == "EXTERNAL", inspection_only(F.col("callee"))).otherwise(False)
    escaped = escapes.select("caller", "lambda").distinct().withColumn("escaped", F.lit(True))
    state = settled(state.withColumn("clean", clean).join(escaped, ["caller", "lambda"], "left"))
    cohort = state.groupBy("caller", "lambda").agg((F.bool_and("clean") & ~F.coalesce(F.bool_or("escaped"), F.lit(False))).alias("bound"))
    state = settled(state.join(cohort, ["caller", "lambda"]).withColumn("tier", F.when(F.col("bound"), "BOUND").otherwise("CANDIDATE")))
    outcome = F.when(F.col("scope") == "EXTERNAL", "library").when(F.col("scope") == "AMBIGUOUS", "unresolved").when(F.col("edges"), F.lower("tier")).when(F.col("reasons").isNotNull(), "unresolved").otherwise("unused")
    why = F.when(F.col("scope") == "AMBIGUOUS", F.array(_ambiguous())).when((F.col("scope") == "PROJECT") & F.col("edges").isNull(), F.coalesce("reasons", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    out = state.select("caller", "lambda", "callee", "invocation", "argument", F.col("sam_").alias("sam"), outcome.alias("outcome"), why.alias("reasons"))
    edges = join(state.filter("edges").select(*of, "tier"), pairs, "inner").groupBy("source", "target").agg(F.max("tier").alias("tier"))  # the weaker, CANDIDATE, comes later
    return edges, out


def callback_edges(edges: DataFrame) -> DataFrame:
    """The edges as a traversal takes them; they end there, since they hold for one caller only."""
    return edges.select("source", "target", F.lit("callback").alias("relationship"), "tier", F.lit(None).cast("string").alias("class_role"), F.lit(True).alias("terminal"))


def callback_summary(flows: DataFrame) -> DataFrame:
    """outcome, reason, n: bound, candidate and unresolved flows, and the unresolved by each of their reasons."""
    known = flows.filter(F.col("outcome").isin("bound", "candidate", "unresolved"))
    total = known.groupBy("outcome").agg(F.count("*").alias("n")).select("outcome", F.lit(None).cast("string").alias("reason"), "n")
    return total.unionByName(known.filter("outcome = 'unresolved'").select("outcome", F.explode("reasons").alias("reason")).groupBy("outcome", "reason").agg(F.count("*").alias("n")))
