"""Calls that byte code does not name: members that frameworks call, declarations that a call means, and
what generators made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import bfs, settled
from weftgraph.operators.dispatch import methods
from weftgraph.operators.retention import below, supertypes

# Types whose members a framework calls back.
CALLBACK_TYPES = (
    "android/hardware/camera2/CameraCaptureSession$CaptureCallback",
    "android/hardware/camera2/CameraCaptureSession$StateCallback",
    "android/hardware/camera2/CameraDevice$StateCallback",
    "android/hardware/camera2/CameraManager$AvailabilityCallback",
    "android/webkit/WebViewClient",
    "androidx/lifecycle/ViewModel",
    "androidx/lifecycle/ViewModelProvider$Factory",
    "org/objectweb/asm/tree/analysis/Interpreter",
    "org/objectweb/asm/AnnotationVisitor",
    "org/objectweb/asm/ClassVisitor",
    "org/objectweb/asm/FieldVisitor",
    "org/objectweb/asm/MethodVisitor",
)
# Public methods of Object, which calls on interfaces mean before those of interfaces.
OBJECT_METHODS = (
    "equals(Ljava/lang/Object;)Z",
    "hashCode()I",
    "toString()Ljava/lang/String;",
    "getClass()Ljava/lang/Class;",
    "notify()V",
    "notifyAll()V",
    "wait()V",
    "wait(J)V",
    "wait(JI)V",
)
# Annotations of generated classes.
GENERATED_MARKERS = (
    "dagger/internal/DaggerGenerated",
    "dagger/hilt/codegen/OriginatingElement",
    "dagger/hilt/processor/internal/aggregateddeps/AggregatedDeps",
    "dagger/hilt/internal/componenttreedeps/ComponentTreeDeps",
    "dagger/hilt/internal/aggregatedroot/AggregatedRoot",
    "dagger/hilt/internal/processedrootsentinel/ProcessedRootSentinel",
)
#: Classes between the one that a call names and the one that declares the method, at most.
OWNER_CHAIN = 256


def _has(column: str, value: str):
    return F.coalesce(F.array_contains(column, value), F.lit(False))


def runtime_callbacks(g: Graph, types: tuple[str, ...] = CALLBACK_TYPES, hierarchy: DataFrame | None = None) -> DataFrame:
    """source (class), target (member), kind REFERENCE, origin RUNTIME_MODEL: constructors and methods, neither
    private nor static, of classes below one of ``types``, at any remove."""
    under = below(g, types, hierarchy).select(F.col("id").alias("owner"))
    part = g.nodes.filter(F.col("kind").isin("METHOD", "CONSTRUCTOR") & (F.coalesce("visibility", F.lit("")) != "PRIVATE") & ~_has("modifiers", "STATIC")).select(F.col("id").alias("target"), S.owner_class(F.col("id")).alias("owner"))
    return part.join(under, "owner", "left_semi").select(F.col("owner").alias("source"), "target", F.lit("REFERENCE").alias("kind"), F.lit("RUNTIME_MODEL").alias("origin"))


def library_overrides(g: Graph, library: DataFrame, hierarchy: DataFrame | None = None, limit: int = 256) -> DataFrame:
    """source (class), target (override), kind REFERENCE, origin LIBRARY_CALLBACK_MODEL of methods that override
    one of a library type.

    ``library`` has owner (class id), signature, visibility of what library types declare.  A class with more
    than ``limit`` supertypes has none: a list that was cut would look complete.
    """
    up = settled(supertypes(g, hierarchy))
    few = up.groupBy("source").agg(F.count_distinct("target").alias("n")).filter(F.col("n") <= limit).select("source")
    up = up.join(few, "source", "left_semi").join(g.nodes.select(F.col("id").alias("target")), "target", "left_anti").select(F.col("source").alias("owner"), F.col("target").alias("up")).distinct()
    open_ = library.filter(F.col("visibility").isin("PUBLIC", "PROTECTED")).select(F.col("owner").alias("up"), "signature").distinct()
    own = methods(g).filter((F.col("visibility") != "PRIVATE") & ~_has("modifiers", "STATIC") & ~F.col("signature").startswith("<")).select("id", "owner", "signature")
    found = own.join(up, "owner").join(open_, ["up", "signature"], "left_semi")
    return found.select(F.col("owner").alias("source"), F.col("id").alias("target"), F.lit("REFERENCE").alias("kind"), F.lit("LIBRARY_CALLBACK_MODEL").alias("origin")).distinct()


def inherited_interface_calls(g: Graph, calls: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """source (caller), target, kind CALL, origin BYTECODE, weight, lines: from calls on an interface that
    does not declare the method itself to the most specific declarations in its super-interfaces.

    ``calls`` has caller, owner (class id), signature, kind.  Nothing where one of those declarations has a
    body, which is dispatch's to find, or for methods of Object.  ``direct`` (source, target, weight, lines)
    are the byte-code call edges to the method as named; without any, calls count as one each.
    """
    m = methods(g)
    faces = g.nodes.filter("kind = 'INTERFACE'").select(F.col("id").alias("owner"))
    asked = calls.filter((F.col("kind") == "INTERFACE") & ~F.col("signature").isin(*OBJECT_METHODS)).join(faces, "owner", "left_semi").join(m.select("owner", "signature"), ["owner", "signature"], "left_anti")
    asked = settled(asked.groupBy("caller", "owner", "signature").agg(F.count("*").alias("calls")))
    up = settled(supertypes(g).select("source", "target"))
    able = m.filter((F.col("visibility") != "PRIVATE") & ~_has("modifiers", "STATIC") & ~_has("modifiers", "FINAL"))
    found = asked.select("owner", "signature").distinct().join(up.select(F.col("source").alias("owner"), F.col("target").alias("up")), "owner")
    found = settled(found.join(able.select(F.col("owner").alias("up"), "signature", F.col("id").alias("target"), (~_has("modifiers", "ABSTRACT")).alias("body")), ["up", "signature"]))
    # what another declaration's owner extends is hidden by it
    hidden = found.select("owner", "signature", F.col("up").alias("lower")).join(up.select(F.col("source").alias("lower"), F.col("target").alias("up")), "lower").select("owner", "signature", "up").distinct()
    specific = found.join(hidden, ["owner", "signature", "up"], "left_anti")
    plain = specific.groupBy("owner", "signature").agg(F.bool_or("body").alias("body")).filter("NOT body").select("owner", "signature")
    out = asked.join(specific.join(plain, ["owner", "signature"], "left_semi").select("owner", "signature", "target"), ["owner", "signature"])
    if direct is None:
        return out.select(F.col("caller").alias("source"), "target", F.lit("CALL").alias("kind"), F.lit("BYTECODE").alias("origin"), F.col("calls").alias("weight"), F.array().cast("array<int>").alias("lines"))
    named = F.concat(F.lit("method:"), F.regexp_replace("owner", "^class:", ""), F.lit("#"), "signature")
    seen = direct.groupBy(F.col("source").alias("caller"), F.col("target").alias("named")).agg(F.sum("weight").alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    out = out.withColumn("named", named).join(seen, ["caller", "named"], "left")
    weight = F.when(F.coalesce("w", F.lit(0)) > 0, F.col("w")).otherwise(F.col("calls"))
    return out.select(F.col("caller").alias("source"), "target", F.lit("CALL").alias("kind"), F.lit("BYTECODE").alias("origin"), weight.alias("weight"), F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))


def call_declarations(calls: DataFrame, classes: DataFrame, declared: DataFrame) -> DataFrame:
    """caller, owner, signature, kind, target, scope, chain of calls whose declaration is certain.

    ``calls`` (caller, owner, signature, kind; owners as class ids) name a class; ``classes`` (id, parent,
    interface, project) are known classes, and ``declared`` (owner, signature, visibility, static) what they
    declare.  The chain runs from the named class to the first that declares the method.  It breaks off at
    a class that is not known, at a method that is static where the call is not, or the other way, and at
    one that the caller's class may not use.  Calls by way of super name the caller's own parent.  A call
    on an interface means the public method that the interface itself, of a library, declares.
    """
    mine = S.owner_class(F.col("caller"))
    package = lambda c: F.regexp_replace(c, "[^/]*$", "")
    columns = ("caller", "owner", "signature", "kind")
    known = classes.select(F.col("id").alias("owner"), F.col("interface").alias("face"), "project")
    face = calls.filter("kind = 'INTERFACE'").join(known.filter("face AND NOT project"), "owner").join(declared.filter("visibility = 'PUBLIC' AND NOT static").select("owner", "signature"), ["owner", "signature"])
    named = lambda c: F.concat(F.lit("method:"), F.regexp_replace(c, "^class:", ""), F.lit("#"), "signature")
    done = [settled(face.select(*columns, named("owner").alias("target"), F.lit("EXTERNAL").alias("scope"), F.array("owner").alias("chain")).distinct())]
    front = calls.filter(F.col("kind").isin("VIRTUAL", "STATIC", "SPECIAL") & ~F.col("signature").startswith("<")).distinct()
    own = classes.select(F.col("id").alias("mine"), F.col("parent").alias("own_parent"))
    front = front.withColumn("mine", mine).join(own, "mine", "left").filter((F.col("kind") != "SPECIAL") | (F.col("own_parent") == F.col("owner")))
    front = settled(front.select(*columns, "mine", F.col("owner").alias("at"), F.array("owner").alias("chain")))
    # above the caller's class; and, of what a call names, whether it is below the caller's class
    parents = settled(classes.filter("NOT interface").select(F.col("id").alias("source"), F.col("parent").alias("target")).filter("target IS NOT NULL"))
    mark = declared.groupBy(F.col("owner").alias("at"), "signature").agg(F.count("*").alias("n"), F.first("visibility").alias("visibility"), F.first("static").alias("static"))
    plain = classes.filter("NOT interface").select(F.col("id").alias("at"), "parent", "project")
    asked = None
    for _ in range(OWNER_CHAIN):
        hit = settled(front.join(plain, "at").join(mark, ["at", "signature"], "left"))
        found = hit.filter("n IS NOT NULL")
        done.append(settled(found.filter((F.col("n") == 1) & (F.col("static") == (F.col("kind") == "STATIC"))).select(*columns, "mine", "at", "visibility", named("at").alias("target"), F.when(F.col("project"), "PROJECT").otherwise("EXTERNAL").alias("scope"), "chain")))
        front = settled(hit.filter(F.col("n").isNull() & F.col("parent").isNotNull() & ~F.array_contains("chain", F.col("parent"))).select(*columns, "mine", F.col("parent").alias("at"), F.concat("chain", F.array("parent")).alias("chain")))
        if front.isEmpty():
            break
    found = done[1]
    for x in done[2:]:
        found = found.unionByName(x)
    found = settled(found)
    # protected members of other packages: the caller's class is below, and so is, for virtual calls, what it names
    far = found.filter((F.col("visibility") == "PROTECTED") & (package("at") != package("mine")))
    asked = settled(far.select(F.col("mine").alias("id")).union(far.select("owner")).distinct())
    above = settled(_above(parents, asked))
    child = above.select(F.col("id").alias("mine"), "at", F.lit(True).alias("child"))
    below = above.select(F.col("id").alias("owner"), F.col("at").alias("mine"), F.lit(True).alias("below"))
    found = found.join(child, ["mine", "at"], "left").join(below, ["owner", "mine"], "left")
    near = package("at") == package("mine")
    may = F.when(F.col("visibility") == "PUBLIC", True).when(F.col("visibility") == "PRIVATE", F.col("at") == F.col("mine")).when(F.col("visibility") == "PACKAGE_PRIVATE", near)
    may = may.when(F.col("visibility") == "PROTECTED", near | (F.coalesce("child", F.lit(False)) & ((F.col("kind") != "VIRTUAL") | F.coalesce("below", F.lit(False))))).otherwise(False)
    return done[0].unionByName(found.filter(may).select(*columns, "target", "scope", "chain"))


def _above(parents: DataFrame, ids: DataFrame) -> DataFrame:
    """id, at: each of ``ids`` with itself and the classes above it."""
    from weftgraph.iterate import closure

    up = closure(parents, ids).select(F.col("source").alias("id"), F.col("target").alias("at"))
    return up.unionByName(ids.select("id", F.col("id").alias("at"))).distinct()


def generated_marking(nodes: DataFrame, enclosing: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """``nodes`` with synthesized true for generated classes and their members.

    Generated are classes with one of GENERATED_MARKERS, those of ``siblings`` (id), and all classes inside
    a generated one; ``enclosing`` (source, target) leads from a class to those that it encloses.
    """
    marked = nodes.filter(F.col("id").startswith("class:") & F.exists("annotations", lambda a: a.isin(*GENERATED_MARKERS))).select("id")
    start = marked if siblings is None else marked.unionByName(siblings.select("id"))
    made = bfs(enclosing, start).select(F.col("id").alias("owner"), F.lit(True).alias("made"))
    columns = [F.coalesce("made", "synthesized").alias(c) if c == "synthesized" else F.col(c) for c in nodes.columns]
    return nodes.withColumn("owner", S.owner_class(F.col("id"))).join(made, "owner", "left").select(*columns)
