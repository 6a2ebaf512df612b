"""Evidence of why a declaration is kept: rows of node_id, reason, path, line."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import bfs, closure, settled

COLUMNS = ("node_id", "reason", "path", "line")
KEEP = "androidx/annotation/Keep"
PREVIEW = "androidx/compose/ui/tooling/preview/Preview"
WORKER = "androidx/work/ListenableWorker"

# Annotations that keep a declaration, by reason. Those of MEMBER_ONLY keep no owner.
DEPENDENCY_INJECTION = (
    "javax/inject/Inject",
    "jakarta/inject/Inject",
    "dagger/Provides",
    "dagger/Binds",
    "dagger/Module",
    "dagger/Multibinds",
    "dagger/BindsOptionalOf",
    "dagger/hilt/InstallIn",
    "dagger/hilt/android/AndroidEntryPoint",
    "dagger/hilt/android/HiltAndroidApp",
    "dagger/hilt/android/lifecycle/HiltViewModel",
    "dagger/assisted/AssistedInject",
    "dagger/assisted/AssistedFactory",
    "dagger/Component",
    "dagger/Component$Builder",
    "dagger/Component$Factory",
    "dagger/Subcomponent",
    "dagger/Subcomponent$Builder",
    "dagger/Subcomponent$Factory",
    "dagger/hilt/EntryPoint",
    "androidx/hilt/work/HiltWorker",
)
SERIALIZATION = (
    "kotlinx/serialization/Serializable",
    "com/google/gson/annotations/SerializedName",
    "com/squareup/moshi/Json",
    "com/squareup/moshi/JsonClass",
    "kotlinx/parcelize/Parcelize",
    "kotlinx/android/parcel/Parcelize",
    "androidx/room/Entity",
    "androidx/room/Dao",
    "androidx/room/Database",
    "com/google/gson/annotations/Expose",
    "androidx/room/TypeConverter",
)
RUNTIME_ENTRY_POINT = (
    "android/webkit/JavascriptInterface",
    "androidx/compose/ui/tooling/preview/Preview",
    "androidx/compose/ui/tooling/preview/Preview$Container",
    "org/junit/Test",
    "org/junit/jupiter/api/Test",
    "org/junit/jupiter/api/RepeatedTest",
    "org/junit/jupiter/api/TestFactory",
    "org/junit/jupiter/api/TestTemplate",
    "org/junit/jupiter/params/ParameterizedTest",
    "org/robolectric/annotation/Config",
    "retrofit2/http/DELETE",
    "retrofit2/http/GET",
    "retrofit2/http/HEAD",
    "retrofit2/http/HTTP",
    "retrofit2/http/OPTIONS",
    "retrofit2/http/PATCH",
    "retrofit2/http/POST",
    "retrofit2/http/PUT",
)
MEMBER_ONLY = (
    "org/junit/Before",
    "org/junit/After",
    "org/junit/BeforeClass",
    "org/junit/AfterClass",
    "org/junit/Rule",
    "org/junit/ClassRule",
    "org/junit/runners/Parameterized$Parameters",
    "org/junit/runners/Parameterized$Parameter",
    "org/junit/jupiter/api/BeforeEach",
    "org/junit/jupiter/api/AfterEach",
    "org/junit/jupiter/api/BeforeAll",
    "org/junit/jupiter/api/AfterAll",
    "org/junit/jupiter/api/extension/RegisterExtension",
)


def _evidence(df: DataFrame, reason) -> DataFrame:
    return df.select(F.col("id").alias("node_id"), reason.alias("reason"), "path", "line")


def members(g: Graph) -> DataFrame:
    return g.edges.filter("kind = 'MEMBER'").select("source", "target")


def all_owners(g: Graph, ids: DataFrame) -> DataFrame:
    """id and each of its owners, over all levels."""
    up = members(g).groupBy(F.col("target").alias("source")).agg(F.min("source").alias("target"))
    return closure(up, ids).select(F.col("source").alias("id"), F.col("target").alias("owner"))


def annotated(g: Graph, table: list[tuple[str, str, bool]]) -> DataFrame:
    """Evidence from annotations (name, reason, whether owners are kept, too)."""
    rules = g.nodes.sparkSession.createDataFrame(table, "annotation string, reason string, owners boolean")
    hit = g.nodes.select("id", "path", "line", F.explode("annotations").alias("annotation")).join(F.broadcast(rules), "annotation")
    own = _evidence(hit, F.col("reason"))
    up = hit.filter("owners").select("id", "reason", "path", "line").distinct()
    owners = all_owners(g, up.select("id"))
    return own.unionByName(up.join(owners, "id").select(F.col("owner").alias("node_id"), "reason", "path", "line")).distinct()


def framework(g: Graph) -> DataFrame:
    """The table above, and annotations that are previews themselves, at any remove, for their members only."""
    table = [(a, "DEPENDENCY_INJECTION", True) for a in DEPENDENCY_INJECTION] + [(a, "SERIALIZATION", True) for a in SERIALIZATION]
    table += [(a, "RUNTIME_ENTRY_POINT", True) for a in RUNTIME_ENTRY_POINT] + [(a, "RUNTIME_ENTRY_POINT", False) for a in MEMBER_ONLY]
    types = g.nodes.filter("kind = 'ANNOTATION_CLASS'").select(F.explode("annotations").alias("source"), F.regexp_replace("id", "^class:", "").alias("target"))
    spark = g.nodes.sparkSession
    direct = spark.createDataFrame([(PREVIEW,), (PREVIEW + "$Container",)], "id string")
    multi = bfs(types, direct).filter("depth > 0").select(F.col("id").alias("annotation"))
    hit = g.nodes.select("id", "path", "line", F.explode("annotations").alias("annotation")).join(multi, "annotation")
    return annotated(g, table).unionByName(_evidence(hit, F.lit("RUNTIME_ENTRY_POINT"))).distinct()


def keep_annotation(g: Graph) -> DataFrame:
    """@Keep on a declaration; its owners, and a kept class's members, each under a reason of their own."""
    hit = g.nodes.filter(F.array_contains("annotations", KEEP)).select("id", "path", "line")
    up = hit.join(all_owners(g, hit.select("id")), "id").select(F.col("owner").alias("id"), "path", "line")
    down = hit.filter("id LIKE 'class:%'").withColumnRenamed("id", "source").join(members(g), "source").select(F.col("target").alias("id"), "path", "line")
    return _evidence(hit, F.lit("KEEP_ANNOTATION")).unionByName(_evidence(up, F.lit("KEEP_ANNOTATED_MEMBER"))).unionByName(_evidence(down, F.lit("KEEP_ANNOTATED_CLASS_MEMBER"))).distinct()


def direct_supertypes(g: Graph, hierarchy: DataFrame | None = None) -> DataFrame:
    """source, target: class ids and what they extend; ``hierarchy`` (name, supertypes) knows library classes."""
    types = g.nodes.select(F.col("id").alias("source"), F.explode("supertypes").alias("t"))
    if hierarchy is not None:
        types = types.unionByName(hierarchy.select(F.concat(F.lit("class:"), "name").alias("source"), F.explode("supertypes").alias("t")))
    return types.select("source", F.concat(F.lit("class:"), "t").alias("target"))


def supertypes(g: Graph, hierarchy: DataFrame | None = None) -> DataFrame:
    """source, target, depth: class ids and all their supertypes."""
    return closure(direct_supertypes(g, hierarchy)).select("source", "target", "depth")


def below(g: Graph, types: tuple[str, ...], hierarchy: DataFrame | None = None) -> DataFrame:
    """id of all that extends one of ``types`` (internal names), at any remove: a search down from these, which
    looks at no other part of the hierarchy."""
    down = direct_supertypes(g, hierarchy).select(F.col("target").alias("source"), F.col("source").alias("target"))
    starts = g.nodes.sparkSession.createDataFrame([(f"class:{t}",) for t in types], "id string")
    # a listed type that extends another one is below it, too
    under = down.join(F.broadcast(starts.select(F.col("id").alias("source"))), "source", "left_semi").select(F.col("target").alias("id"))
    return bfs(down, under).select("id")


def android_entries(g: Graph, hierarchy: DataFrame | None = None) -> DataFrame:
    """Native methods with their owners, and workers."""
    native = g.nodes.filter(F.array_contains("modifiers", "NATIVE")).select("id", "path", "line")
    owners = native.join(all_owners(g, native.select("id")), "id").select(F.col("owner").alias("id"), "path", "line")
    worker = below(g, (WORKER,), hierarchy)
    return _evidence(native.unionByName(owners).unionByName(g.nodes.join(worker, "id", "left_semi").select("id", "path", "line")), F.lit("RUNTIME_ENTRY_POINT")).distinct()


def inline_constants(g: Graph) -> DataFrame:
    hit = g.nodes.filter(F.array_contains("attributes", "COMPILE_TIME_CONSTANT")).select("id", "path", "line")
    owner = hit.withColumnRenamed("id", "target").join(members(g), "target").select(F.col("source").alias("id"), "path", "line")
    return _evidence(hit.unionByName(owner), F.lit("INLINE_CONSTANT")).distinct()


def services(g: Graph, providers: DataFrame) -> DataFrame:
    return providers.select(F.concat(F.lit("class:"), F.replace("provider", F.lit("."), F.lit("/"))).alias("node_id"), F.lit("SERVICE_PROVIDER").alias("reason"), "path", "line").distinct()


def generated_siblings(g: Graph) -> DataFrame:
    """Generated companions, by exact name, of annotated classes that the graph has."""
    name = F.regexp_replace("id", "^class:", "")
    package = F.when(F.instr(name, "/") > 0, F.regexp_replace(name, "[^/]*$", "")).otherwise("")
    simple = F.replace(F.substring_index(name, "/", -1), F.lit("$"), F.lit("_"))
    has = lambda a: F.array_contains("annotations", a)
    app = has("dagger/hilt/android/HiltAndroidApp") & (F.instr(name, "$") == 0)
    names = F.array_compact(F.array(
        F.when(has("com/squareup/moshi/JsonClass"), F.concat(package, simple, F.lit("JsonAdapter"))),
        F.when(has("androidx/room/Database"), F.concat(name, F.lit("_Impl"))),
        F.when(has("dagger/hilt/android/AndroidEntryPoint") | app, F.concat(package, F.lit("Hilt_"), simple)),
        F.when(app, F.concat(name, F.lit("_HiltComponents"))),
        F.when(app, F.concat(package, F.lit("Dagger"), simple, F.lit("_HiltComponents_SingletonC"))),
    ))
    made = g.nodes.filter("id LIKE 'class:%'").select(F.explode(names).alias("n"), "path", "line").select(F.concat(F.lit("class:"), "n").alias("id"), "path", "line")
    return _evidence(made.join(g.nodes.select("id"), "id", "left_semi"), F.lit("GENERATED_CODE")).distinct()


def bridge_owners(g: Graph, evidence: DataFrame) -> DataFrame:
    """``evidence``, with that of cross-language bridges copied to all owners."""
    up = evidence.filter("reason = 'EXTERNAL_BRIDGE'")
    owners = all_owners(g, up.select(F.col("node_id").alias("id")))
    return evidence.select(*COLUMNS).unionByName(up.withColumnRenamed("node_id", "id").join(owners, "id").select(F.col("owner").alias("node_id"), "reason", "path", "line")).distinct()


def runtime_expanded(g: Graph, evidence: DataFrame) -> DataFrame:
    """``evidence``, with that of owners under ``OWNER_REASONS`` copied to their direct members."""
    up = evidence.filter(F.col("reason").isin(*S.OWNER_REASONS)).withColumnRenamed("node_id", "source")
    return evidence.select(*COLUMNS).unionByName(up.join(members(g), "source").select(F.col("target").alias("node_id"), "reason", "path", "line")).distinct()


def private_expanded(g: Graph, evidence: DataFrame) -> DataFrame:
    """``evidence``, with what it reaches over usages and over members that are not private, as possible entries."""
    private = g.nodes.filter(F.col("visibility").isin("PRIVATE", "PRIVATE_TO_THIS")).select(F.col("id").alias("target"))
    down = members(g).join(private, "target", "left_anti").select("source", "target")
    ways = g.edges.filter(S.is_usage(F.col("kind"))).select("source", "target").unionByName(down)
    found = bfs(ways, evidence.select(F.col("node_id").alias("id")).join(g.nodes.select("id"), "id", "left_semi"))
    entries = down.join(found.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    entries = entries.join(evidence.select(F.col("node_id").alias("id")), "id", "left_anti").join(g.nodes.select("id", "path", "line"), "id")
    return evidence.select(*COLUMNS).unionByName(_evidence(entries, F.lit("EXTERNAL_MEMBER_ENTRY")))


_CLASS_GLOB = re.compile(r"\*\*|[*?.]|[^*?.]+")
_CLASS_TOKENS = {"**": ".*", "*": "[^/]*", "?": "[^/]", ".": "/"}
_MEMBER_GLOB = re.compile(r"[*?]|[^*?]+")


def class_glob(glob: str) -> str:
    """Class pattern over internal names: ** any run, * a run without /, ? one character but /, . is /."""
    if glob == "*":
        return "^.*$"
    return "^" + _CLASS_GLOB.sub(lambda m: _CLASS_TOKENS.get(m[0]) or re.escape(m[0]), glob) + "$"


def member_glob(glob: str) -> str:
    return "^" + _MEMBER_GLOB.sub(lambda m: {"*": ".*", "?": "."}.get(m[0]) or re.escape(m[0]), glob) + "$"


#: Kinds of declaration that a rule names; ! before one takes the others.
DECLARATIONS = {"class": S.TYPE_KINDS, "interface": ("INTERFACE", "ANNOTATION_CLASS"), "enum": ("ENUM",), "@interface": ("ANNOTATION_CLASS",)}
VISIBILITIES = ("public", "private", "protected")
_RULES = (
    "rule int, path string, line int, kinds array<string>, package string, start string, name string, annotation string, extends string, visible array<string>, hidden array<string>, "
    "has array<string>, lacks array<string>, members_only boolean, conditions int, whole boolean, unresolved boolean"
)
_MEMBERS = "rule int, part int, member_kinds array<string>, member_name string, descriptor string, member_visible array<string>, member_hidden array<string>, member_has array<string>, member_lacks array<string>, member_annotation string"
#: Up to so many rules, which come from the driver, are sent to every task.
BROADCAST_RULES = 50_000


def _access(words: dict[str, bool]) -> list[list[str]]:
    """Visibilities and modifiers that are asked for and that are not allowed: visible, hidden, has, lacks."""
    of = lambda visible, want: [w.upper() for w, yes in words.items() if (w in VISIBILITIES) == visible and yes == want]
    return [of(True, True), of(True, False), of(False, True), of(False, False)]


def _rule_tables(spark, rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    heads, parts = [], []
    for i, r in enumerate(rules):
        kind = r.get("declaration", "class")
        named = DECLARATIONS[kind.lstrip("!")]
        kinds = [k for k in S.TYPE_KINDS if k not in named] if kind.startswith("!") else list(named)
        glob = r.get("class_pattern", "*")
        start = re.split(r"[*?]", glob)[0].replace(".", "/")
        pattern = lambda key, of=r: class_glob(of[key]) if of.get(key) else None
        pattern_of = lambda m: pattern("annotation", m)  # noqa: E731, B023
        members = r.get("members", [])
        package = "".join(x + "/" for x in start.split("/")[:-1][:2])  # what of the name is sure to be a package, two parts at most
        heads.append((i, r["path"], r["line"], kinds, package, start, class_glob(glob), pattern("annotation"), pattern("extends"), *_access(r.get("access", {})), bool(r.get("members_only")), len(members) if r.get("conditional") else 0, bool(r.get("shrinking_disabled")), bool(r.get("unresolved"))))
        for k, m in enumerate(members):
            parts.append((i, k, m.get("kind"), None if m["name"] == "*" else member_glob(m["name"]), m.get("descriptor"), *_access(m.get("access", {})), pattern_of(m)))
    return spark.createDataFrame(heads, _RULES), spark.createDataFrame(parts, _MEMBERS)


def _allowed(visible: str, hidden: str, has: str, lacks: str):
    """Whether a declaration (visible_as, modifiers) has the access that a rule asks for."""
    seen = (F.size(visible) == 0) | F.array_contains(visible, F.col("visible_as"))
    modifiers = F.coalesce("modifiers", F.array().cast("array<string>"))
    return seen & ~F.coalesce(F.array_contains(hidden, F.col("visible_as")), F.lit(False)) & (F.size(F.array_except(has, modifiers)) == 0) & (F.size(F.array_intersect(lacks, modifiers)) == 0)


def keep_rules(g: Graph, rules: list[dict], hierarchy: DataFrame | None = None, lenient: bool = False) -> DataFrame:
    """Evidence from parsed keep rules (``sources.keep_rules``): classes, and the members that they name.

    A rule applies to a class that matches in kind, name, access, annotation and supertypes and, if it has
    conditions, satisfies every one of them by some member.  Access is that of the byte code
    (``jvm_visibility``, where nodes have it).  Rules that could not be read (unresolved) and those that
    switch shrinking off apply to every node, each under its own reason.  Where a supertype that nothing
    knows leaves open whether a class extends what a rule asks for, that is an error, which lists all such
    rules; if ``lenient``, such a rule is unknown to every node.

    Rules are one table: classes meet those of their package (the first two parts of it that a rule's name
    fixes, or fewer), and members meet the rules of their class.
    """
    spark = g.nodes.sparkSession
    if not rules:
        return spark.createDataFrame([], S.RETENTION)
    heads, parts = _rule_tables(spark, rules)
    seen_as = "jvm_visibility" if "jvm_visibility" in g.nodes.columns else "visibility"
    nodes = g.nodes.withColumn("visible_as", F.col(seen_as))
    near = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df
    types = nodes.filter(F.col("kind").isin(*S.TYPE_KINDS) & F.col("id").startswith("class:")).select("id", "kind", "visible_as", "modifiers", "annotations", F.expr("substr(id, 7)").alias("internal"))
    packages = F.array(F.lit(""), *(F.when(F.size(F.split("internal", "/")) > k, F.concat(F.substring_index("internal", "/", k), F.lit("/"))) for k in (1, 2)))
    types = types.withColumn("package", F.explode(F.array_compact(packages)))
    own = heads.filter("NOT whole AND NOT unresolved")
    fits = F.array_contains("kinds", F.col("kind")) & F.col("internal").startswith(F.col("start")) & F.expr("internal RLIKE name") & _allowed("visible", "hidden", "has", "lacks")
    fits = fits & (F.col("annotation").isNull() | F.exists("annotations", lambda a: F.rlike(a, F.col("annotation"))))
    hit = types.join(near(own), "package").filter(fits).select("rule", "path", "line", "id", "extends", "members_only", "conditions")
    unknown = None
    if any(r.get("extends") for r in rules):
        hit = settled(hit)
        up = settled(supertypes(g, hierarchy).select(F.col("source").alias("id"), F.expr("substr(target, 7)").alias("up")))
        extending = hit.filter("extends IS NOT NULL").join(up, "id").filter(F.expr("up RLIKE extends")).select("rule", "id").distinct()
        known = g.nodes.select(F.expr("substr(id, 7)").alias("up")) if hierarchy is None else g.nodes.select(F.expr("substr(id, 7)").alias("up")).union(hierarchy.select("name"))
        open_ = up.join(known, "up", "left_anti").filter("up <> 'java/lang/Object'").select("id").distinct()
        unknown = settled(hit.filter("extends IS NOT NULL").join(extending, ["rule", "id"], "left_anti").join(open_, "id", "left_semi").select("rule", "path", "line").distinct())
        if not lenient and not unknown.isEmpty():
            where = ", ".join(f"{r.path}:{r.line}" for r in unknown.orderBy("path", "line").collect())
            raise ValueError(f"supertypes are not known far enough for the rules at {where}")
        hit = hit.join(extending.withColumn("found", F.lit(True)), ["rule", "id"], "left").filter("extends IS NULL OR found").drop("found")
    part = members(g).withColumnRenamed("source", "owner").join(nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), F.col("name").alias("target_name"), "visible_as", "modifiers", F.col("annotations").alias("target_annotations")), "target")
    asked = hit.select("rule", F.col("id").alias("owner")).join(near(parts), "rule")
    fits = (F.col("member_kinds").isNull() | F.array_contains("member_kinds", F.col("target_kind"))) & (F.col("member_name").isNull() | F.expr("target_name RLIKE member_name"))
    fits = fits & (F.col("descriptor").isNull() | F.col("target").endswith(F.col("descriptor"))) & _allowed("member_visible", "member_hidden", "member_has", "member_lacks")
    fits = fits & (F.col("member_annotation").isNull() | F.exists(F.coalesce("target_annotations", F.array().cast("array<string>")), lambda a: F.rlike(a, F.col("member_annotation"))))
    named = settled(asked.join(part, "owner").filter(fits).select("rule", "owner", "part", "target"))
    met = named.groupBy("rule", F.col("owner").alias("id")).agg(F.count_distinct("part").alias("met"))
    hit = hit.join(met, ["rule", "id"], "left").filter(F.coalesce("met", F.lit(0)) >= F.col("conditions"))
    kept = hit.filter("NOT members_only").select("id", "path", "line")
    kept = kept.unionByName(named.join(hit.select("rule", F.col("id").alias("owner"), "path", "line"), ["rule", "owner"]).select(F.col("target").alias("id"), "path", "line"))
    out = _evidence(kept, F.lit("KEEP_RULE"))
    every = heads.filter("whole OR unresolved").select("path", "line", F.when(F.col("whole"), "SHRINKING_DISABLED").otherwise("UNKNOWN_KEEP_RULE").alias("reason"))
    if unknown is not None:
        every = every.unionByName(unknown.select("path", "line", F.lit("UNKNOWN_KEEP_RULE").alias("reason")))
    # rules that hold for every node, of which people write few
    return out.unionByName(g.nodes.select(F.col("id").alias("node_id")).join(F.broadcast(every), F.lit(True)).select(*COLUMNS)).distinct()


def unmatched_rules(rules: list[dict], evidence: DataFrame) -> DataFrame:
    """path, line of rules that no evidence comes from."""
    spark = evidence.sparkSession
    table = spark.createDataFrame([(r["path"], r["line"]) for r in rules], "path string, line int")
    return table.join(evidence.filter(F.col("reason").isin("KEEP_RULE", "SHRINKING_DISABLED", "UNKNOWN_KEEP_RULE")).select("path", "line"), ["path", "line"], "left_anti").distinct()


def default_evidence(g: Graph, given: DataFrame, providers: DataFrame | None = None, rules: list[dict] | None = None, hierarchy: DataFrame | None = None, private_members: bool = False) -> DataFrame:
    """All evidence, in the order in which one kind builds on another."""
    parts = [given.select(*COLUMNS), keep_annotation(g), framework(g), generated_siblings(g), android_entries(g, hierarchy), inline_constants(g)]
    parts += [services(g, providers)] if providers is not None else []
    parts += [keep_rules(g, rules, hierarchy)] if rules else []
    out = runtime_expanded(g, bridge_owners(g, settled(reduce(DataFrame.unionByName, parts).distinct())))
    return private_expanded(g, out) if private_members else out
