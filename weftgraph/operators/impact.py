"""What a change can affect: reverse reachability with witnesses, over one or two revisions."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import bfs, paths, ranked_bfs, settled

STRUCTURAL = ("INHERITANCE", "OVERRIDE", "ANNOTATION")


def seeds(revisions: dict[str, Graph], symbols: list[str], files: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id of changed nodes, requested and status of each symbol); a symbol is one node over all revisions.

    A file is its exact path, else its base name.
    """
    spark = next(iter(revisions.values())).nodes.sparkSession
    nodes = reduce(DataFrame.unionByName, (g.nodes.select("id", "name", "module", "path") for g in revisions.values())).distinct()
    asked = spark.createDataFrame([(s,) for s in symbols], "requested string")
    q = S.qualified_name(F.col("id"), F.col("name"))
    hit = nodes.withColumn("names", F.array("id", "name", q, F.concat_ws(".", "module", q))).select("id", F.explode(F.array_distinct("names")).alias("requested")).join(F.broadcast(asked), "requested").distinct()
    status = asked.join(hit.groupBy("requested").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")), "requested", "left").select("requested", F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("notFound").alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))
    wanted = spark.createDataFrame([(f, f.rsplit("/", 1)[-1]) for f in files], "file string, base string")
    exact = nodes.join(F.broadcast(wanted), F.col("path") == F.col("file")).select("id", "file")
    rest = wanted.join(exact.select("file").distinct(), "file", "left_anti").filter("file = base")
    by_name = nodes.join(rest, F.substring_index("path", "/", -1) == F.col("base")).select("id")
    return status.filter("id IS NOT NULL").select("id").unionByName(exact.select("id")).unionByName(by_name).distinct(), status.select("requested", "status")


def contracts(g: Graph, changed: DataFrame) -> DataFrame:
    """Everything that overrides a changed declaration, at any remove; the changed ones, too."""
    e = g.edges.filter(S.is_override_contract(F.col("kind"), F.col("origin"))).select("source", "target")
    return bfs(e, changed.select("id").join(g.nodes.select("id"), "id", "left_semi"))


def _reverse_edges(g: Graph, changed: DataFrame) -> DataFrame:
    e = g.edges.filter(S.is_usage(F.col("kind")) & ~S.is_owner_reference(F.col("source"), F.col("target"), F.col("kind")))
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), "kind")
    out = g.edges.filter(S.is_override_contract(F.col("kind"), F.col("origin"))).join(contracts(g, changed).select(F.col("id").alias("source")), "source", "left_semi")
    return back.unionByName(out.select("source", "target", "kind"))


def reverse_edges(g: Graph, changed: DataFrame) -> DataFrame:
    """source, target, kind: from a node to what depends on it; overrides of contracts forward, too."""
    return _reverse_edges(g, changed).distinct()


def _start(g: Graph, changed: DataFrame) -> DataFrame:
    return changed.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi").select("id", F.col("id").alias("ord"))


def affected(g: Graph, changed: DataFrame, max_depth: int = 100, visit_limit: int | None = 100_000) -> DataFrame:
    """id, depth, rank, pred of what a change of ``changed`` (id) can reach, itself at depth 0."""
    return ranked_bfs(_reverse_edges(g, changed), _start(g, changed), max_depth, visit_limit)


def related(g: Graph, changed: DataFrame, max_depth: int = 100, visit_limit: int | None = 100_000) -> DataFrame:
    """``affected`` with ``structural``: whether the kinds that ``witnesses`` gives have a structural one.  The
    search takes that along, where the witnesses themselves are not asked for."""
    marks = [i + 1 for i, k in enumerate(S.EDGE_KINDS) if k in STRUCTURAL]
    step = S.ordinal(F.col("kind")).cast("int").alias("step")
    return ranked_bfs(_reverse_edges(g, changed).select("source", "target", step), _start(g, changed), max_depth, visit_limit, marks).withColumnRenamed("marked", "structural")


def affected_ids(g: Graph, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, depth of what a change can reach, where neither order nor witnesses are asked for."""
    return bfs(reverse_edges(g, changed), changed.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi"), max_depth)


def witnesses(g: Graph, changed: DataFrame, found: DataFrame) -> DataFrame:
    """id, path (from a changed node), kinds of its steps, for everything that is affected."""
    walk = settled(paths(found, found.filter("depth > 0").select("id")))
    steps = walk.select("id", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))).alias("i", "s")).select("id", "i", F.col("s.a").alias("source"), F.col("s.b").alias("target"))
    kind = reverse_edges(g, changed).groupBy("source", "target").agg(F.min_by("kind", S.ordinal(F.col("kind"))).alias("kind"))
    kinds = steps.join(kind, ["source", "target"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]).alias("kinds"))
    return walk.join(kinds, "id").select("id", "path", "kinds")


def relation(kinds):
    """UNKNOWN without steps, STRUCTURAL by the kinds on the way, else DIRECT or TRANSITIVE."""
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) <= 0, "UNKNOWN").when(F.exists(kinds, lambda k: k.isin(*STRUCTURAL)), "STRUCTURAL").when(F.size(kinds) == 1, "DIRECT").otherwise("TRANSITIVE")


# Source sets that hold tests, and those that hold what is shipped.
TEST_SETS = ("test", "androidTest", "testFixtures", "integrationTest")
PRODUCTION_SETS = ("main", "production", "prod", "debug", "release")


def test_status(path):
    """TEST, PRODUCTION or UNKNOWN by the source set (the folder below the first src) or a test folder at the
    top; not the rule of ``is_test_path``."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    source_set = F.nullif(F.regexp_extract(unix, r"^(?:(?!src/)[^/]*/)*?src/([^/]+)", 1), F.lit(""))
    names = {True: TEST_SETS, False: PRODUCTION_SETS}
    top = unix.rlike("^tests?(/|$)")
    return F.when(top | source_set.isin(*names[True]), "TEST").when(source_set.isin(*names[False]), "PRODUCTION").otherwise("UNKNOWN")


def is_test_path(path):
    """Below a test source set, and below no production one."""
    p = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    roots = ("java", "kotlin", "groovy", "scala", "resources", "res", "assets", "aidl", "cpp")
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b"), F.get(p, i + 2).alias("c"))), lambda x: (x["a"] == "src") & x["b"].isNotNull())
    test = lambda n: (n == "test") | n.endswith("Test") | n.rlike("^(test|androidTest)[A-Z].*")
    production = F.exists(pairs, lambda x: ~test(x["b"]) & ((x["b"] == "main") | F.coalesce(x["c"].isin(*roots), F.lit(False))))
    return F.exists(pairs, lambda x: test(x["b"])) & ~production


def impact(revisions: dict[str, Graph], changed: DataFrame, path_limit: int | None = None, **limits) -> DataFrame:
    """id, depth, relation, path_status, test_status, module, file of what is affected in any revision.

    A path is the shortest over revisions; path_status tells whether each revision that has the node
    affected has a path.  All revisions share ``path_limit`` edges of paths: in the order of revisions and
    ids, a path that no longer fits is left out (``budgeted``).
    """
    rows = []
    for i, g in enumerate(revisions.values()):
        found = related(g, changed, **limits).filter("depth > 0")
        rows.append(found.join(g.nodes.select("id", "module", F.col("path").alias("file")), "id").select("id", F.lit(i).alias("nth"), "depth", "structural", "module", "file"))
    every = reduce(DataFrame.unionByName, rows)
    every = every.join(changed.select("id"), "id", "left_anti")
    every = budgeted(every.withColumn("steps", F.col("depth")), path_limit, ("nth", "id"))
    out = every.groupBy("id").agg(F.min("depth").alias("depth"), F.bool_or("structural").alias("structural"), F.count("*").alias("n"), F.count_if("shown").alias("with_path"), F.collect_set(test_status(F.col("file"))).alias("statuses"), F.min("module").alias("module"), F.min("file").alias("file"))
    rel = F.when(F.col("structural"), "STRUCTURAL").when(F.col("depth") == 1, "DIRECT").otherwise("TRANSITIVE")
    path_status = F.when(F.col("with_path") == F.col("n"), "COMPLETE").when(F.col("with_path") == 0, "UNAVAILABLE").otherwise("PARTIAL")
    return out.select("id", "depth", rel.alias("relation"), path_status.alias("path_status"), F.when(F.size("statuses") == 1, F.get("statuses", F.lit(0))).otherwise("UNKNOWN").alias("test_status"), "module", "file")


def filtered(items: DataFrame, modules=(), files=(), kinds=(), relation=None, path_status=None, test_status=None) -> DataFrame:
    for column, values in (("module", modules), ("file", files), ("kind", kinds)):
        if values:
            items = items.filter(F.col(column).isin(*values))
    for column, value in (("relation", relation), ("path_status", path_status), ("test_status", test_status)):
        if value is not None:
            items = items.filter(F.col(column) == value)
    return items


def summary(items: DataFrame) -> DataFrame:
    """dimension, value, n: counts by module, file, test status, relation and path status in one pass."""
    dims = ("module", "file", "test_status", "relation", "path_status")
    cells = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims)))
    return items.select(cells.alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


#: Orders of a list of affected nodes; nulls come last and ids break ties.
SORTS = {
    "USR": [], "MODULE": ["module"], "FILE": ["file"], "TEST_STATUS": ["test_status"], "RELATION": ["relation"], "PATH_STATUS": ["path_status"], "PATH_DEPTH": ["depth"],
    "REVIEW": ["review", "depth"],
}


def sorted_page(items: DataFrame, sort: str = "USR", limit: int = 500, offset: int = 0) -> DataFrame:
    review = F.array_position(F.array(*map(F.lit, ("DIRECT", "TRANSITIVE", "STRUCTURAL", "UNKNOWN"))), F.col("relation"))
    return items.withColumn("review", review).orderBy(*(F.asc_nulls_last(c) for c in SORTS[sort]), "id").offset(offset).limit(limit).drop("review")


def budgeted(items: DataFrame, budget: int | None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """``items`` with ``shown``: whether its ``steps`` still fit what the items before it in ``order`` have left
    of ``budget``; one that does not fit is skipped and takes nothing.

    Items are sorted in ranges over the cluster, of which the driver gets how many there are of each number
    of steps.  While the items of a range that are no longer than what is left fit in all, they are all
    shown.  The ranges in which one of these is refused are folded row by row; that one is longer than what
    is left then, so there are no more such ranges than numbers of steps.
    """
    if budget is None:
        return items.withColumn("shown", F.lit(True))
    rows = settled(items.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    ranges: dict[int, dict[int, int]] = {}
    for r in rows.groupBy(part.alias("part"), "steps").agg(F.count("*").alias("n")).collect():
        ranges.setdefault(r.part, {})[r.steps] = r.n
    left, bounds, folded = budget, [], None
    for p in sorted(ranges):
        fits = {c: n for c, n in ranges[p].items() if c <= left}
        takes = sum(c * n for c, n in fits.items())
        if takes <= left:
            bounds.append((p, left))
            left -= takes
            continue

        def fold(batches, left=left):
            for b in batches:
                shown = []
                for at, n in zip(b.column("_at").to_pylist(), b.column("steps").to_pylist(), strict=True):
                    if n <= left:
                        shown.append((at, n))
                        left -= n
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in shown], pa.int64()) for k in (0, 1)], names=["_at", "took"])

        # one range: what a task of the sort had
        some = settled(rows.filter((part == p) & (F.col("steps") <= left)).select("_at", F.col("steps").cast("long").alias("steps")).repartition(1).sortWithinPartitions("_at").mapInArrow(fold, "_at long, took long"))
        bounds.append((p, -1))
        left -= some.agg(F.sum("took")).first()[0] or 0
        folded = some if folded is None else folded.unionByName(some)
    limits = rows.sparkSession.createDataFrame(bounds or [(0, 0)], "_part long, _most long")  # a row a range
    out = rows.withColumn("_part", part).join(F.broadcast(limits), "_part")
    if folded is None:
        return out.withColumn("shown", F.col("steps") <= F.col("_most")).drop("_at", "_part", "_most")
    out = out.join(folded, "_at", "left").withColumn("shown", F.when(F.col("_most") < 0, F.col("took").isNotNull()).otherwise(F.col("steps") <= F.col("_most")))
    return out.drop("_at", "_part", "_most", "took")


def include_closure(includes: DataFrame, changed: DataFrame, limit: int = 10_000) -> DataFrame:
    """Layouts that include a changed one, at any remove, over literal includes; refused, not cut, above ``limit``."""
    e = includes.filter("literal").select(F.col("included").alias("source"), F.col("layout").alias("target"))
    found = bfs(e, changed)
    n = found.count()
    if n > limit:
        raise ValueError(f"{n} layouts are above the limit of {limit}")
    return found


def source_edit_impact(uses: DataFrame, changed: DataFrame) -> DataFrame:
    """Source uses of changed declarations by others."""
    ids = changed.select("id")
    return uses.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")


def source_use_query(uses: DataFrame, g: Graph, subject: str) -> DataFrame:
    """Uses that touch ``subject``: direction, and whether a byte-code call is there, too."""
    calls = g.edges.filter("kind = 'CALL' AND origin = 'BYTECODE'").select("source", "target", F.lit(True).alias("c"))
    hit = uses.filter((F.col("source") == subject) | (F.col("target") == subject)).join(calls, ["source", "target"], "left")
    return hit.withColumn("direction", F.when(F.col("target") == subject, "incoming").otherwise("outgoing")).withColumn("matching_bytecode_call", F.coalesce("c", F.lit(False))).drop("c")


def enum_expansion(base: DataFrame, current: DataFrame, sites: DataFrame) -> DataFrame:
    """Decision sites (id, enum_id, constants, resolved) that lack constants which the enum has gained.

    An inventory that is null is unknown, so it gains nothing.
    """
    inv = lambda df, c: df.filter("kind = 'ENUM'").select("id", F.col("enum_constants").alias(c))
    gained = inv(base, "old").join(inv(current, "new"), "id", "full_outer").select(F.col("id").alias("enum_id"), F.array_sort(F.array_except("new", "old")).alias("added")).filter(F.size("added") > 0)
    miss = F.array_except("added", F.coalesce("constants", F.array().cast("array<string>")))
    return sites.join(gained, "enum_id").select("id", "enum_id", miss.alias("missing"), F.when(F.col("resolved"), "resolved").otherwise("unresolved").alias("attribution")).filter((F.size("missing") > 0) | (F.col("attribution") == "unresolved"))
