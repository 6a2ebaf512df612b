"""Questions about one symbol: what it is, its neighbours, whether and why it is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.iterate import paths, ranked_bfs, settled
from weftgraph.operators.reach import reach_paths, usage


def symbol_match(g: Graph, requested: str) -> DataFrame:
    """Nodes whose id, name or qualified name (also after its module and a dot) is ``requested``."""
    q = S.qualified_name(F.col("id"), F.col("name"))
    return g.nodes.withColumn("qualified_name", q).filter((F.col("id") == requested) | (F.col("name") == requested) | (q == requested) | (F.concat_ws(".", "module", q) == requested))


def symbol_status(matches: DataFrame) -> DataFrame:
    """status (found, ambiguous, notFound) and n."""
    return matches.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, "notFound").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("status"), "n")


def neighbors(g: Graph, subject: str, depth: int = 1, limit: int | None = 50, incoming: bool = True) -> DataFrame:
    """id, depth, rank, kinds (of the edges to the vertex that found it), truncated: the first ``limit`` of
    the breadth-first order; one more is looked for, to tell whether there are more.  Without a limit, all."""
    e = g.edges.filter(S.is_usage(F.col("kind")))
    way = e.select(F.col("target").alias("source"), F.col("source").alias("target")) if incoming else e.select("source", "target")
    seed = g.nodes.sparkSession.createDataFrame([(subject, 0)], "id string, ord int")
    found = ranked_bfs(way, seed, max_depth=depth, visit_limit=None if limit is None else limit + 2).filter("depth > 0")
    kinds = e.select(F.col("source" if incoming else "target").alias("id"), F.col("target" if incoming else "source").alias("pred"), "kind").groupBy("id", "pred").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    if limit is None:
        return found.join(kinds, ["id", "pred"]).select("id", "depth", (F.col("rank") - 1).alias("rank"), "kinds", F.lit(False).alias("truncated"))
    more = found.agg((F.count("*") > limit).alias("truncated"))
    return found.filter(F.col("rank") <= limit + 1).join(kinds, ["id", "pred"]).crossJoin(F.broadcast(more)).select("id", "depth", (F.col("rank") - 1).alias("rank"), "kinds", "truncated")


def call_references(g: Graph, subject: str) -> DataFrame:
    """source, path, line of byte-code calls of ``subject``."""
    e = g.edges.filter((F.col("target") == subject) & (F.col("kind") == "CALL") & (F.col("origin") == "BYTECODE"))
    return e.join(g.nodes.select(F.col("id").alias("source"), "path"), "source").filter(F.col("path") != "").select("source", "path", F.explode("lines").alias("line")).distinct()


def states(g: Graph, evidence: DataFrame, reached: DataFrame) -> DataFrame:
    """id, state, reason of each node: retained, retainedByMember or unknown by its first evidence that is
    not an unresolved keep rule, else reachable or unreachable."""
    order = F.struct((F.col("reason") == "UNKNOWN_KEEP_RULE").alias("u"), F.array_position(F.array(*map(F.lit, S.REASONS)), F.col("reason")).alias("o"), F.coalesce("path", F.lit("")).alias("p"), F.coalesce("line", F.lit(0)).alias("l"), "reason")
    first = evidence.groupBy(F.col("node_id").alias("id")).agg(F.min(order).alias("f")).select("id", F.col("f.reason").alias("reason"))
    out = g.nodes.select("id").join(first, "id", "left").join(reached.select("id", F.lit(True).alias("r")), "id", "left")
    state = F.when(F.col("reason") == "UNKNOWN_KEEP_RULE", "unknown").when(F.col("reason") == "KEEP_ANNOTATED_MEMBER", "retainedByMember").when(F.col("reason").isNotNull(), "retained").when(F.col("r"), "reachable").otherwise("unreachable")
    return out.select("id", state.alias("state"), "reason")


def why_states(g: Graph, evidence: DataFrame, reached: DataFrame) -> DataFrame:
    """Like ``states`` with another precedence: any unresolved keep rule makes it unknown."""
    order = F.struct(F.array_position(F.array(*map(F.lit, S.REASONS)), F.col("reason")).alias("o"), F.coalesce("path", F.lit("")).alias("p"), F.coalesce("line", F.lit(0)).alias("l"), "reason")
    first = evidence.groupBy(F.col("node_id").alias("id")).agg(F.min(order).alias("f"), F.bool_or(F.col("reason") == "UNKNOWN_KEEP_RULE").alias("u")).select("id", F.col("f.reason").alias("reason"), "u")
    out = g.nodes.select("id").join(first, "id", "left").join(reached.select("id", F.lit(True).alias("r")), "id", "left")
    state = F.when(F.col("u"), "unknown").when(F.col("reason") == "KEEP_ANNOTATED_MEMBER", "retainedByMember").when(F.col("reason").isNotNull(), "retained").when(F.col("r"), "reachable").otherwise("unreachable")
    return out.select("id", state.alias("state"), "reason")


def _camel(kind):
    """Names of kinds as documents show them."""
    words = F.split(F.lower(kind), "_")
    return F.concat(F.get(words, F.lit(0)), F.array_join(F.transform(F.slice(words, 2, 9), lambda w: F.initcap(w)), ""))


def _near(g: Graph, subject: str, depth: int, limit: int, incoming: bool, name: str) -> DataFrame:
    """One row: the neighbours (by rank) as an array ``name``, and whether there are more."""
    lines = call_references(g, subject).groupBy("source").agg(F.array_sort(F.collect_set("line")).alias("lines")) if incoming else None
    near = neighbors(g, subject, depth, limit, incoming).join(g.nodes.select("id", "name", "path"), "id")
    near = near.join(lines.withColumnRenamed("source", "id"), "id", "left") if incoming else near.withColumn("lines", F.lit(None).cast("array<int>"))
    item = F.struct("rank", "id", S.qualified_name(F.col("id"), F.col("name")).alias("qualified_name"), "depth", F.array_sort(F.array_distinct(F.transform("kinds", _camel))).alias("kinds"), "path", "lines")
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in ("id", "qualified_name", "depth", "kinds", "path", "lines"))))
    return near.agg(rows.alias(name), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias(f"{name}_truncated"))


def symbol_document(g: Graph, evidence: DataFrame, reached: DataFrame, requested: str, limitations: list[str] = (), depth: int = 1, limit: int = 50, suppressed: DataFrame | None = None) -> DataFrame:
    """One row, document: everything about one symbol as JSON, or that there is none, or the candidates.

    Neighbours (used_by with the lines of their calls, depends_on) and members are cut at ``limit``, and
    truncated says which were; the path from evidence is given for what is reached without evidence of
    its own.  ``suppressed`` (id) are findings that a baseline has.
    """
    spark, matches = g.nodes.sparkSession, settled(symbol_match(g, requested).select("id", "name", "kind", "module", "path", "line", "visibility", "qualified_name"))
    n = matches.count()
    head = [F.lit(requested).alias("requested"), F.lit("symbol").alias("level"), F.array(*map(F.lit, sorted(set(limitations)))).cast("array<string>").alias("limitations")]
    if n != 1:
        found = F.transform(F.array_sort(F.collect_list(F.struct("id", "qualified_name"))), lambda x: F.struct(x["qualified_name"].alias("qualified_name"), x["id"].alias("id")))
        return matches.agg(found.alias("candidates")).select(F.to_json(F.struct(F.lit("ambiguous" if n else "notFound").alias("status"), *head, "candidates")).alias("document"))
    subject = matches.first().id
    one = matches.select(F.struct(*matches.columns).alias("subject"))
    state = states(g, evidence, reached).filter(F.col("id") == subject).select("state", "reason")
    ends = spark.createDataFrame([(subject,)], "id string")
    path = reach_paths(g, evidence, ends).select(F.posexplode("path").alias("at", "id")).join(g.nodes.select("id", "name"), "id")
    path = path.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", S.qualified_name(F.col("id"), F.col("name")).alias("q")))), lambda x: x["q"]).alias("path"))
    part = g.edges.filter((F.col("kind") == "MEMBER") & (F.col("source") == subject)).select(F.col("target").alias("id")).join(g.nodes.select("id", "name"), "id")
    item = F.struct("id", S.qualified_name(F.col("id"), F.col("name")).alias("qualified_name"))
    part = part.orderBy("id").limit(limit + 1).agg(F.array_sort(F.collect_list(item)).alias("m")).select(F.slice("m", 1, limit).alias("members"), (F.size("m") > limit).alias("members_truncated"))
    owner = g.edges.filter((F.col("kind") == "MEMBER") & (F.col("target") == subject)).select(F.col("source").alias("id")).join(g.nodes.select("id", "name"), "id").agg(F.min(item).alias("owner"))
    known = suppressed.filter(F.col("id") == subject).agg((F.count("*") > 0).alias("known")) if suppressed is not None else spark.createDataFrame([(False,)], "known boolean")
    # one row each
    row = one
    for part_ in (state, path, _near(g, subject, depth, limit, True, "used_by"), _near(g, subject, depth, limit, False, "depends_on"), part, owner, known):
        row = row.crossJoin(F.broadcast(part_))
    reachability = F.struct("state", "reason", F.when(F.col("reason").isNull() & (F.size("path") > 0), F.col("path")).alias("path"), ((F.col("state") == "unreachable") & F.col("known")).alias("suppressed_by_baseline"))
    cut = F.struct(F.col("used_by_truncated").alias("used_by"), F.col("depends_on_truncated").alias("depends_on"), F.col("members_truncated").alias("members"))
    result = F.struct("subject", reachability.alias("reachability"), "used_by", "depends_on", "members", "owner", cut.alias("truncated"))
    return row.select(F.to_json(F.struct(F.lit("found").alias("status"), *head, result.alias("result"))).alias("document"))


def why(g: Graph, evidence: DataFrame, subject: str) -> DataFrame:
    """id, path from evidence to ``subject``."""
    ends = g.nodes.sparkSession.createDataFrame([(subject,)], "id string")
    return reach_paths(g, evidence, ends)


def why_document(g: Graph, evidence: DataFrame, reached: DataFrame, requested: str, limitations: list[str] = (), callers: int = 100) -> DataFrame:
    """ord, line: the answer to why ``requested`` is kept, as tab-separated lines.

    Status and candidates unless one node matches; else the subject, its state, its evidence, a path from
    evidence if it has none of its own, and its first ``callers`` by id with the kinds of their edges.
    """
    matches = settled(symbol_match(g, requested).select("id", "kind", "path", "line", "qualified_name"))
    n, spark = matches.count(), g.nodes.sparkSession
    line = lambda *parts: F.concat_ws("\t", *(F.coalesce(p, F.lit("")) if not isinstance(p, str) else F.lit(p) for p in parts)).alias("line")
    fixed = lambda rows: spark.createDataFrame(rows, "ord int, line string")
    if n != 1:
        out = fixed([(0, f"status\t{'ambiguous' if n else 'notFound'}"), (1, f"requested\t{requested}")])
        return out.unionByName(matches.select(F.lit(2).alias("ord"), line("candidate", F.col("qualified_name"), F.col("id"))))
    subject = matches.first().id
    where = F.when(F.col("path").isNotNull(), F.concat_ws(":", "path", F.col("line").cast("string"))).otherwise("-")
    out = matches.select(F.lit(0).alias("ord"), line("subject", F.col("id"), F.col("qualified_name"), _camel(F.col("kind")), where))
    state = settled(why_states(g, evidence, reached).filter(F.col("id") == subject))
    out = out.unionByName(state.select(F.lit(1).alias("ord"), line("state", F.col("state"))))
    own = evidence.filter(F.col("node_id") == subject)
    out = out.unionByName(own.select(F.lit(2).alias("ord"), line("reason", F.col("reason"), where)))
    if state.first().state == "reachable":
        walk = why(g, evidence, subject).select(F.posexplode("path").alias("at", "id")).join(g.nodes.select("id", "name"), "id")
        walk = walk.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", S.qualified_name(F.col("id"), F.col("name")).alias("q")))), lambda x: x["q"]).alias("path")).filter(F.size("path") > 0)
        out = out.unionByName(walk.select(F.lit(3).alias("ord"), line("path", F.array_join("path", " -> "))))
    used = settled(g.edges.filter(S.is_usage(F.col("kind")) & (F.col("target") == subject)).groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(_camel(F.col("kind")))), ",").alias("kinds")))
    many = used.count()
    shown = used.orderBy("id").limit(callers).join(g.nodes.select("id", "name"), "id")
    out = out.unionByName(fixed([(4, f"usedBy\t{many}")])).unionByName(shown.select(F.lit(5).alias("ord"), line("caller", S.qualified_name(F.col("id"), F.col("name")), F.col("kinds"))))
    tail = [(6, "callers-truncated\ttrue")] * (many > callers) + [(7, f"limitation\t{x}") for x in sorted(limitations)]
    return out.unionByName(fixed(tail))


def top_callers(g: Graph, n: int = 5) -> DataFrame:
    """target, rank, caller, weight: the first ``n`` callers of each target by id, a report of its own."""
    e = g.edges.filter("kind = 'CALL'").groupBy("target", "source").agg(F.sum("weight").alias("weight"))
    first = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    return e.withColumn("rank", first).filter(F.col("rank") <= n).select("target", "rank", F.col("source").alias("caller"), "weight")


def discover(g: Graph, requested: str) -> DataFrame:
    """Suggestions: exact matches, ``Owner.member`` suffixes, and ``package.function`` for file facades."""
    name = requested[: requested.rindex("(")] if requested.endswith(")") and requested.rfind("(") > 0 else requested
    nodes = g.nodes.withColumn("qualified_name", S.qualified_name(F.col("id"), F.col("name"))).withColumn("owner", S.owner_class(F.col("id")))
    facade = g.nodes.filter(F.array_contains("attributes", "FILE_FACADE")).select(F.col("id").alias("owner"), F.lit(True).alias("facade"))
    q = F.col("qualified_name")
    hit = (F.col("id") == requested) | (F.col("name") == requested) | (q == requested) | (F.concat_ws(".", "module", q) == requested)
    if "." in name:
        hit = hit | (q == name) | q.endswith("." + name)
    package = S.package_of(F.col("id"))
    top = F.coalesce("facade", F.lit(False)) & F.col("kind").isin("METHOD", "FUNCTION") & ~F.coalesce("synthesized", F.lit(False)) & F.contains("id", F.lit("#"))
    hit = hit | (top & (F.when(package == "<default>", F.col("name")).otherwise(F.concat_ws(".", package, "name")) == name))
    return nodes.join(facade, "owner", "left").filter(hit).select("id", "qualified_name", "path")


def in_file(g: Graph, requested: str) -> DataFrame:
    """Nodes of the file with exactly this path, else of files whose path ends with it or that end it."""
    n = g.nodes.filter("path IS NOT NULL")
    exact = n.filter(F.col("path") == requested).select("id", "path")
    like = n.filter(F.lit(requested).endswith(F.concat(F.lit("/"), "path")) | F.col("path").endswith("/" + requested)).select("id", "path")
    return exact.unionByName(like.join(F.broadcast(exact.limit(1).select(F.lit(1).alias("one"))), F.lit(True), "left_anti"))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def root_paths(g: Graph, seeds: DataFrame) -> DataFrame:
    """id, path of everything that ``seeds`` (id, ord) reach."""
    found = ranked_bfs(usage(g), seeds)
    return paths(found, found.select("id"))
