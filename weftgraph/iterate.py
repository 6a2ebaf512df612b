"""Fixed points over edges: closure, ranked breadth-first search, strong components.

Each round's result is a table in ``spark.checkpoint.dir``, so plans stay short, know the sizes of what they
join, and a lost executor costs a reread.  Edges are written once, before the first round.  What was found
before is kept level by level: a round adds to it and rewrites none of it, but for every tenth, which
makes one table of all levels.  Only counts come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.shared import removed
from weftgraph.shared import written as settled

#: Levels that are joined one by one before they become one table.
LEVELS = 10


class Levels:
    """What rounds have found so far."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    @property
    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, found: DataFrame) -> None:
        self.parts.append(found)
        if len(self.parts) > LEVELS:
            # the last is the front of the next round and stays
            old, self.parts = self.parts[:-1], [settled(reduce(DataFrame.unionByName, self.parts[:-1])), found]
            for x in old:
                removed(x)


def plain(edges: DataFrame) -> DataFrame:
    """source, target, once each, as a table."""
    return settled(edges.select("source", "target").distinct())


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, depth of everything that ``seeds`` (id) reach over ``edges`` (source, target)."""
    e = plain(edges)
    front = settled(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    seen, depth = Levels(front), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = e.join(front.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        front = settled(new.join(seen.all.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen.add(front)
    removed(e)
    return seen.all


def numbered(df: DataFrame, order: list[Column], name: str, after: int = 0) -> tuple[DataFrame, int]:
    """``df`` with the place of each row in ``order`` (from ``after`` + 1), and how many rows there are.

    Rows are sorted by range over the cluster; a part's places start where the rows of the parts before it
    end, of which only counts come to the driver.
    """
    rows = settled(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    base, start = after, []
    for p, n in counts:
        start += [F.lit(p).cast("long"), F.lit(base).cast("long")]
        base += n
    first = F.element_at(F.create_map(*start), part) if start else F.lit(after).cast("long")
    return rows.withColumn(name, first + within + 1).drop("_at"), base - after


def ranked_bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, visit_limit: int | None = None, marks: list[int] | None = None) -> DataFrame:
    """id, depth, rank, pred: breadth-first search in queue order.

    ``seeds`` (id, ord) enter by ord; a vertex is found by the first of its predecessors to be taken from
    the queue, and enters by (that predecessor's rank, id).  At most ``visit_limit`` vertices are visited,
    cut in that order.  With ``marks``, edges have a ``step``, the least of parallel ones counts, and vertices
    have ``marked``: whether a step on the way to them is one of ``marks``.
    """
    way = [] if marks is None else ["step"]
    e = plain(edges) if marks is None else settled(edges.groupBy("source", "target").agg(F.min("step").alias("step")))
    first = seeds.groupBy("id").agg(F.min("ord").alias("ord"))
    front, n = numbered(first.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("pred"), "ord", *([F.lit(False).alias("marked")] * len(way))), [F.col("ord"), F.col("id")], "rank")
    within = lambda df: df if visit_limit is None else df.filter(F.col("rank") <= visit_limit)
    columns = ("id", "depth", "rank", "pred", *(["marked"] * len(way)))
    front = within(front).select(*columns)
    seen, depth = Levels(front), 0
    while n and (max_depth is None or depth < max_depth) and (visit_limit is None or n < visit_limit):
        depth += 1
        of = front.select(F.col("id").alias("source"), F.col("rank").alias("r"), *(["marked"] * len(way)))
        hit = e.join(of, "source").groupBy(F.col("target").alias("id")).agg(F.min(F.struct("r", "source", *way, *(["marked"] * len(way)))).alias("p"))
        marked = [(F.col("p.marked") | F.col("p.step").isin(marks)).alias("marked")] if way else []
        new = hit.join(seen.all.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("p.source").alias("pred"), F.col("p.r").alias("r"), *marked)
        front, size = numbered(new, [F.col("r"), F.col("id")], "rank", n)
        if not size:
            break
        front, n = within(front).select(*columns), n + size
        seen.add(front)
    removed(e)
    return seen.all


def paths(found: DataFrame, ends: DataFrame) -> DataFrame:
    """id, path (from a seed to id) of ``ends`` (id), by walking the predecessors of ``ranked_bfs``."""
    step = found.select(F.col("id").alias("at"), "pred")
    out = settled(ends.select("id").distinct().join(found.select("id"), "id", "left_semi").select("id", F.col("id").alias("at"), F.array("id").alias("path")))
    while True:
        out = settled(out.join(step, "at", "left").select("id", F.col("pred").alias("at"), F.when(F.col("pred").isNotNull(), F.concat(F.array("pred"), "path")).otherwise(F.col("path")).alias("path")))
        if out.filter("at IS NOT NULL").isEmpty():
            return out.select("id", "path")


def closure(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """source, target, depth: the least number of steps of each pair that a path joins."""
    e = plain(edges)
    front = e if starts is None else e.join(starts.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    front = settled(front.withColumn("depth", F.lit(1)))
    seen, depth = Levels(front), 1
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.select("source", F.col("target").alias("mid")).join(e.select(F.col("source").alias("mid"), "target"), "mid").select("source", "target").distinct()
        front = settled(new.join(seen.all.select("source", "target"), ["source", "target"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen.add(front)
    return seen.all


#: Steps of trimming and of colouring that one job does.
STEPS = 3


def _trimmed(e: DataFrame) -> DataFrame:
    """Without the edges out of vertices that nothing enters, and into those that nothing leaves."""
    out = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
    return out.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) of the vertices that lie on cycles.

    Vertices without a way in or out are trimmed away first.  Then rounds of colouring: the greatest id
    that reaches a vertex is its colour; what can reach the colour's own vertex within the colour is one
    component and leaves.  Linear in the edges per step; no pairs of vertices are made.  A job does ``STEPS``
    steps, and tables go once the next one is written.
    """
    e, done = plain(edges), None
    n = e.count()
    while n:
        while True:  # trim
            old, before = e, n
            for _ in range(STEPS):
                e = _trimmed(e)
            e = settled(e)
            removed(old)
            n = e.count()
            if n == before:
                break
        if not n:
            break
        colour = settled(e.select(F.col("source").alias("id")).union(e.select("target")).distinct().withColumn("c", F.col("id")))
        while True:  # the greatest colour flows forward
            old, now = colour, colour
            for _ in range(STEPS):
                came = e.join(now.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("c").alias("m"))
                now = now.join(came, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"))
            new = settled(now.join(old.withColumnRenamed("c", "was"), "id").select("id", "c", (F.col("c") > F.col("was")).alias("grew")))
            removed(old)
            colour = new.select("id", "c")
            if new.filter("grew").isEmpty():
                break
        inner = settled(e.join(colour.select(F.col("id").alias("source"), F.col("c").alias("cs")), "source").join(colour.select(F.col("id").alias("target"), F.col("c").alias("ct")), "target").filter("cs = ct").select("source", "target"))
        back = bfs(inner.select(F.col("target").alias("source"), F.col("source").alias("target")), colour.filter("id = c").select("id"))
        found = back.select("id").join(colour, "id")
        loops = inner.filter("source = target").select(F.col("source").alias("id"))
        size = found.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("component"))
        found = settled(found.join(size, "c").join(loops.withColumn("self", F.lit(True)), "id", "left").filter("n > 1 OR self").select("id", "component"))
        done = found if done is None else settled(done.unionByName(found))
        gone = settled(back.select("id"))
        old = e
        e = settled(e.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti"))
        for x in (old, inner, gone, colour):
            removed(x)
        n = e.count()
    return done if done is not None else e.select(F.col("source").alias("id"), F.col("target").alias("component"))
