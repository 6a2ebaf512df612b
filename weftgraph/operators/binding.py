"""What data binding may call: the declarations behind adapters that nothing proves to be used, within a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, sort_key
from weftgraph.iterate import Levels, numbered, settled

NODE_BUDGET, EDGE_BUDGET = 20_000, 200_000


@dataclass(frozen=True)
class Uncertainty:
    """``steps`` (id, adapter, caller, rank): reached by calls from an adapter, in the order found; ``owners``
    (id, member): classes of these; how many edges were looked at, and whether the budget ended the search."""

    steps: DataFrame
    owners: DataFrame
    examined: int
    truncated: bool

    def requires_review(self, ids: DataFrame) -> DataFrame:
        """``ids`` (id) whose use is in doubt: all of them, if the search did not end by itself."""
        if self.truncated:
            return ids.select("id")
        return ids.select("id").join(self.steps.select("id").union(self.owners.select("id")).distinct(), "id", "left_semi")


def uncertainty(g: Graph, adapters: DataFrame, node_budget: int = NODE_BUDGET, edge_budget: int = EDGE_BUDGET) -> Uncertainty:
    """A search from ``adapters`` (id) along calls of byte code; classes that have a reached member are noted,
    but not entered.

    Adapters come in order of ids, the rest as a queue takes it: all edges into a node, then all edges out of
    it, each in the order of edges.  Each edge looked at counts for ``edge_budget``, each node found or noted
    for ``node_budget``; the search ends right before either is exceeded.  A round takes a level of the queue
    at once: its edges in order are events, the first event of a node is when it is found, and only the level
    that a budget ends in is cut, by the number of the event.
    """
    if not (1 <= node_budget <= 1_000_000 and 1 <= edge_budget <= 10_000_000):
        raise ValueError("budgets are 1 to 1000000 nodes and 1 to 10000000 edges")
    out = settled(g.edges.withColumn("call", (F.col("kind") == "CALL") & (F.col("origin") == "BYTECODE")).select("source", "target", "call", (F.col("kind") == "MEMBER").alias("member"), F.struct(*sort_key()).alias("edge")))
    seeds, n = numbered(adapters.select("id").distinct(), [F.col("id")], "rank")
    columns = ["id", "adapter", "caller", "rank"]
    front = settled(seeds.filter(F.col("rank") <= node_budget).select("id", F.col("id").alias("adapter"), F.lit(None).cast("string").alias("caller"), "rank"))
    truncated, examined, found, last = n > node_budget, 0, min(n, node_budget), min(n, node_budget)
    steps, owners = Levels(front), None
    none = settled(front.limit(0).select("id", F.col("id").alias("member")))
    while not truncated and not front.isEmpty():
        at = front.select(F.col("id").alias("at"), "adapter", "rank")
        into = out.join(at, F.col("target") == F.col("at")).select("at", "adapter", F.when(F.col("member"), F.col("source")).alias("owner"), F.lit(None).cast("string").alias("callee"), F.struct("rank", F.lit(0).alias("out"), "edge").alias("event"))
        from_ = out.join(at, F.col("source") == F.col("at")).select("at", "adapter", F.lit(None).cast("string").alias("owner"), F.when(F.col("call"), F.col("target")).alias("callee"), F.struct("rank", F.lit(1).alias("out"), "edge").alias("event"))
        events = settled(into.unionByName(from_))
        seen, noted = steps.all.select("id"), none if owners is None else owners.all
        first = lambda c: events.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("id")).agg(F.min_by(F.struct("at", "adapter"), "event").alias("by"), F.min("event").alias("event"))
        new = settled(first("callee").join(seen, "id", "left_anti").withColumn("step", F.lit(True)))
        # a class found as a callee before is no owner; one found later is both
        later = new.select("id", F.col("event").alias("stepped"))
        held = first("owner").join(seen, "id", "left_anti").join(noted.select("id"), "id", "left_anti").join(later, "id", "left").filter("stepped IS NULL OR event < stepped").drop("stepped").withColumn("step", F.lit(False))
        added = settled(new.unionByName(held))
        size, more = events.count(), added.count()
        if examined + size > edge_budget or found + more > node_budget:
            truncated = True
            counted, _ = numbered(events.select("event"), [F.col("event")], "n")
            placed = settled(numbered(added.join(counted, "event"), [F.col("n")], "k")[0])
            may_look, may_find = edge_budget - examined, node_budget - found
            over = placed.filter(F.col("k") == may_find + 1).agg(F.min("n")).first()[0]  # the event that finds one too many
            examined += may_look if over is None or over > may_look else over
            added = settled(placed.filter((F.col("k") <= may_find) & (F.col("n") <= may_look)).drop("n", "k"))
            more = added.count()
        else:
            examined += size
        found += more
        owner = settled(added.filter("NOT step").select("id", F.col("by.at").alias("member")))
        if owners is None:
            owners = Levels(owner)
        else:
            owners.add(owner)
        front, n = numbered(added.filter("step").select("id", F.col("by.adapter").alias("adapter"), F.col("by.at").alias("caller"), "event"), [F.col("event")], "rank", last)
        front = settled(front.select(*columns))
        last += n
        if n:
            steps.add(front)
    return Uncertainty(steps.all, none if owners is None else owners.all, examined, truncated)
