"""Calls on repositories that a persistence framework implements, where facts on their use explain them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.operators.dispatch import unresolved_calls
from weftgraph.operators.retention import below, supertypes

# Interfaces of repositories, and the framework's own implementations.
REPOSITORIES = (
    "org/springframework/data/repository/Repository",
    "org/springframework/data/repository/CrudRepository",
    "org/springframework/data/repository/ListCrudRepository",
    "org/springframework/data/repository/PagingAndSortingRepository",
    "org/springframework/data/repository/ListPagingAndSortingRepository",
    "org/springframework/data/repository/query/QueryByExampleExecutor",
    "org/springframework/data/repository/query/ListQueryByExampleExecutor",
    "org/springframework/data/repository/history/RevisionRepository",
    "org/springframework/data/repository/kotlin/CoroutineCrudRepository",
    "org/springframework/data/repository/kotlin/CoroutineSortingRepository",
    "org/springframework/data/jpa/repository/JpaRepository",
    "org/springframework/data/jpa/repository/JpaSpecificationExecutor",
    "org/springframework/data/jpa/repository/support/JpaRepositoryImplementation",
    "org/springframework/data/querydsl/QuerydslPredicateExecutor",
    "org/springframework/data/querydsl/ListQuerydslPredicateExecutor",
)
IMPLEMENTATIONS = (
    "org/springframework/data/jpa/repository/support/SimpleJpaRepository",
    "org/springframework/data/repository/core/support/RepositoryFactorySupport",
)

CALL_SITES = "caller string, line int, relation string"
DECLARATIONS = "path string, relation string"


def persistence_modeled(g: Graph, sites: DataFrame, declarations: DataFrame, bases: tuple[str, ...] = REPOSITORIES, implementations: tuple[str, ...] = IMPLEMENTATIONS) -> DataFrame:
    """The unresolved external calls that go to the framework's code: virtual calls on a project interface that
    extends one of ``bases``, at a line for which ``sites`` (caller, line, relation) have a relation that the
    interface's file declares (``declarations``: path, relation).

    A call without a line has that of its caller.  A method that another project type above the interface
    declares under the same name may have an implementation of its own, and stays unresolved.  So does
    everything if the project has an implementation of a repository, which could be any of them.
    """
    under = below(g, bases).join(g.nodes.filter(F.col("kind").isin(*S.TYPE_KINDS)).select("id", "kind", "path"), "id")
    own = under.filter("kind <> 'INTERFACE'").select("id").unionByName(below(g, implementations).join(g.nodes.filter(F.col("kind").isin(*S.TYPE_KINDS) & (F.col("kind") != "INTERFACE")).select("id"), "id", "left_semi"))
    unix = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    owners = under.filter("kind = 'INTERFACE' AND path IS NOT NULL").select(F.col("id").alias("owner_id"), unix("path").alias("path")).join(declarations.select(unix("path").alias("path"), "relation"), "path")
    owners = owners.select("owner_id", "relation").distinct()
    calls = g.facts["external_calls"].filter(F.col("kind").isin("VIRTUAL", "INTERFACE") & F.col("model").isNull() & (F.col("resolution") == "UNRESOLVED"))
    calls = calls.withColumn("owner_id", F.concat(F.lit("class:"), "owner")).join(g.nodes.select(F.col("id").alias("caller"), F.col("line").alias("declared_at")), "caller").withColumn("at", F.coalesce("line", "declared_at"))
    names = g.nodes.filter(F.col("id").startswith("method:")).select(S.owner_class(F.col("id")).alias("target"), F.regexp_extract("id", r"#([^(]*)", 1).alias("name")).distinct()
    # the types above the called interfaces only
    up = supertypes(g).join(owners.select(F.col("owner_id").alias("source")).distinct(), "source", "left_semi")
    hidden = up.join(names, "target").select(F.col("source").alias("owner_id"), "name").distinct()
    explained = calls.join(owners, "owner_id").join(sites.select("caller", F.col("line").alias("at"), "relation").distinct(), ["caller", "at", "relation"], "left_semi")
    explained = explained.join(hidden, ["owner_id", "name"], "left_anti").select("caller", "ordinal").distinct()
    # one row at most says that there is an implementation
    some = own.limit(1).select(F.lit(True).alias("own"))
    return g.facts["external_calls"].join(explained, ["caller", "ordinal"], "left_semi").join(F.broadcast(some), F.lit(True), "left_anti")


def unresolved_without(g: Graph, modeled: DataFrame) -> DataFrame:
    """caller, n of unresolved calls that ``modeled`` does not explain."""
    return unresolved_calls(g.facts["external_calls"].join(modeled.select("caller", "ordinal"), ["caller", "ordinal"], "left_anti"))
