"""Declared dependencies against what the classes use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scopes that compiled references can judge.
TEST_SCOPES = ("testImplementation", "testCompileOnly")
ANALYZED_SCOPES = ("api", "implementation", "compileOnly", "compileOnlyApi", *TEST_SCOPES)


def module_key(coordinate):
    """``group:name`` of a coordinate of three parts or more; projects and files as they are."""
    parts = F.split(coordinate, ":")
    own = coordinate.startswith("project:") | coordinate.startswith("file:")
    return F.when(~own & (F.size(parts) >= 3), F.concat_ws(":", F.slice(parts, 1, 2))).otherwise(coordinate)


def unused(declared: DataFrame, artifact_classes: DataFrame, referenced: DataFrame, test_scopes: bool = True) -> DataFrame:
    """coordinate, scope, artifact, status (skipped, withoutClasses, used, unused) of each declaration."""
    judged = ANALYZED_SCOPES if test_scopes else [s for s in ANALYZED_SCOPES if s not in TEST_SCOPES]
    use = artifact_classes.join(referenced.select("class", F.lit(1).alias("r")), "class", "left").groupBy("artifact").agg(F.max("r").alias("used"), F.count("*").alias("n"))
    d = declared.distinct().join(use, "artifact", "left")
    return d.select("coordinate", "scope", "artifact", F.when(~F.col("scope").isin(*judged), "skipped").when(F.col("n").isNull(), "withoutClasses").when(F.col("used") == 1, "used").otherwise("unused").alias("status"))


def ambiguous(declared: DataFrame, artifact_classes: DataFrame, own: DataFrame) -> DataFrame:
    """Classes that several coordinates have, or a dependency and the project itself."""
    owners = declared.filter(F.col("scope").isin(*ANALYZED_SCOPES)).join(artifact_classes, "artifact").groupBy("class").agg(F.count_distinct("coordinate").alias("n"))
    return owners.join(own.select("class", F.lit(1).alias("o")).distinct(), "class", "left").filter("n > 1 OR o = 1").select("class")


def advice(declared: DataFrame, resolved: DataFrame | None, artifact_classes: DataFrame, referenced: DataFrame, api: DataFrame, own: DataFrame, api_complete: bool = True) -> DataFrame:
    """coordinate, scope, rule, suggested, evidence: scopes that do not fit, and dependencies that are used
    but only come by way of others."""
    every = declared if resolved is None else declared.unionByName(resolved)
    odd = ambiguous(every, artifact_classes, own)
    unit = declared.filter(F.col("scope").isin("api", "implementation")).distinct().join(artifact_classes, "artifact")
    unit = unit.join(referenced.select("class", F.lit(True).alias("r")).distinct(), "class", "left").join(api.select("class", F.lit(True).alias("x")).distinct(), "class", "left").join(odd.withColumn("o", F.lit(True)), "class", "left")
    by = unit.groupBy("coordinate", "scope").agg(F.array_sort(F.collect_set(F.when(F.col("r"), F.col("class")))).alias("used"), F.array_sort(F.collect_set(F.when(F.col("x"), F.col("class")))).alias("exposed"), F.count("o").alias("odd"))
    by = by.filter("size(used) > 0 AND odd = 0")
    want = F.when((F.col("scope") == "implementation") & (F.size("exposed") > 0), "api").when((F.col("scope") == "api") & (F.size("exposed") == 0) & F.lit(api_complete), "implementation")
    out = by.select("coordinate", "scope", F.lit("dependency-scope-mismatch").alias("rule"), want.alias("suggested"), F.when(F.size("exposed") > 0, F.col("exposed")).otherwise(F.col("used")).alias("evidence")).filter("suggested IS NOT NULL")
    if resolved is None:
        return out
    main = [s for s in ANALYZED_SCOPES if s not in TEST_SCOPES]
    known = declared.filter(F.col("scope").isin(*main)).select(module_key(F.col("coordinate")).alias("k")).distinct()
    more = resolved.filter(F.col("scope").isin(*main)).withColumn("k", module_key(F.col("coordinate"))).join(known, "k", "left_anti").join(artifact_classes, "artifact")
    more = more.join(referenced.select("class").distinct(), "class", "left_semi").join(odd, "class", "left_anti").join(own.select("class"), "class", "left_anti").join(api.select("class", F.lit(True).alias("x")).distinct(), "class", "left")
    more = more.groupBy("coordinate").agg(F.array_sort(F.collect_set("class")).alias("evidence"), F.count("x").alias("n"))
    hint = F.when(F.col("n") > 0, "api").otherwise("implementation") if api_complete else F.when(F.col("n") > 0, "api")
    return out.unionByName(more.select("coordinate", F.lit(None).cast("string").alias("scope"), F.lit("undeclared-dependency").alias("rule"), hint.alias("suggested"), "evidence"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """Adds a fingerprint of the parts, each after its length."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    cells = [part(F.coalesce(c, F.lit(""))) for c in ("rule", "coordinate", "scope", "suggested")]
    return rows.withColumn("fingerprint", F.concat(F.lit("dependencies-v1|"), *cells, F.array_join(F.transform(F.array_sort("evidence"), part), "")))


def review(rows: DataFrame, baseline: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Advice that neither list has, by fingerprint."""
    return fingerprint(rows).join(baseline.select("fingerprint"), "fingerprint", "left_anti").join(suppressed.select("fingerprint"), "fingerprint", "left_anti")
