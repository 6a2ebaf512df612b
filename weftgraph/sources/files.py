"""Graph facts from files, read with Spark's own readers so that any store will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as X

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.graph import Graph
from weftgraph.sources import classfile

ANDROID = "{http://schemas.android.com/apk/res/android}"
COMPONENTS = ("activity", "application", "instrumentation", "provider", "receiver", "service")
APPLICATION = ("name", "backupAgent", "appComponentFactory", "zygotePreloadName")


def binary(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(paths).select("path", "content")


def entries(files: DataFrame, wanted: str) -> DataFrame:
    """root, name, content of files, and of entries of archives, whose name matches ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = re.compile(wanted).search
        for b in batches:
            rows: dict[str, list] = {"root": [], "name": [], "content": []}
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if re.search(r"\.(jar|zip|aar)$", path, re.I):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and match(i.filename)]
                else:
                    found = [(path, content)] if match(path) else []
                for name, data in found:
                    rows["root"].append(path)
                    rows["name"].append(name)
                    rows["content"].append(data)
                    if len(rows["root"]) >= 500:
                        yield pa.RecordBatch.from_pydict(rows)
                        rows = {k: [] for k in rows}
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("root", pa.string()), ("name", pa.string()), ("content", pa.binary())]))

    return files.mapInArrow(run, "root string, name string, content binary")


def class_entries(files: DataFrame) -> DataFrame:
    """Class files of the base version, without descriptors of modules and packages."""
    return entries(files, r"\.class$").filter(~F.col("name").rlike(r"(module-info|package-info)\.class$|META-INF/versions/"))


def classes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parsed class files, one row each; of copies of a class that of the first root stays."""
    rows = class_entries(binary(spark, paths)).mapInArrow(classfile.parsed, classfile.SCHEMA)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("root"))).filter("_n = 1").drop("_n")
    return first


def class_graph(parsed: DataFrame) -> Graph:
    """Nodes, edges and external calls of parsed classes."""
    types = parsed.select(F.concat(F.lit("class:"), "name").alias("id"), F.element_at(F.split("name", "[/$]"), -1).alias("name"), "kind", F.lit(None).cast("string").alias("module"), F.col("source").alias("path"), F.lit(None).cast("int").alias("line"), "visibility", "modifiers", F.array().cast("array<string>").alias("attributes"), "annotations", "supertypes", "synthesized", F.lit(None).cast("array<string>").alias("enum_constants"))
    m = parsed.select("name", "source", F.explode("members").alias("m"))
    members = m.select("m.id", "m.name", "m.kind", F.lit(None).cast("string").alias("module"), F.col("source").alias("path"), "m.line", "m.visibility", "m.modifiers", F.when(F.col("m.constant"), F.array(F.lit("COMPILE_TIME_CONSTANT"))).otherwise(F.array().cast("array<string>")).alias("attributes"), "m.annotations", F.array().cast("array<string>").alias("supertypes"), "m.synthesized", F.lit(None).cast("array<string>").alias("enum_constants"))
    e = parsed.select(F.explode("edges").alias("e")).select("e.*")
    facts = {"external_calls": parsed.select(F.explode("calls").alias("c")).select("c.*").withColumns({"path": F.lit(None).cast("string"), "line": F.lit(None).cast("int"), "resolved_targets": F.array().cast("array<string>"), "resolution": F.lit("UNRESOLVED"), "model": F.lit(None).cast("string")})}
    enclosing = parsed.filter("enclosing IS NOT NULL").select(F.concat(F.lit("class:"), "name").alias("local_class"), "enclosing")
    return Graph.of(types.unionByName(members), e, **facts, enclosures=enclosing)


def hierarchy(parsed: DataFrame) -> DataFrame:
    return parsed.select("name", "supertypes", (F.col("kind") == "INTERFACE").alias("is_interface"))


def services(spark: SparkSession, paths: list[str]) -> DataFrame:
    """service, provider, path, line of META-INF/services files; comments are dropped."""
    rows = entries(binary(spark, paths), r"META-INF/services/[\w.$]+$")
    lines = rows.select(F.element_at(F.split("name", "/"), -1).alias("service"), F.col("name").alias("path"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("n", "raw"))
    one = F.trim(F.split_part("raw", F.lit("#"), F.lit(1)))
    return lines.select("service", one.alias("provider"), "path", (F.col("n") + 1).cast("int").alias("line")).filter("provider <> ''").distinct()


def bad_providers(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("provider").rlike(r"^[\p{L}_$][\w$]*(\.[\p{L}_$][\w$]*)*$"))


def _xml(files: DataFrame, find) -> DataFrame:
    def run(batches):
        for b in batches:
            rows: dict[str, list] = {"class": [], "path": [], "line": []}
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if b"<!ENTITY" in content:
                    raise ValueError(f"{path}: entities are not read")
                lines = content.decode("utf-8").split("\n")
                for name, raw in find(X.fromstring(content)):
                    rows["class"].append(name)
                    rows["path"].append(path)
                    rows["line"].append(next((i for i, x in enumerate(lines, 1) if raw in x), None))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("class", pa.string()), ("path", pa.string()), ("line", pa.int32())]))

    return files.mapInArrow(run, "class string, path string, line int")


def _evidence(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select(F.concat(F.lit("class:"), F.replace("class", F.lit("."), F.lit("/"))).alias("node_id"), F.lit(reason).alias("reason"), "path", "line").distinct()


def manifest(spark: SparkSession, paths: list[str], namespace: str) -> DataFrame:
    """Evidence from manifests: components, aliases' targets, class names in meta-data; names are completed
    with the namespace, and placeholders are errors."""

    def full(raw: str) -> tuple[str, str]:
        if "${" in raw or not raw.strip():
            raise ValueError(f"class name {raw!r} is not resolved")
        return (namespace + raw if raw.startswith(".") else raw if "." in raw else f"{namespace}.{raw}"), raw

    def find(root):
        for e in root.iter():
            if e.tag == "activity-alias":
                yield full(e.attrib[ANDROID + "targetActivity"])
            elif e.tag in COMPONENTS:
                for a in APPLICATION if e.tag == "application" else ("name",):
                    if (v := e.get(ANDROID + a)) is not None:
                        yield full(v)
            elif e.tag == "meta-data":
                for a in ("name", "value"):
                    v = (e.get(ANDROID + a) or "").rsplit(":", 1)[-1]
                    if "." in v:
                        yield full(v)

    return _evidence(_xml(binary(spark, paths), find), "MANIFEST_COMPONENT")


_CLASS = re.compile(r"[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)+")


def layout_classes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Evidence from resource XML: qualified element names, class attributes, types of binding variables."""

    def find(root):
        binding = root.tag == "layout"
        for e in root.iter():
            if binding and e.tag in ("variable", "import"):
                names = _CLASS.findall(e.get("type", ""))
            else:
                names = [v for v in (e.tag, e.get("class"), e.get(ANDROID + "name"), e.get(ANDROID + "fragment")) if v and _CLASS.fullmatch(v)]
            for n in dict.fromkeys(names):
                yield n, n

    return _evidence(_xml(binary(spark, paths, "*.xml"), find), "XML_LAYOUT")


def layout_includes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """layout, included, literal: include elements; those whose layout is not a literal have no name."""

    def find(root):
        for e in root.iter("include"):
            v = e.get("layout", "")
            yield (v.removeprefix("@layout/") if v.startswith("@layout/") else ""), "<include"

    rows = _xml(binary(spark, paths, "*.xml"), find)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("layout"), F.when(F.col("class") != "", F.col("class")).alias("included"), (F.col("class") != "").alias("literal")).distinct()


def runtime_classes(spark: SparkSession, lists: list[str], reports: list[str]) -> DataFrame:
    """id of classes seen at run time: listed, or covered in a coverage report."""
    out = spark.createDataFrame([], "name string")
    if lists:
        line = F.trim(F.regexp_replace("value", "^﻿", ""))
        out = spark.read.text(lists).select(line.alias("l")).filter("l <> '' AND l NOT LIKE '#%'").select(F.replace(F.regexp_replace("l", r"\.class$", ""), F.lit("."), F.lit("/")).alias("name"))
    if reports:

        def find(root):
            for c in root.iter("class"):
                if any(int(n.get("covered", "0")) > 0 for n in c.iter("counter")):
                    yield c.get("name", "").replace(".", "/"), c.get("name", "")

        out = out.unionByName(_xml(binary(spark, reports), find).select(F.col("class").alias("name")))
    return out.select(F.concat(F.lit("class:"), "name").alias("id")).distinct()


def dependency_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """coordinate, scope, artifact: three fields with tabs between; a line that has others is an error."""
    return spark.read.csv(paths, sep="\t", schema=S.DEPENDENCIES, comment="#", mode="FAILFAST").distinct()


def artifact_classes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """artifact, class of the class files in archives and folders."""
    rows = entries(binary(spark, paths), r"\.class$")
    return rows.select(F.col("root").alias("artifact"), F.regexp_replace("name", r"\.class$", "").alias("class")).distinct()


def external_references(parsed: DataFrame) -> DataFrame:
    """Classes that are named but not among those parsed."""
    named = parsed.select(F.explode("edges").alias("e")).select(S.owner_class(F.col("e.target")).alias("id")).union(parsed.select(F.explode("calls").alias("c")).select(F.concat(F.lit("class:"), "c.owner"))).distinct()
    return named.join(parsed.select(F.concat(F.lit("class:"), "name").alias("id")), "id", "left_anti")


def external_retention(spark: SparkSession, path: str, g: Graph) -> DataFrame:
    """Evidence of a cross-language document; if an id is unknown the whole of it is refused."""
    rows = spark.read.json(path, multiLine=True, schema="retentions array<struct<usr:string,path:string,line:int>>", mode="FAILFAST").select(F.explode("retentions").alias("r"))
    out = rows.select(F.col("r.usr").alias("node_id"), F.lit("EXTERNAL_BRIDGE").alias("reason"), "r.path", "r.line")
    if bad := [r.node_id for r in out.join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").limit(20).collect()]:
        raise ValueError(f"unknown ids: {bad}")
    return out


def source_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, base, package of source files."""
    rows = entries(binary(spark, paths), r"\.(kt|java)$")
    return rows.select(F.col("name").alias("path"), F.element_at(F.split("name", "/"), -1).alias("base"), F.regexp_extract(F.col("content").cast("string"), r"(?m)^\s*package\s+([\w.]+)", 1).alias("package"))


def fingerprints(spark: SparkSession, paths: list[str], role: str) -> DataFrame:
    return binary(spark, paths).select(F.lit(role).alias("role"), "path", F.sha2("content", 256).alias("sha256"))


def freshness(saved: DataFrame, now: DataFrame) -> DataFrame:
    """role, path, status: same, changed, added or removed."""
    both = saved.withColumnRenamed("sha256", "a").join(now.withColumnRenamed("sha256", "b"), ["role", "path"], "full_outer")
    return both.select("role", "path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("status"))


def save(g: Graph, path: str) -> None:
    """Writes a graph as a folder of Parquet tables."""
    for name, df in {"nodes": g.nodes, "edges": g.edges, **g.facts}.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, facts: tuple[str, ...] = ()) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), {f: spark.read.parquet(f"{path}/{f}") for f in facts})


def load_ndjson(spark: SparkSession, path: str) -> Graph:
    """Graph of an export; edges come with their summed kinds."""
    rows = spark.read.text(path)
    part = lambda name, schema: rows.select(F.from_json("value", f"record string, {schema}").alias("r")).filter(F.col("r.record") == name).select("r.*").drop("record")
    nodes = part("node", S.NODES)
    e = part("edge", "source string, target string, kind string, weight bigint, origins array<string>, lines array<int>")
    e = e.select("source", "target", F.when(F.col("kind") == "dispatchCandidate", "OVERRIDE").otherwise(F.col("kind")).alias("kind"), F.get("origins", F.lit(0)).alias("origin"), "weight", "lines")
    return Graph.of(nodes, e)
