"""Where declarations stand in source: headers of files, matched to nodes where only one of each fits."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph.functions.headers import headers

HEADERS = "path string, package string, owners string, kind string, name string, arity int, line int, column int, offset int"


def source_headers(sources: DataFrame) -> DataFrame:
    """Rows of ``HEADERS`` for each of ``sources`` (path, text) whose name ends in .java or .kt; ``owners`` are
    joined by $, columns and lines count from 1, offsets from 0."""

    def run(batches):
        names = [c.split()[0] for c in HEADERS.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int32()] * 4
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = text or ""
                starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
                package, found = headers(text, path.endswith(".kt"))
                for h in found:
                    line = bisect_right(starts, h.offset)
                    rows.append((path, package, "$".join(h.owners), h.kind, h.name, h.arity, line, h.offset - starts[line - 1] + 1, h.offset))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return sources.filter(F.col("path").rlike(r"\.(java|kt)$")).select("path", "text").mapInArrow(run, HEADERS)


def declaration_locations(nodes: DataFrame, found: DataFrame, paths: DataFrame) -> DataFrame:
    """id, path, line, column, offset of ``nodes`` whose header is the only one of its kind.

    ``found`` are ``source_headers``, ``paths`` (id, path) the file of each node.  Package, types around,
    kind, name and number of parameters must agree, for one header of the file and one node of its owner;
    generated nodes, accessors, extension functions and file facades have none.
    """
    has = lambda a: F.coalesce(F.array_contains("attributes", a), F.lit(False))
    own = nodes.filter(~F.coalesce("synthesized", F.lit(False)) & ~has("EXTENSION_FUNCTION") & ~has("EXTERNAL_STUB") & ~has("FILE_FACADE") & ~has("PROPERTY_ACCESSOR"))
    inner = F.regexp_replace("id", "^[a-z]+:", "")
    owner = F.substring_index(inner, "#", 1)
    kind = F.when(F.col("kind").isin(*S.TYPE_KINDS), "TYPE").when(F.col("kind").isin("FIELD", "PROPERTY"), "FIELD").when(F.col("kind").isin("METHOD", "FUNCTION"), "METHOD").when(F.col("kind") == "CONSTRUCTOR", "CONSTRUCTOR")
    simple = F.substring_index(owner, "/", -1)
    name = F.when(F.instr("id", "#") == 0, F.substring_index(simple, "$", -1)).otherwise(F.regexp_extract("id", "#([^(:]*)", 1))
    arity = F.when(F.instr("id", "(") > 0, F.size(F.regexp_extract_all(F.regexp_extract("id", r"\((.*)\)", 1), F.lit(r"(\[*(?:L[^;]*;|[BCDFIJSZ]))"), 1)))
    package = F.when(F.instr(owner, "/") > 0, F.replace(F.regexp_replace(owner, "/[^/]*$", ""), F.lit("/"), F.lit("."))).otherwise("")
    key = ["path", "package", "owners", "kind", "name", "arity"]
    own = own.join(paths.select("id", F.col("path").alias("file")), "id").select("id", F.col("file").alias("path"), package.alias("package"), simple.alias("owners"), kind.alias("kind"), name.alias("name"), F.coalesce(arity, F.lit(-1)).alias("arity"))
    one = own.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    place = F.struct("line", "column", "offset")
    only = found.withColumn("arity", F.coalesce("arity", F.lit(-1))).groupBy(*key).agg(F.min(place).alias("at"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return one.join(only, key).select("id", "path", "at.line", "at.column", "at.offset")
