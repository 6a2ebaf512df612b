"""Class files as they arrive: parsed once by content, kept as a table, canonical at each read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.sources import classfile, files


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of class files and archives below a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def keep(stream: DataFrame, table: str, checkpoint: str):
    """Appends parsed classes whose content the table does not have yet; replaying a batch adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = files.class_entries(df).withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
        try:
            old = spark.read.parquet(table).select("sha256")
            new = new.join(old, "sha256", "left_anti")
        except Exception as e:  # noqa: BLE001  only the first batch has no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        marks = new.select("root", "name", "content")
        rows = marks.mapInArrow(classfile.parsed, classfile.SCHEMA)
        hashes = new.select("root", F.col("sha256"), F.regexp_replace("name", r"\.class$", "").alias("entry"))
        rows.join(hashes, (rows["root"] == hashes["root"]) & hashes["entry"].endswith(rows["name"])).select(rows["*"], "sha256", F.lit(number).alias("batch")).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph(spark: SparkSession, table: str) -> Graph:
    """The graph of all classes so far; of a class the version that came last."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("name").agg(F.max_by(F.struct("*"), F.struct("batch", "sha256")).alias("r")).select("r.*")
    return files.class_graph(last.drop("sha256", "batch"))
