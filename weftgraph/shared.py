"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Removes the shuffle files of a plan once it has run.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` of the session, or set on its context; a local one only where
    none is set (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
    return _own[sc.applicationId]


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, read back from a table in the shared folder.

    Lineage ends there, so the shuffle files of the plan behind it are removed once it is written, a lost
    executor costs a reread, and later plans know its size.  The table itself goes when ``removed``, or
    when the driver ends.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(CLEAN, None)
    folder, system = _folder(spark, path)
    system.deleteOnExit(folder)
    spark.conf.set(CLEAN, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the table behind ``written(df)``; call it when no plan reads it any more."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        folder, system = _folder(df.sparkSession, path)
        system.delete(folder, True)


def modified(spark: SparkSession, path: str) -> int:
    """When the file or folder was last changed (ms)."""
    folder, system = _folder(spark, path)
    return system.getFileStatus(folder).getModificationTime()
