"""Durable intermediates: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffled files go when their query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own (tests); on a
    cluster a folder of the driver's machine would be out of the executors' sight, so there it is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="symweave-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/symweave/{name}-{uuid.uuid4().hex[:12]}"
    p, fs = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. What was shuffled for it is
    deleted as soon as it is written, and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if kept is None else spark.conf.set(CLEANUP, kept)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more, as a loop's last round but one."""
    p, fs = _file_system(df.sparkSession, df.stored_at)
    fs.delete(p, True)
