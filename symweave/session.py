"""A session with the settings that the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and merges small partitions; recursion limits bound one recursive query.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "symweave", checkpoint_dir: str | None = None, **extra: str) -> SparkSession:
    """On a cluster, checkpoint_dir must be a folder that driver and executors share."""
    conf = SETTINGS | ({"spark.checkpoint.dir": checkpoint_dir} if checkpoint_dir else {}) | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
