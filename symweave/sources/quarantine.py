"""A side table for inputs that cannot be taken: they are noted with the reason, stop nothing, and are offered again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import stored
from .store import BucketedTable

_S = T.StringType()
ROW = T.StructType([T.StructField(n, t) for n, t in (("path", _S), ("text", _S), ("reason", _S), ("batch", T.LongType()), ("attempts", T.IntegerType()))])


class Quarantine:
    """Inputs by path. A batch is taken together with all that waits, but for files that it brings anew; what take() refuses waits on."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.table = BucketedTable(spark, path, ROW, "path", buckets)

    def offer(self, batch: DataFrame, take: Callable[[DataFrame], tuple[DataFrame, DataFrame]], batch_id: int, gone: DataFrame | None = None) -> DataFrame:
        """batch(path, text) and what waits go to take(inputs(path, text)) -> (taken, refused(path, reason)); gives taken, stored.

        Rows without a path are refused without being offered. Files of gone(path) no longer wait. The same batch_id again
        gives the same, as long as take() does.
        """
        if batch_id <= self.table.version:
            raise ValueError(f"batch {batch_id} was taken before")
        fresh = batch.select("path", "text").where("path is not null")
        replaced = fresh.select("path").unionByName(gone.select("path")) if gone is not None else fresh.select("path")
        waiting = self.table.read().where("path is not null").join(replaced.distinct(), "path", "left_anti")
        inputs = stored(fresh.select("path", "text", F.lit(0).alias("attempts")).unionByName(waiting.select("path", "text", "attempts")), "inputs")
        taken, refused = take(inputs.select("path", "text"))
        taken = stored(taken, "taken")
        first = refused.groupBy("path").agg(F.min("reason").alias("reason"))
        still = inputs.join(first, "path").select("path", "text", "reason", F.lit(batch_id).cast("long").alias("batch"), (F.col("attempts") + 1).alias("attempts"))
        nameless = batch.where("path is null").select("path", "text", F.lit("no path").alias("reason"), F.lit(batch_id).cast("long").alias("batch"), F.lit(1).alias("attempts"))
        self.table.publish(still.unionByName(nameless).unionByName(self.table.read().where("path is null")), batch_id)
        return taken

    def waiting(self) -> DataFrame:
        """path, text, reason, batch, attempts."""
        return self.table.read()
