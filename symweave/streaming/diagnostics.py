"""Diagnostics of open buffers as a changelog: what a micro-batch adds and what it takes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..durable import stored
from ..sources import workspace
from ..sources.store import BucketedTable

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
ROW = T.StructType([T.StructField(n, t) for n, t in (("path", _S), ("version", _L), ("line", _I), ("col", _I), ("code", _S), ("severity", _S), ("message", _S))])
#: What a changelog row says beside its sign.
SAID = ["path", "line", "col", "code", "severity", "message"]


def rules(files: DataFrame) -> DataFrame:
    """files(path, text) -> path, line, col, code, severity, message of the rules that need no more than the file."""
    found = workspace.facts(workspace.parse(workspace.with_language(files.select("path", "text"))), "diagnostics")
    return found.select("path", F.col("line_start").alias("line"), F.col("char_start").alias("col"), "code", "severity", "message").distinct()


class DiagnosticsFeed:
    """The diagnostics that hold now, by file, and a log of signed rows. The newest version of each file in a batch counts,
    and only if it is newer than what is known of the file, so batches may come in any order. A closed or deleted file
    takes all of its rows back. Files without diagnostics keep one row without a code, which notes their version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.log = spark, f"{path.rstrip('/')}/log"
        self.current = BucketedTable(spark, f"{path.rstrip('/')}/current", ROW, "path", buckets, ["path"])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch(path, kind, version, text); a batch that was published before is skipped."""
        if batch_id <= self.current.version:
            return
        newest = batch.groupBy("path").agg(F.max_by(F.struct("version", "kind", "text"), F.struct("version", "kind")).alias("n")).select("path", "n.*")
        at = self.current.touched(newest)
        held = self.current.read(at)
        known = held.groupBy("path").agg(F.max("version").alias("known"))
        newest = stored(newest.join(known, "path", "left").where("known is null or version > known").drop("known"), "newest")
        found = rules(newest.where("kind not in ('close', 'delete') and text is not null"))
        fresh = stored(newest.select("path", "version").join(found, "path", "left").select(*ROW.fieldNames()), "fresh")
        old = held.join(newest.select("path"), "path", "left_semi")
        said = lambda rows: rows.where("code is not null").select(*SAID)
        added = said(fresh).exceptAll(said(old)).withColumn("sign", F.lit(1))
        taken = said(old).exceptAll(said(fresh)).withColumn("sign", F.lit(-1))
        added.unionByName(taken).write.mode("overwrite").parquet(f"{self.log}/batch={batch_id}")
        self.current.publish_buckets(held.join(newest.select("path"), "path", "left_anti").unionByName(fresh), at, batch_id)

    def follow(self, changes: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """From a stream of changes(path, kind, version, text)."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def changelog(self) -> DataFrame:
        """All signed rows of published batches: path, line, col, code, severity, message, sign, batch."""
        schema = "path string, line int, col int, code string, severity string, message string, sign int, batch long"
        return self.spark.read.schema(schema).parquet(self.log).where(F.col("batch") <= self.current.version)


def accumulated(changelog: DataFrame) -> DataFrame:
    """The rows that hold after all of the changelog."""
    return changelog.groupBy(*SAID).agg(F.sum("sign").alias("n")).where("n > 0").drop("n")
