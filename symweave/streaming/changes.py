"""Change feeds: buffers, debounced re-indexing and routing as Structured Streaming over one batch logic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.maintain import replace_by_file
from ..sources import workspace
from ..sources.store import BucketedTable


def latest(changes: DataFrame) -> DataFrame:
    """changes(uri, kind, version, text) -> the newest row of each uri: a micro-batch names a file once."""
    return changes.groupBy("uri").agg(F.max("version").alias("version"), F.max_by("kind", "version").alias("kind"), F.max_by("text", "version").alias("text"))


def live_buffers(changes: DataFrame) -> DataFrame:
    """uri, text of documents that are open now: closed and deleted ones are gone."""
    return latest(changes).where(~F.col("kind").isin("close", "delete")).select("uri", "text")


def bursts(changes: DataFrame, gap: str, late: str) -> DataFrame:
    """Streaming: bursts of a uri without an idle gap, emitted once the watermark has passed. changes(uri, ts timestamp)."""
    return changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "uri").agg(F.count(F.lit(1)).alias("n")).select("uri", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def route(changes: DataFrame, open_uris: DataFrame) -> DataFrame:
    """Watched-file events of a batch: deletions, build changes, and re-indexing of files that no editor has open."""
    name = F.substring_index("uri", "/", -1)
    build = name.isin("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
    tagged = changes.join(open_uris.select("uri", F.lit(True).alias("is_open")), "uri", "left")
    kind = F.when(F.col("kind") == "delete", "delete").when(build, "build").when(F.col("is_open"), "skip_open").otherwise("reindex")
    return tagged.select("uri", "version", kind.alias("route"))


def apply_batch(symbols: DataFrame, batch: DataFrame) -> DataFrame:
    """The symbol table after a micro-batch: each changed file is parsed once, and replaces its rows; deleted files go."""
    now = latest(batch)
    files = workspace.with_language(now.where("text is not null and kind not in ('delete', 'close')").select(F.col("uri").alias("path"), "text"))
    fresh = workspace.symbols(workspace.parse(files))
    gone = now.where("kind = 'delete'").select(F.col("uri").alias("file_path"))
    touched = files.select(F.col("path").alias("file_path"))  # a file that declares nothing any more loses its rows too
    left = symbols.join(gone.unionByName(touched).distinct(), "file_path", "left_anti")
    key = ["file_path", "fully_qualified_name", "signature"]
    sign = lambda df: df.withColumn("signature", F.to_json("metadata"))
    return replace_by_file(sign(left), sign(fresh), key, ["line_start", "char_start"]).drop("signature")


def maintain_index(changes: DataFrame, read: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep an index up to date from a stream of changes.

    read() gives the current table and publish(table, batch_id) writes the next version elsewhere and then moves a
    pointer; both are keyed by the batch, so a batch that is run again after a failure does no harm.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        publish(apply_batch(read(), batch), batch_id)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintain_buckets(changes: DataFrame, table: BucketedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep an index that is bucketed by file_path up to date: a micro-batch reads and rewrites the buckets of its files
    alone. A batch that was published before it was committed is skipped when it comes again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        buckets = table.touched(batch.select(F.col("uri").alias("file_path"))) if batch_id > table.version else []
        if buckets:
            table.publish_buckets(apply_batch(table.read(buckets), batch), buckets, batch_id)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
