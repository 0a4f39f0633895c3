"""A supertype closure that is kept up to date batch by batch, reading and rewriting the buckets that a batch affects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import stored
from ..operators import hierarchy
from .store import BucketedTable

_S, _I = T.StringType(), T.IntegerType()
EDGES = T.StructType([T.StructField("child", _S), T.StructField("parent", _S), T.StructField("ordinal", _I)])
WAYS = T.StructType([T.StructField("child", _S), T.StructField("ancestor", _S), T.StructField("depth", _I), T.StructField("path", T.ArrayType(_I))])
BELOW = T.StructType([T.StructField("ancestor", _S), T.StructField("child", _S)])


class StoredClosure:
    """Three tables: edges and first ways by child, and who is below whom by ancestor, which tells what a change affects.

    A batch replaces all edges of the types that it names. Types below them lose their ways and get them anew; the ways
    of all others stay where they are. A batch that broke off can be applied again: a table that has its version already
    is left alone, ways are published last, and who is below a changed type is the same by the table before the batch and
    after it, since the way to the nearest changed type leads through types that nothing changed for.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        at = path.rstrip("/")
        self.spark = spark
        self.edges = BucketedTable(spark, f"{at}/edges", EDGES, "child", buckets, ["child"])
        self.ways = BucketedTable(spark, f"{at}/ways", WAYS, "child", buckets, ["child"])
        self.below = BucketedTable(spark, f"{at}/below", BELOW, "ancestor", buckets, ["ancestor"])

    @property
    def version(self) -> int:
        return self.ways.version

    def build(self, edges: DataFrame, version: int = 0) -> None:
        """From all edges(child, parent, ordinal)."""
        edges = edges.select("child", "parent", F.col("ordinal").cast("int").alias("ordinal"))
        closed = stored(hierarchy.closure(edges).select("child", "ancestor", F.col("depth").cast("int").alias("depth"), F.col("path").cast("array<int>").alias("path")), "closure")
        self._publish(self.edges, edges, None, version)
        self._publish(self.below, closed, None, version)
        self._publish(self.ways, closed, None, version)

    def _publish(self, table: BucketedTable, rows: DataFrame, buckets: list[int] | None, version: int) -> None:
        if table.version < version:
            table.publish_buckets(rows, list(range(table.buckets)) if buckets is None else buckets, version)

    def apply(self, edges: DataFrame, changed: DataFrame, version: int | None = None) -> dict[str, int]:
        """Replace the edges of changed(child) by edges(child, parent, ordinal), which has no other children, and keep the
        closure right. Gives the numbers of types below the change and of buckets that were read and written."""
        version = self.version + 1 if version is None else version
        if version <= self.version:
            return {"below": 0, "read": 0, "written": 0}
        edges = stored(edges.select("child", "parent", F.col("ordinal").cast("int").alias("ordinal")), "batch")
        changed = stored(changed.select("child").unionByName(edges.select("child")).distinct(), "changed")
        above = self.below.touched(changed.select(F.col("child").alias("ancestor")))
        lower = self.below.read(above).join(changed.select(F.col("child").alias("ancestor")), "ancestor", "left_semi").select("child")
        below = stored(changed.unionByName(lower).distinct(), "below")
        own_at, held_at = self.edges.touched(changed), self.edges.touched(below)
        held = self.edges.read(held_at)
        if self.edges.version < version:
            self._publish(self.edges, self.edges.read(own_at).join(changed, "child", "left_anti").unionByName(edges), own_at, version)
            held = self.edges.read(held_at)
        own = stored(held.join(below, "child", "left_semi"), "own")
        beside = self.ways.touched(hierarchy.entered(below, own))
        again = hierarchy.rederived(below, self.ways.read(beside), self.edges.read(), own=own)
        again = stored(again.select("child", "ancestor", F.col("depth").cast("int").alias("depth"), F.col("path").cast("array<int>").alias("path")), "again")
        ways_at = self.ways.touched(below)
        # ancestors that gain or lose a type below
        old = self.ways.read(ways_at).join(below, "child", "left_semi").select("ancestor")
        met_at = self.below.touched(old.unionByName(again.select("ancestor")))
        self._publish(self.below, self.below.read(met_at).join(below, "child", "left_anti").unionByName(again.select("ancestor", "child")), met_at, version)
        self._publish(self.ways, self.ways.read(ways_at).join(below, "child", "left_anti").unionByName(again), ways_at, version)
        read = len(above) + len(held_at) + len({*beside, *ways_at}) + len(met_at)
        return {"below": below.count(), "read": read, "written": len(own_at) + len(ways_at) + len(met_at)}
