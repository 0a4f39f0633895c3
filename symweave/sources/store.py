"""A table in versions: each version is written aside, then a small pointer file is moved into place."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class VersionedTable:
    """Readers see one whole version or the one before it. Paths go through Hadoop's file systems, so any store works
    whose rename of a file is atomic. Re-publishing a version replaces what that attempt wrote."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, sort_by: list[str] | None = None) -> None:
        self.spark, self.path, self.schema, self.sort_by = spark, path.rstrip("/"), schema, sort_by or []
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("x").getFileSystem(self._conf)

    def _pointer(self) -> dict:
        fs, p = self._fs(), self._at("current.json")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return self._pointer().get("version", -1)

    @property
    def stamps(self) -> dict:
        """What was noted with the current version, such as an index version or a revision."""
        return self._pointer().get("stamps", {})

    def read(self) -> DataFrame:
        v = self.version
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v}")

    def publish(self, table: DataFrame, version: int | None = None, **stamps: str) -> int:
        """Write the next version, sorted within files for row-group skipping, and point to it."""
        version = self.version + 1 if version is None else version
        rows = table.select(*self.schema.fieldNames())
        if self.sort_by:
            rows = rows.sortWithinPartitions(*self.sort_by)
        if version == self.version:  # the current version may be what is read: write beside it first
            raise ValueError(f"version {version} is current; publish a later one")
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return self._point({"version": version, "stamps": stamps})

    def truncate(self, **stamps: str) -> int:
        """Publish a version without rows; earlier ones stay until they are vacuumed."""
        return self.publish(self.spark.createDataFrame([], self.schema), **stamps)

    def _names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs().listStatus(self._at(folder))]

    def _unused(self, pointer: dict, version: int) -> list[str]:
        """Folders of an older version that the pointer does not need."""
        return [f"v={version}"]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what only versions before the last keep ones needed; readers that opened those before must be done."""
        pointer = self._pointer()
        found = (int(x[2:]) for x in self._names("") if x.startswith("v=")) if pointer else ()
        gone = [f for v in sorted(found) if v < pointer["version"] - keep for f in self._unused(pointer, v)]
        for folder in gone:
            self._fs().delete(self._at(folder), True)
        return gone

    def _point(self, pointer: dict) -> int:
        version = pointer["version"]
        fs, new = self._fs(), self._at(f".current-{version}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self._conf)
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(fs.makeQualified(new), fs.makeQualified(self._at("current.json")), array)
        return version


class BucketedTable(VersionedTable):
    """A versioned table dealt into buckets by the hash of a key. A publication writes the buckets that it touches; the
    pointer names the version that holds each bucket, so the others stay where they are. The number of buckets is the
    table's for good: size it so that what a batch touches is worth rewriting."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int, sort_by: list[str] | None = None) -> None:
        super().__init__(spark, path, schema, sort_by)
        self.key, self.buckets = key, buckets
        known = self._pointer().get("buckets", buckets)
        if known != buckets:
            raise ValueError(f"the table has {known} buckets, not {buckets}")

    @property
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most as many numbers as the table has buckets."""
        return sorted(r[0] for r in keys.select(self._bucket.alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The whole table, or some buckets of it."""
        parts = self._pointer().get("parts", {})
        paths = [f"{self.path}/v={v}/__bucket={b}" for b, v in parts.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _unused(self, pointer: dict, version: int) -> list[str]:
        used = {f"__bucket={b}" for b, v in pointer["parts"].items() if v == version}
        return [f"v={version}/{x}" for x in self._names(f"v={version}") if x.startswith("__bucket=") and x not in used] if used else [f"v={version}"]

    def publish(self, table: DataFrame, version: int | None = None, **stamps: str) -> int:
        """Write every bucket anew."""
        return self.publish_buckets(table, list(range(self.buckets)), version, **stamps)

    def publish_buckets(self, rows: DataFrame, buckets: list[int], version: int | None = None, **stamps: str) -> int:
        """Rows are all that the buckets hold from now on; a bucket without rows is empty."""
        pointer = self._pointer()
        current = pointer.get("version", -1)
        version = current + 1 if version is None else version
        if version <= current:
            raise ValueError(f"version {version} is not later than {current}")
        # rebalancing puts a bucket into few files and splits one that holds much
        dealt = rows.select(*self.schema.fieldNames(), self._bucket.alias("__bucket")).hint("rebalance", F.col("__bucket"))
        dealt.sortWithinPartitions("__bucket", *self.sort_by).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/v={version}")
        written = self._names(f"v={version}")
        gone = set(buckets)
        parts = {b: v for b, v in pointer.get("parts", {}).items() if int(b) not in gone}
        parts |= {name.partition("=")[2]: version for name in written if name.startswith("__bucket=")}
        return self._point({"version": version, "stamps": stamps, "buckets": self.buckets, "parts": parts})
