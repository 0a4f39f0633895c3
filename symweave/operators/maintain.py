"""Index maintenance as functions from the old table and a batch to the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import first_by


def replace_by_file(old: DataFrame, batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of the files in the batch give way to the batch, which is deduped on its key."""
    return old.join(batch.select("file_path").distinct(), "file_path", "left_anti").unionByName(first_by(batch, key, order))


def replace_edges(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges of the symbols in the batch give way to the batch."""
    return old.join(batch.select("symbol_fqn").distinct(), "symbol_fqn", "left_anti").unionByName(batch.distinct())


def delete_file(symbols: DataFrame, supers: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without those of the files. An edge goes only if all rows of its symbol go."""
    gone = files.select("file_path").distinct()
    left = symbols.join(gone, "file_path", "left_anti")
    dropped = symbols.join(gone, "file_path", "left_semi").select(F.col("fqn").alias("symbol_fqn")).distinct()
    return left, supers.join(dropped, "symbol_fqn", "left_anti")


def delete_jars(external: DataFrame, supers: DataFrame, jars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """External symbols without those of the jars, and their edges with them unless another jar has the symbol."""
    gone = jars.select("jar_path").distinct()
    left = external.join(gone, "jar_path", "left_anti")
    dropped = external.join(gone, "jar_path", "left_semi").select("fqn").distinct().join(left.select("fqn").distinct(), "fqn", "left_anti")
    return left, supers.join(dropped.select(F.col("fqn").alias("symbol_fqn")), "symbol_fqn", "left_anti")


def upsert(old: DataFrame, batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of the batch win over old ones of the same key; within the batch the first by order."""
    both = old.withColumn("__age", F.lit(1)).unionByName(batch.withColumn("__age", F.lit(0)))
    return first_by(both, key, ["__age", *order]).drop("__age")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """jar_path, change: jars of one manifest that the other lacks; null paths are no jars."""
    old, new = (x.select("jar_path").where("jar_path is not null").distinct() for x in (old, new))
    return old.join(new, "jar_path", "left_anti").withColumn("change", F.lit("removed")).unionByName(new.join(old, "jar_path", "left_anti").withColumn("change", F.lit("added")))


def enrich_with_sources(external: DataFrame, from_sources: DataFrame) -> DataFrame:
    """Identifier positions of bytecode rows from the same symbol in their source jar, where it has one."""
    cols = ["ident_line_start", "ident_line_end", "ident_char_start", "ident_char_end"]
    src = first_by(from_sources, ["jar_path", "fqn"], [*cols]).select(F.col("jar_path").alias("s_jar"), F.col("fqn").alias("s_fqn"), *(F.col(c).alias(f"s_{c}") for c in cols))
    joined = external.join(src, (F.col("alt_jar_path") == F.col("s_jar")) & (F.col("fqn") == F.col("s_fqn")), "left")
    return joined.withColumns({c: F.coalesce(f"s_{c}", c) for c in cols}).select(*external.columns)


def needs_full_reindex(has_index: bool, has_manifest: bool, has_classpath: bool, stored_version: str | None, version: str) -> bool:
    return not (has_index and has_manifest and has_classpath) or stored_version != version
