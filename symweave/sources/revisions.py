"""Version-control feeds as data: which files changed between two revisions. Nothing is executed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import language_of


def changed_files(commits: DataFrame, changes: DataFrame, old: str, new: str, root: str) -> DataFrame:
    """commits(revision, ordinal), changes(revision, path): source files touched after old and up to new, below root.

    An old revision that is not known gives no rows; ask needs_full_scan first. Paths are joined to root; files in no
    language of ours are left out.
    """
    ends = commits.where(F.col("revision").isin(old, new)).agg(F.max(F.when(F.col("revision") == old, F.col("ordinal"))).alias("a"), F.max(F.when(F.col("revision") == new, F.col("ordinal"))).alias("b"))
    span = commits.join(F.broadcast(ends), (F.col("ordinal") > F.col("a")) & (F.col("ordinal") <= F.col("b"))).select("revision")
    touched = changes.join(span, "revision", "left_semi").where(language_of(F.col("path")).isNotNull())
    return touched.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path")).distinct()


def needs_full_scan(commits: DataFrame, old: str | None) -> bool:
    """Whether the stored revision is missing or no longer known."""
    return old is None or commits.where(F.col("revision") == old).isEmpty()
