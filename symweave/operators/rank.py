"""Ordered choice: the first row of each key under a declared order, and first-match-wins unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Spark sorts are not stable, so order must be total."""
    return top_by(df, keys, order, 1)


def top_by(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; a rank filter, which Spark also applies before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def prioritised(keys: list[str], order: list, *candidates: DataFrame) -> DataFrame:
    """Of several candidate relations with one schema, the rows of the first that has any for a key; of those the first by order."""
    tagged = [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)]
    return first_by(reduce(DataFrame.unionByName, tagged), keys, ["priority", *order])


def first_group(keys: list[str], *candidates: DataFrame) -> DataFrame:
    """Like prioritised, but all rows of the first candidate relation that has any for a key."""
    tagged = [c.withColumn("priority", F.lit(i)) for i, c in enumerate(candidates)]
    w = Window.partitionBy(*keys)
    both = reduce(DataFrame.unionByName, tagged)
    return both.withColumn("__m", F.min("priority").over(w)).where(F.col("priority") == F.col("__m")).drop("__m")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Stable keep-first dedup after a sort: order must carry an explicit ordinal."""
    return first_by(df, keys, order)


def completion_rank(origin: Column, package: Column, own_package: Column) -> Column:
    """Local 0, same-package project 1, other project 2, external 3."""
    return F.when(origin == "local", 0).when((origin == "project") & package.eqNullSafe(own_package), 1).when(origin == "project", 2).otherwise(3)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
