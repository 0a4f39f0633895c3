"""Jars, their pairing with source jars, classpaths and build files. Dependency lists are data: nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SKIPPED_JARS = ("-tests.jar", "-test.jar", "-javadoc.jar")
BUILD_FILES = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
CLASSPATH_SCHEMA = "sourceDirs array<string>, jarPaths array<string>"


def keep_jar(path: Column) -> Column:
    """Jars of tests and docs are skipped; a missing path is kept."""
    skip = F.lit(False)
    for end in SKIPPED_JARS:
        skip = skip | path.endswith(end)
    return ~F.coalesce(skip, F.lit(False))


def pair_jars(jars: DataFrame) -> DataFrame:
    """jars(path) -> byte_jar, src_jar: bytecode and source jars of one stem; those without a partner stay alone."""
    name = F.substring_index("path", "/", -1)
    rows = jars.where("path is not null").select("path", name.alias("name")).distinct()
    is_source = F.col("name").endswith("-sources.jar")
    byte = rows.where(~is_source).select(F.col("path").alias("byte_jar"), F.regexp_replace("name", r"\.jar$", "").alias("stem"))
    src = rows.where(is_source).select(F.col("path").alias("src_jar"), F.regexp_replace("name", r"-sources\.jar$", "").alias("s_stem"))
    return byte.join(src, F.col("stem") == F.col("s_stem"), "full_outer").select("byte_jar", "src_jar")


def choose_jar(pairs: DataFrame) -> DataFrame:
    """jar_path, alt_jar_path: bytecode where there is any, its source jar beside it; sources alone otherwise."""
    return pairs.where(keep_jar(F.col("byte_jar")) & keep_jar(F.col("src_jar"))).select(F.coalesce("byte_jar", "src_jar").alias("jar_path"), F.when(F.col("byte_jar").isNotNull(), F.col("src_jar")).alias("alt_jar_path"))


def classpaths(lines: DataFrame) -> DataFrame:
    """lines(value) with a JSON object per subproject -> source_dirs, jar_paths; lines that do not parse are dropped."""
    got = lines.select(F.from_json("value", CLASSPATH_SCHEMA, {"mode": "PERMISSIVE"}).alias("c")).where("c.sourceDirs is not null and c.jarPaths is not null")
    return got.select(F.col("c.sourceDirs").alias("source_dirs"), F.col("c.jarPaths").alias("jar_paths"))


def jars_of_files(files: DataFrame, subprojects: DataFrame) -> DataFrame:
    """files(file_path), subprojects(ordinal, source_dirs, jar_paths) -> file_path, jars: of the first subproject that holds
    the file, and none for files outside. A folder holds a file by whole path components, so the join runs on them."""
    dirs = subprojects.select("ordinal", "jar_paths", F.explode("source_dirs").alias("dir")).select("ordinal", "jar_paths", F.regexp_replace("dir", "/+$", "").alias("dir"))
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    held = files.select("file_path", F.explode(above).alias("dir")).join(dirs, "dir").groupBy("file_path").agg(F.min_by("jar_paths", "ordinal").alias("jars"))
    return files.select("file_path").join(held, "file_path", "left").select("file_path", F.coalesce("jars", F.expr("cast(array() as array<string>)")).alias("jars"))


def is_build_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(*BUILD_FILES)
