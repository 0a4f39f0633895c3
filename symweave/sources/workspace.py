"""Source trees: scan, parse, and the relations of what was found."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import EXCLUDED_FOLDERS, FACTS, LANGUAGES
from .parse import facts_of

#: Line feeds beyond which a source or archive entry is left out.
MAX_LINES = 10_000
#: Files, and characters of them, whose facts are held at once while parsing.
PARSED_FILES, PARSED_CHARS = 64, 1 << 18


def is_excluded(path: Column, root: str = "") -> Column:
    """Whether a folder on the path below the root, the scan's own folder, is one that scans leave out."""
    if root.rstrip("/"):
        path = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 1, 1 << 30)).otherwise(path)
    return path.rlike("/(" + "|".join(x.replace(".", r"\.") for x in EXCLUDED_FOLDERS) + ")/")


def language_of(path: Column) -> Column:
    """Language by extension, null for other files."""
    ext = F.substring_index(path, ".", -1)
    out = F.lit(None).cast("string")
    for e, language in LANGUAGES.items():
        out = F.when(ext == e, language).otherwise(out)
    return out


def too_long(text: Column, lines: int = MAX_LINES) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) > lines


def scan_workspace(spark: SparkSession, root: str) -> DataFrame:
    """path, language, text of every source file under root; local paths without their scheme. Folders are left out by
    their place below root, wherever that itself lies."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{java,groovy,kt}").text(root, wholetext=True)
    found = files.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("value").alias("text"))
    return with_language(found, re.sub("^file:/+", "/", root))


def with_language(files: DataFrame, root: str = "") -> DataFrame:
    """files(path, text): those in a language we read and outside folders excluded below root."""
    return files.where(~is_excluded(F.col("path"), root)).withColumn("language", language_of(F.col("path"))).where("language is not null").select("path", "language", "text")


def with_buffers(files: DataFrame, buffers: DataFrame, root: str = "") -> DataFrame:
    """Open buffers(path, text) win over what is on disk; buffers without a file count as well."""
    b = buffers.select(F.col("path").alias("b_path"), F.col("text").alias("b_text"))
    both = files.select("path", "text").join(b, F.col("path") == F.col("b_path"), "full_outer")
    return with_language(both.select(F.coalesce("path", "b_path").alias("path"), F.coalesce("b_text", "text").alias("text")), root)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few files' facts at a time, however many or large the files of a batch are."""
    schema = to_arrow_schema(FACTS)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows, read = [], 0
            while at < batch.num_rows and len(rows) < PARSED_FILES and read < PARSED_CHARS:
                path, language, text = (c[at].as_py() for c in batch.columns)
                rows.append(facts_of(path, text or "", language))
                read, at = read + len(text or ""), at + 1
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parse(files: DataFrame) -> DataFrame:
    """files(path, language, text) -> one row of facts per file; a file that cannot be read has its error instead."""
    return files.select("path", "language", "text").mapInArrow(_facts, FACTS)


def facts(parsed: DataFrame, name: str) -> DataFrame:
    """One kind of fact as a relation: path, language, package and its fields."""
    return parsed.select("path", "language", "package", F.explode(name).alias("__f")).select("path", "language", "package", "__f.*")


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("symbols").alias("s")).select("s.*")


def supers(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("supers").alias("s")).select("s.*").distinct()


def lookup_view(rows: DataFrame) -> DataFrame:
    """Symbols under the short column names that the lookups use."""
    return rows.select(
        F.col("fully_qualified_name").alias("fqn"), "short_name", "package_name", "parent_name", "file_path", F.col("file_type").alias("language"), F.col("symbol_type").alias("kind"), "modifiers",
        F.transform("metadata.parameters", lambda p: p["type_name"]).alias("param_types"), F.col("metadata.return_type").alias("return_type"), F.col("ident_line_start").alias("line"),
    )
