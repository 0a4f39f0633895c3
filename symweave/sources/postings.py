"""An inverted index of identifiers: where each word of a corpus stands, and whether in a comment or a string."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..durable import stored
from ..operators import spans
from .parse import Outline
from .store import BucketedTable

SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("kind", T.StringType())])
NAMES = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("name", T.StringType())])
_WORD = re.compile(r"[A-Za-z0-9_]+")
#: Words beyond which those found are handed on.
HELD_WORDS = 1 << 16


def words(contents: DataFrame) -> DataFrame:
    """contents(path, text, and language where there is one) -> name, file_path, line, col of every run of letters, digits and
    underscores, lines from 0; with a language also kind: comment or string of the span that the word stands in, else code."""
    kinds = "language" in contents.columns
    schema = T.StructType([f for f in SCHEMA.fields if kinds or f.name != "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            found: list[list] = [[] for _ in schema.fields]
            for path, text, *language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _words_of(path, text or "", language, found)
                if len(found[0]) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)
                    found = [[] for _ in schema.fields]
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

    return contents.select("path", "text", *["language"] * kinds).mapInArrow(run, schema)


def _words_of(path: str, text: str, language: list[str], found: list[list]) -> None:
    """Adds the words of a text to the columns found; kinds where language has an element."""
    spans = Outline(text, language[0]).spans() if language else []
    name, file_path, line, col, *kind = found
    n, start, at = 0, 0, 0  # of the line, its first offset, and of the spans not yet passed
    for m in _WORD.finditer(text):
        begin = m.start()
        while 0 <= (end := text.find("\n", start, begin)):
            n, start = n + 1, end + 1
        name.append(m[0])
        file_path.append(path)
        line.append(n)
        col.append(begin - start)
        if kind:
            while at < len(spans) and spans[at][1] <= begin:
                at += 1
            kind[0].append(spans[at][2] if at < len(spans) and spans[at][0] <= begin else "code")


def postings(contents: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The words of contents(path, text) with kind: of the span of held(file_path, s_line, s_col, e_line, e_col, kind) that
    they stand in, such as comment or string, else code. Spans end before their last position, as parsers give them. Without held,
    the comments and strings of contents(path, text, language) are found as its words are, in the same pass."""
    if held is None:
        return words(contents.select("path", "text", "language"))
    every = words(contents.select("path", "text"))
    within = spans.around(every, held.withColumn("e_col", F.col("e_col") - 1), ["file_path"]).groupBy("file_path", "line", "col").agg(F.min("kind").alias("kind"))
    return every.join(within, ["file_path", "line", "col"], "left").select("name", "file_path", "line", "col", F.coalesce("kind", F.lit("code")).alias("kind"))


class PostingIndex:
    """Postings in buckets by name, and the names of each file in buckets by file. A request reads the buckets of its names
    and of those the row groups that hold them; new contents of some files read and rewrite the buckets of the names that
    those files had and have. Names of files are published last, so a replacement that broke off can be made again."""

    def __init__(self, spark, path: str, buckets: int = 256) -> None:
        at = path.rstrip("/")
        self.table = BucketedTable(spark, f"{at}/postings", SCHEMA, "name", buckets, ["name", "file_path"])
        self.names = BucketedTable(spark, f"{at}/names", NAMES, "file_path", buckets, ["file_path"])

    @property
    def version(self) -> int:
        return self.names.version

    def build(self, contents: DataFrame, held: DataFrame | None = None, version: int = 0) -> None:
        if self.table.version < version:
            self.table.publish(postings(contents, held), version)
        if self.names.version < version:
            self.names.publish(self.table.read().select("file_path", "name").distinct(), version)

    def replace(self, contents: DataFrame, held: DataFrame | None = None, gone: DataFrame | None = None, version: int | None = None) -> None:
        """Postings of these files in place of the old ones; those of gone(file_path) are dropped."""
        version = self.version + 1 if version is None else version
        if version <= self.version:
            return
        files = contents.select(F.col("path").alias("file_path"))
        files = stored((files.unionByName(gone.select("file_path")) if gone is not None else files).distinct(), "files")
        fresh = stored(postings(contents, held), "fresh")
        file_buckets = self.names.touched(files)
        had = self.names.read(file_buckets)
        if self.table.version < version:
            buckets = self.table.touched(had.join(files, "file_path", "left_semi").select("name").unionByName(fresh.select("name")))
            self.table.publish_buckets(self.table.read(buckets).join(files, "file_path", "left_anti").unionByName(fresh), buckets, version)
        self.names.publish_buckets(had.join(files, "file_path", "left_anti").unionByName(fresh.select("file_path", "name").distinct()), file_buckets, version)

    def references(self, names: DataFrame, kinds: tuple[str, ...] = ("code", "string")) -> DataFrame:
        """names(name) -> name, file_path, line, col, kind: whole words of the names outside comments."""
        asked = names.select("name").distinct()
        found = self.table.read(self.table.touched(asked))
        return found.join(asked, "name", "left_semi").where(F.col("kind").isin(*kinds))
