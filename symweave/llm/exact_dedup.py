"""Exact deduplication: rows are grouped by a 128-bit content hash, bytes are compared inside the groups.

Built only from DataFrame functions. A first pass writes each row's hashes and groups them; only rows whose
hash another row has too (a broadcast bitmap tells, with few others) send their texts into the second
grouping, by hash and bytes, so that texts with one hash and different bytes are never merged. Its map-side
combine turns a hot group into one row per map task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_words, may_hold, stored, text_or_empty, with_row_key, without_rows

#: The characters that normalisation deletes.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_STEP = 20_000_000_000_000_000_000


def _step() -> Column:
    return F.expr(f"{_STEP}BD")


def squeeze(col: Column) -> Column:
    """Delete every space, tab, line feed, vertical tab, form feed and carriage return."""
    for ch in BLANKS:
        col = F.replace(col, F.lit(ch), F.lit(""))
    return col


def hash128(col: Column) -> Column:
    return F.unhex(F.md5(col))


def _classes(docs: DataFrame, id_col: str, text_col: str, hash_fn: Callable[[Column], Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, h, sha) of every row, stored; (h, sha, keep_id, n_best, group_size) of texts that may have copies."""
    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(key).cast("long").alias("key"), F.length(text).alias("n"), squeeze(text).alias("norm"))
    keyed = read.withColumn("h", hash_fn(F.col("norm")))
    rows = stored(keyed.select("doc_id", "key", "n", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "hashes")
    repeated = rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.xxhash64("h").alias("key"))
    suspects = may_hold(keyed.withColumn("hh", F.xxhash64("h")), "hh", stored(bit_words(repeated), "repeated"))
    # One exact number orders (most code points, smallest id) and keeps the aggregate buffer fixed-width,
    # so that grouping by whole texts is a hash aggregate and not a sort of texts.
    order = F.col("n").cast("decimal(10,0)") * _step() - F.col("doc_id").cast("decimal(20,0)")
    classes = (
        suspects.select("h", "norm", order.alias("order"))
        .groupBy("h", "norm")
        .agg(F.max("order").alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "best", "group_size")
        .withColumn("n_best", F.expr(f"cast((best + {_STEP // 2}BD) div {_STEP}BD as decimal(10,0))"))
        .select("h", "sha", (F.col("n_best") * _step() - F.col("best")).cast("long").alias("keep_id"), F.col("n_best").cast("int").alias("n_best"), "group_size")
    )
    return rows, classes


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in the original text stays, then the
    smallest id. A null text is an empty one. A null id never stays while a copy with an id exists; if
    no copy has an id, keep_id is null and the rows are kept. Rows that repeat an id share its fate.
    A text of any length is hashed and compared whole. An empty table gives no rows; other columns of
    docs are not read.
    """
    rows, classes = _classes(docs, id_col, text_col, hash_fn, id_col)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        rows.join(classes, ["h", "sha"], "left")
        .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one that exact_dedup keeps; all columns stay.

    Rows are told apart by more than their id: of rows that repeat the kept id and text one stays, and a text
    of its own stays whatever id it shares. Rows without an id stay.
    """
    names = docs.columns
    docs, key = with_row_key(docs, id_col)
    rows, classes = _classes(docs, id_col, text_col, hash128, key)
    grouped = rows.join(classes.where("group_size > 1"), ["h", "sha"])
    if key != id_col:
        grouped = stored(grouped, "grouped")
        stays = grouped.where("doc_id = keep_id and n = n_best").groupBy("h", "sha").agg(F.min("key").alias("stays"))
        grouped = grouped.join(stays, ["h", "sha"])
    else:
        grouped = grouped.withColumn("stays", F.col("keep_id"))
    return without_rows(docs, grouped.where("doc_id is not null and key <> stays").select("key"), key).select(*names)


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
