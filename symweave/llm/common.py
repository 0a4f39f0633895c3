"""Helpers shared by the corpus operators: durable intermediates, broadcast guards, batched text access."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import discard, shared_dir, shared_path, stored  # noqa: F401

#: Rows up to which a counted side may be broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text that may be broadcast beside it.
BROADCAST_BYTES = 32 << 20
#: Rows of 64 bits that a broadcast bitmap has at most (2^20 rows of two numbers, some 50 MB as a hash table).
BIT_WORDS = 1 << 20
#: Text bytes that a Python worker holds at once as str objects.
SLICE_BYTES = 8 << 20


def guarded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, of rows of fixed width, with a broadcast hint if its counted rows fit the limit, else df as it is (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df


def guarded_texts(df: DataFrame, size: Column) -> DataFrame:
    """df, of rows of any width, with a broadcast hint if its rows and the sum of their sizes in bytes fit the limits."""
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def bit_words(keys: DataFrame) -> DataFrame:
    """keys(key long), any number of them -> (word, bits): a bitmap of their remainders, one row for each 64 bits that
    any of them touches, so at most BIT_WORDS rows. It is what may_hold() broadcasts."""
    bit = F.pmod("key", F.lit(64 * BIT_WORDS))
    one = F.expr(f"shiftleft(1L, cast(pmod(key, {64 * BIT_WORDS}) % 64 as int))")
    return keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits"))


def may_hold(rows: DataFrame, col: str, words: DataFrame) -> DataFrame:
    """The rows whose col (long) is among the keys of words, with a few others: more of them the fuller the bitmap."""
    got = rows.join(F.broadcast(words), F.expr(f"shiftright(pmod({col}, {64 * BIT_WORDS}), 6)") == F.col("word"))
    return got.where(f"shiftright(bits, cast(pmod({col}, {64 * BIT_WORDS}) % 64 as int)) & 1 = 1").drop("word", "bits")


def unused(docs: DataFrame, name: str) -> str:
    """name, made longer until no column of docs has it (names are compared as Spark does, whatever their case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """docs and the name of a column that no two rows share: the id where it is one, else a number that the rows
    are given once, in a stored table (numbers given anew could differ when a lost task runs again)."""
    repeated = docs.groupBy(F.col(id_col).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null")
    if repeated.isEmpty():
        return docs, id_col
    key = unused(docs, "__row")
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def without_rows(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key (long) is in the one column of keys."""
    gone = unused(docs, "__gone")
    return docs.join(keys.toDF(gone), F.col(key).cast("long") == F.col(gone), "left_anti")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most limit bytes of text (one longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_texts(docs: DataFrame, make: Callable[[], Callable], schema: str, text: str = "text") -> DataFrame:
    """Run a batch function over whole texts. make() is called once per task and returns
    f(record_batch, list_of_texts) -> {column: list or array}; a null text arrives as ''."""
    names = [f.split()[0] for f in _top_level(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        target = None
        for batch in sliced(batches, text):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            got = call(batch, texts)
            if target is None:
                target = _arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(got[n], type=target.field(n).type) if not isinstance(got[n], pa.Array) else got[n] for n in names], schema=target)

    return docs.mapInArrow(run, schema)


def _top_level(schema: str) -> list[str]:
    """Fields of a DDL string, split at commas outside angle brackets."""
    parts, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    return _ARROW[kind]


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _arrow_type(k.strip())) for n, k in (f.split(None, 1) for f in _top_level(schema))])


def words_of(col: Column) -> Column:
    """Words: maximal runs of letters a-z, digits and characters beyond ASCII, after lower-casing A-Z."""
    # lower() also changes letters beyond ASCII, which is harmless but for the two that become ASCII letters
    plain = F.lower(F.replace(F.replace(col, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))
    return F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
