"""Which spans of a file hold which positions: an interval join that pairs a position with the spans around it alone.

A position is one number, line before column. The numbers that a span covers fall apart into few aligned blocks of 1, 16,
256, ... numbers, and a position lies in one block of each size, so position and span meet in exactly one block: an
equi-join on file, size and block. A file with very many of both never becomes their product, and no file one task's. What
lies outside of all spans is found by one sweep over pages of files, for which a page must be one task's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import stored

#: Bits of a column within a position's number (later columns of a line share the last number), of a line, and of a block's growth.
COL_BITS, LINE_BITS, STEP = 20, 24, 4
#: Bits of a page's lines: a sweep takes a file by pages of 1,024 lines.
PAGE_BITS = 10
#: Spans of a key up to which each is compared with each of the key's hits.
FEW = 16


def number(line: Column, col: Column) -> Column:
    """Line and column as one number that orders positions; columns and lines beyond the bits share the last one."""
    bound = lambda c, bits: F.least(F.greatest(c.cast("long"), F.lit(0).cast("long")), F.lit((1 << bits) - 1).cast("long"))
    return F.shiftleft(bound(line, LINE_BITS), COL_BITS) + bound(col, COL_BITS)


def in_span(line: Column, col: Column, s_line: Column, s_col: Column, e_line: Column, e_col: Column) -> Column:
    """Position within a span, both ends included."""
    at = F.struct(line.alias("l"), col.alias("c"))
    return (at >= F.struct(s_line.alias("l"), s_col.alias("c"))) & (at <= F.struct(e_line.alias("l"), e_col.alias("c")))


def _range(lo: Column, hi: Column) -> Column:
    return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _per_size(of: Callable[[Column], Column]) -> Column:
    """of(size) for each size, as an array: one function of a column, so that plans hold it once and not once a size."""
    return F.transform(F.sequence(F.lit(0), F.lit(COL_BITS + LINE_BITS), F.lit(STEP)), of)


def _sized(size: Column) -> Callable[[Column], Column]:
    return lambda block: F.struct(size.alias("size"), block.alias("block"))


def blocks_of(first: Column, last: Column) -> Column:
    """array of struct(size, block): aligned blocks that cover first to last (numbers, both included) once."""
    shift = lambda name, x, s: F.call_function(name, x, s)
    up = lambda s: shift("shiftright", first + (shift("shiftleft", F.lit(1).cast("long"), s) - 1), s)
    down = lambda s: shift("shiftright", last + 1, s)

    def blocks(s: Column) -> Column:
        lo, hi, next_lo, next_hi = up(s), down(s), up(s + STEP), down(s + STEP)
        inner = next_lo < next_hi  # larger blocks take what lies between
        left = _range(lo, F.when(inner, F.shiftleft(next_lo, STEP)).otherwise(hi))
        right = F.when(inner, _range(F.shiftleft(next_hi, STEP), hi)).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.transform(F.concat(left, right), _sized(s))

    return F.flatten(_per_size(blocks))


def blocks_around(at: Column) -> Column:
    """array of struct(size, block): the block of each size that a number lies in."""
    return _per_size(lambda s: _sized(s)(F.call_function("shiftright", at, s)))


def around(hits: DataFrame, spans: DataFrame, keys: list[str], at: tuple[str, str] = ("line", "col"), ends: tuple[str, str, str, str] = ("s_line", "s_col", "e_line", "e_col"), few: int = FEW) -> DataFrame:
    """hits x spans where the keys (such as file_path) are equal and the position of the hit, at, lies within the span, ends
    included. Other columns of the two must have different names. A span that ends before it starts holds nothing.

    Where a key has few spans, its hits are compared with each of them; only the spans of other keys fall apart into blocks.
    """
    block, lo, hi, n = "__block", "__first", "__last", "__n"
    within = in_span(*map(F.col, (*at, *ends)))
    counted = stored(spans.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys))), "spans")
    short = hits.join(counted.where(F.col(n) <= few).drop(n), keys).where(within)
    many = counted.where(F.col(n) > few).drop(n)
    if many.isEmpty():
        return short
    of_hit = hits.join(many.select(*keys).distinct(), keys, "left_semi")
    of_hit = of_hit.withColumn(lo, number(F.col(at[0]), F.col(at[1]))).withColumn(block, F.explode(blocks_around(F.col(lo)))).drop(lo)
    of_span = many.withColumns({lo: number(F.col(ends[0]), F.col(ends[1])), hi: number(F.col(ends[2]), F.col(ends[3]))})
    of_span = of_span.withColumn(block, F.explode(blocks_of(F.col(lo), F.col(hi)))).drop(lo, hi)
    # positions beyond the bits share a number, so lines and columns are compared once more
    return of_hit.join(of_span, [*keys, block]).where(within).drop(block).unionByName(short)


def outside(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits(file_path, line, col, ...) that no span(file_path, s_line, s_col, e_line, e_col) holds.

    One sorted sweep over each page of a file: a hit is inside if a span that starts at it or before it ends at it or after
    it. A span stands in every page that it touches; each row is shuffled once, whatever the number of sizes.
    """
    page, at, end, of_hit = "__page", "__at", "__end", "__hit"
    page_of = lambda line, col: F.shiftright(number(line, col), COL_BITS + PAGE_BITS)
    place = lambda line, col: F.struct(F.col(line).cast("long").alias("l"), F.col(col).cast("long").alias("c"))
    asked = hits.select(*hits.columns, page_of(F.col("line"), F.col("col")).alias(page), place("line", "col").alias(at), F.lit(True).alias(of_hit))
    held = spans.where("file_path is not null").select("file_path", place("s_line", "s_col").alias(at), place("e_line", "e_col").alias(end), F.lit(False).alias(of_hit), page_of(F.col("s_line"), F.col("s_col")).alias("__from"), page_of(F.col("e_line"), F.col("e_col")).alias("__to"))
    held = held.where(F.col(at) <= F.col(end)).withColumn(page, F.explode(F.sequence("__from", "__to"))).drop("__from", "__to")
    sofar = Window.partitionBy("file_path", page).orderBy(at, of_hit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionByName(held, allowMissingColumns=True).withColumn(end, F.max(end).over(sofar))
    somewhere = F.col("file_path").isNotNull() & F.col("line").isNotNull() & F.col("col").isNotNull()
    return swept.where(F.col(of_hit) & ~(somewhere & F.coalesce(F.col(end) >= F.col(at), F.lit(False)))).select(*hits.columns)
