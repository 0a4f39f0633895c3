"""Sharding by a k-d tree: cells are split at weighted medians along their widest metadata dimension until each is one shard.

Only what is small is sorted out on the driver: the tree (one cut a shard) and, for every cell that is being split, one
histogram of a fixed number of bins at a time. A cut is found by narrowing: bins over the coordinate, then, where many
rows share one, bins over the text's hash, until few enough units are left to be listed. All cells of a level go together.

Copies of a text share one place, that of the copy with the smallest id, so they lie in one shard. A group of copies that
weighs more than a small part of a shard is dealt into pieces by id first: pieces are neighbours in every order, so it is
spread over as few shards as its size asks for, and no row of it waits for the others.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import guarded, stored

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Part of a shard's bytes up to which a group of copies stays whole.
PIECE = 1 / 200
#: Bins of a cell's histogram, units of a cell that are listed at once, and rows that are numbered in one window.
BINS, LISTED, BLOCK_ROWS = 512, 1000, 50_000


@dataclass
class Cell:
    """shards from first on; cut and the two halves once it is split."""

    first: int
    shards: int
    cut: tuple | None = None
    halves: list[Cell] = field(default_factory=list)


def _coordinate(rows: DataFrame, name: str, kind: str) -> Column:
    """Where a value lies between the least and the greatest of its column, 0 to 1; null at 0. Texts go by the first six
    bytes after what all have in common; texts that agree in those share a coordinate."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "timestamp") or kind.startswith("decimal"):
        v = F.col(name).cast("double")
        v = F.when(F.abs(v) < float("inf"), v)
    else:
        text = F.hex(F.col(name).cast("string").cast("binary"))
        least, most = rows.agg(F.min(text), F.max(text)).first()
        common = len(os.path.commonprefix([least or "", most or ""])) // 2 * 2
        v = F.conv(F.rpad(F.substring(text, common + 1, 12), 12, "0"), 16, 10).cast("double")
    least, most = rows.agg(F.min(v), F.max(v)).first()
    if least is None or least == most:
        return F.lit(0.0)
    return F.coalesce((v / 2 - least / 2) / (most / 2 - least / 2), F.lit(0.0))


def _before(cut: tuple) -> Column:
    """Whether a unit (at, h, piece) lies on the left of the cut."""
    dim, at, h, piece, inclusive = cut
    c, last = F.col("at")[dim], F.col("piece") <= piece if inclusive else F.col("piece") < piece
    return (c < at) | ((c == at) & ((F.col("h") < h) | ((F.col("h") == h) & last)))


def _leaf(cell: Cell, numbers: dict[int, int]) -> Column:
    """The number of the leaf that a unit lies in, by the cuts so far; numbers has that of each leaf by its first shard."""
    if cell.halves:
        return F.when(_before(cell.cut), _leaf(cell.halves[0], numbers)).otherwise(_leaf(cell.halves[1], numbers))
    return F.lit(numbers.get(cell.first)).cast("int")


def _cuts(units: DataFrame, asked: list[dict]) -> None:
    """Find each asked cell's cut: units(node, at, h, piece, w); asked has node, dim, want (bytes to lie on the left) and
    the range of coordinates (clo, chi). Each gets 'cut' and nothing else is kept."""
    spark = units.sparkSession
    schema = "node int, dim int, by_hash boolean, clo double, chi double, hlo long, hhi long"
    for a in asked:
        a |= {"below": 0, "by_hash": False, "hlo": -(1 << 63), "hhi": (1 << 63) - 1}
    open_ = asked
    while open_:
        for a in open_:
            a["by_hash"] = a["by_hash"] or a["clo"] == a["chi"]
        now = spark.createDataFrame([tuple(a[k.split()[0]] for k in schema.split(", ")) for a in open_], schema)
        within = units.join(F.broadcast(now), "node").withColumn("c", F.expr("at[dim]")).where("c between clo and chi and h between hlo and hhi")
        # what is left under one hash is at most the pieces of one group
        lists = [a for a in open_ if a["n"] <= LISTED or a["by_hash"] and float(a["hlo"]) == float(a["hhi"])]
        bins = [a for a in open_ if a not in lists]
        if lists:
            rows = within.where(F.col("node").isin([a["node"] for a in lists])).select("node", "c", "h", "piece", "w").collect()
            for a in lists:
                _choose(a, sorted((r.c, r.h, r.piece, r.w) for r in rows if r.node == a["node"]))
        if bins:
            place = F.expr("if(by_hash, (cast(h as double) - hlo) / (cast(hhi as double) - hlo), (c - clo) / (chi - clo))")
            at = F.least(F.floor(place * BINS), F.lit(BINS - 1)).alias("bin")
            got = within.where(F.col("node").isin([a["node"] for a in bins])).groupBy("node", at)
            got = got.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("c").alias("clo"), F.max("c").alias("chi"), F.min("h").alias("hlo"), F.max("h").alias("hhi")).collect()
            for a in bins:
                own = sorted((r for r in got if r.node == a["node"]), key=lambda r: r.bin)
                for r in own:
                    if a["below"] + r.w >= a["want"] or r is own[-1]:
                        a |= {"n": r.n} | ({"hlo": r.hlo, "hhi": r.hhi} if a["by_hash"] else {"clo": r.clo, "chi": r.chi})
                        break
                    a["below"] += r.w
        open_ = [a for a in open_ if "cut" not in a]


def _choose(a: dict, units: list[tuple]) -> None:
    """The cut between units that leaves the left side's bytes nearest to those wanted."""
    best, held = (abs(a["below"] - a["want"]), (a["dim"], *units[0][:3], False)), a["below"]
    for c, h, piece, w in units:
        held += w
        best = min(best, (abs(held - a["want"]), (a["dim"], c, h, piece, True)), key=lambda x: x[0])
    a["cut"] = best[1]


def grow(units: DataFrame, shards: int, dims: int) -> Cell:
    """The tree over units(at array<double>, h, piece, w): each level splits all cells of more than one shard, a cell of m
    shards at the weight that leaves its left side m // 2 of them, along the dimension in which its units lie widest apart."""
    root = Cell(0, shards)
    leaves = [root]
    while leaves := [c for c in leaves if c.shards > 1]:
        located = units.withColumn("node", _leaf(root, {c.first: i for i, c in enumerate(leaves)})).where("node is not null")
        ends = [f(F.col("at")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        asked = []
        for r in located.groupBy("node").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), *ends).collect():
            dim = max(range(dims), key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"], -d))
            m = leaves[r.node].shards
            asked.append({"node": r.node, "dim": dim, "want": r.w * (m // 2) / m, "n": r.n, "clo": r[f"lo{dim}"], "chi": r[f"hi{dim}"]})
        _cuts(located, asked)
        for a in asked:
            cell = leaves[a["node"]]
            half = cell.shards // 2
            cell.cut, cell.halves = a["cut"], [Cell(cell.first, half), Cell(cell.first + half, cell.shards - half)]
        leaves = [h for c in leaves for h in c.halves]  # a cell without units stays as it is: its shards are empty
    return root


def _placed(docs: DataFrame, shards: int | None, target_bytes: int | None, dims: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, size, text_crc32, shard, slot of every row; key tells rows apart."""
    kinds = dict(docs.dtypes)
    dims = tuple(d for d in dims if d in kinds)
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("row"),
        *[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)],
    )
    rows = stored(read, "rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards if target_bytes is None else max(1, math.ceil(total / target_bytes))
    own = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()
    coordinates = [_coordinate(rows, f"d{i}", kinds[d]) for i, d in enumerate(dims)] or [F.lit(0.0)]
    rows = rows.select("doc_id", "size", "text_crc32", "h", F.col("doc_id" if own else "row").alias("key"), F.array(*coordinates).alias("at"))
    most = max(1, int(total / shards * PIECE))
    groups = rows.groupBy("h").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at")).alias("place"))
    # groups of so many bytes each: at most shards / PIECE of them
    heavy = groups.where((F.col("w") > most) & (F.col("n") > 1)).select("h", F.col("place").alias("group_place"), F.ceil(F.col("w") / most).alias("pieces"))
    pieces = rows.join(F.broadcast(heavy), "h", "left").withColumn("piece", F.coalesce(F.expr("pmod(xxhash64(key), pieces)"), F.lit(0).cast("long")))
    pieces = stored(pieces.select("key", "doc_id", "size", "text_crc32", "h", "piece", F.coalesce("group_place", F.struct("doc_id", "at")).alias("place")), "pieces")
    units = stored(pieces.groupBy("h", "piece").agg(F.sum("size").alias("w"), F.min("place").alias("place")).select("h", "piece", "w", F.col("place.at").alias("at")), "units")
    tree = grow(units, shards, len(coordinates))
    leaf = _leaf(tree, {i: i for i in range(shards)})
    blocks = max(1, math.ceil(n / (shards * BLOCK_ROWS)))
    of_unit = units.select("h", "piece", leaf.alias("shard"))
    dealt = pieces.drop("place").join(of_unit, ["h", "piece"]).withColumn("block", F.expr(f"pmod(xxhash64(key), {blocks}L)"))
    dealt = stored(dealt.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "block").orderBy("key"))), "dealt")
    sizes = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = sizes.select("shard", "block", before.alias("before"))
    return dealt.join(guarded(starts, shards * blocks), ["shard", "block"]).withColumn("slot", (F.col("before") + F.col("nth") - 1).cast("long"))


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards have nearly equal bytes: the tree has as many leaves as shards, or as target_bytes asks for. Within a shard
    slots count from 0 by blocks of a hash of the id and then by id. Dimensions may be of any type; those that docs lacks
    are left out, without any the tree goes by hash. Null metadata count as least. A null text has no bytes and is a copy
    of an empty one. A text longer than a shard's share has a shard, or more than its share of one, to itself. Ties in a
    coordinate are cut by the text's hash; repeated rows are copies and get slots of their own. With repeated or null ids
    rows are told apart by the order in which they are read. An empty table gives no rows; other columns are not read.
    """
    placed = _placed(docs, shards, target_bytes, dims, id_col, text_col)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int | None = 40, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", file_rows: int = 1_000_000) -> None:
    """Write docs, whose ids must be distinct and not null, as Parquet folders shard=0, shard=1, ... under path, with the
    columns shard and slot (which docs must not have) added; each file holds a run of slots in order."""
    if taken := {"shard", "slot"} & set(docs.columns):
        raise ValueError(f"docs has columns of its own named {sorted(taken)}")
    placed = _placed(docs, shards, target_bytes, dims, id_col, text_col)
    if placed.where("doc_id is null or key <> doc_id").limit(1).count():
        raise ValueError(f"{id_col} must be distinct and not null")
    at = placed.select(F.col("doc_id").alias("key"), F.col("shard").cast("int").alias("shard"), "slot")
    keyed = docs.join(at, docs[id_col].cast("long") == at["key"]).drop(at["key"])
    run = F.floor(F.col("slot") / file_rows)
    keyed.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
