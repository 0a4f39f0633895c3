"""SimHash near-duplicates through the generalised pigeonhole principle.

64 fingerprint bits are dealt into partitions that hold correlated bits; a dynamic programme gives each
partition its own threshold t_i >= -1 with sum(t_i) = k - m + 1, so that two fingerprints at distance
<= k agree within t_i on at least one partition i. Each partition is probed by masks (t_i bits wiped),
candidates are verified on all 64 bits, and only spanning edges leave a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import guarded, map_texts, stored, with_row_key, without_rows
from .components import connected_components

#: Fingerprints that the partition planner looks at; it steers cost only, never results.
PLAN_SAMPLE = 20_000
#: Fingerprints of a bucket that one task compares; larger buckets are dealt into blocks, every pair of blocks is compared.
BLOCK = 4_096
#: Runs up to this length are compared by vectorised shifts, longer ones by frontier search.
SHORT_RUN = 64

_CHUNK = 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n < 1:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = (ends - np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """(doc_id long, key long, fp long): the row's id and key (its id unless told), the fingerprint's bits as a signed number."""

    def make():
        def call(batch: pa.RecordBatch, texts: list[str]) -> dict:
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            return {"doc_id": batch.column(0), "key": batch.column(1), "fp": pa.array(fp)}

        return call

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(key or id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return map_texts(read, make, "doc_id long, key long, fp long")


# ---- planning -------------------------------------------------------------------------------------------


def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """Deal 64 bit positions into m groups of near-equal size, the most correlated bits together."""
    if len(bits) > 1:
        dev = bits - bits.mean(axis=0)
        std = dev.std(axis=0)
        corr = np.abs(dev.T @ dev / len(bits)) / np.maximum(np.outer(std, std), 1e-9)
    else:
        corr = np.eye(64)
    free, out = set(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, out))) // (m - g)
        seed = max(free, key=lambda b: (sum(corr[b, c] for c in free), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """costs[i][t + 1] is the cost of threshold t (from -1) in partition i; the cheapest thresholds that sum to total."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picks) in best.items():
            for j, x in enumerate(row):
                key = s + j - 1
                if key not in nxt or c + x < nxt[key][0]:
                    nxt[key] = (c + x, [*picks, j - 1])
        best = nxt
    return best[total]


def plan(sample: np.ndarray, population: int, k: int = 4, sizes: tuple[int, ...] = (2, 3, 4, 5)) -> list[int]:
    """Masks to probe, as unsigned numbers. sample: uint64 fingerprints that stand for the population."""
    bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) if len(sample) else np.zeros((0, 64))
    scale = (population / max(1, len(sample))) ** 2 / 2
    best: tuple[float, list[int]] | None = None
    for m in sizes:
        groups = _groups(bits, m)
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            part = sample & mask
            row = [0.0]
            for t in range(k + 1):
                probes = comb(len(g), t)
                if not probes:
                    row.append(float("inf"))
                    continue
                # candidates: pairs that meet in a bucket, estimated on a few probes; each probe also costs a row
                some = list(islice(combinations(g, t), 0, None, max(1, probes // 3)))[:3]
                pairs = 0.0
                for p in some:
                    counts = np.unique(part & ~np.uint64(sum(1 << b for b in p)), return_counts=True)[1].astype(np.float64) if len(part) else np.zeros(0)
                    pairs += float((counts * (counts - 1)).sum())
                row.append(pairs / len(some) * probes * scale + 40.0 * probes * population)
            costs.append(row)
        cost, picks = allocate(costs, k - m + 1)
        if best is None or cost < best[0]:
            masks = [sum(1 << b for b in g) & ~sum(1 << b for b in p) for g, t in zip(groups, picks) if t >= 0 for p in combinations(g, t)]
            best = (cost, masks)
    return best[1]


# ---- comparing ------------------------------------------------------------------------------------------


class _Forest:
    """Union-find over the fingerprints of one batch; gives star edges to the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        out = [(x, self.find(x)) for x in list(self.up)]
        out = [(x, r) for x, r in out if x != r]
        return [x for x, _ in out], [r for _, r in out]


def _long_run(v: np.ndarray, k: int, forest: _Forest) -> None:
    """Frontier search: every reached fingerprint is compared with those not yet reached, so a dense group costs little."""
    rest = np.unique(v)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        queue = [seed]
        while queue and len(rest):
            p = queue.pop()
            near = np.bitwise_count(rest ^ p) <= k
            if near.any():
                new = rest[near]
                rest = rest[~near]
                for x in new.tolist():
                    forest.join(int(seed), x)
                queue.extend(new)


def _compare(key_change: np.ndarray, v: np.ndarray, k: int, forest: _Forest) -> None:
    """v: fingerprints in runs; key_change: where each run begins (ascending, first is 0)."""
    ends = np.append(key_change[1:], len(v))
    length = ends - key_change
    for i in np.flatnonzero(length > SHORT_RUN):
        _long_run(v[key_change[i] : ends[i]], k, forest)
    stop = np.repeat(np.where(length > SHORT_RUN, 0, ends), length)
    at = np.arange(len(v))
    for d in range(1, SHORT_RUN):
        at = at[at + d < stop[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(v[at] ^ v[at + d]) <= k]
        for x, y in zip(v[near].tolist(), v[near + d].tolist()):
            forest.join(x, y)


def link_buckets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, val, i, j) with fp -> star edges (a, b) among fingerprints of a bucket within k bits."""

    def flush(keys: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        forest = _Forest()
        if len(v):
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
            _compare(starts, v, k, forest)
        a, b = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    held_k, held_v = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
        keys, v = np.concatenate([held_k, np.stack(cols[:4], axis=1)]), np.concatenate([held_v, cols[4].view(np.uint64)])
        if not len(v):
            continue
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0  # the last run may go on
        yield flush(keys[:cut], v[:cut])
        held_k, held_v = keys[cut:], v[cut:]
    yield flush(held_k, held_v)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(nodes: DataFrame, k: int = 4, block: int = BLOCK) -> DataFrame:
    """nodes(fp long, distinct) -> star edges (a, b) whose components are those of all pairs within k bits."""
    n = nodes.count()
    share = min(1.0, PLAN_SAMPLE / max(1, n))
    seen = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in plan(seen, n, k)])
    signed = nodes.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp")
    hot = stored(signed.groupBy("mask", "val").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block), "hot")
    n_hot = hot.count()
    if n_hot:
        # a bucket beyond the block size is dealt into blocks; each pair of blocks meets in its own key
        parts = F.ceil(F.col("size") / block).cast("long")
        mine = F.pmod(F.xxhash64("fp"), parts)
        other = F.explode(F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1)))
        dealt = signed.join(guarded(hot, n_hot), ["mask", "val"], "left").select("mask", "val", "fp", F.coalesce(mine, F.lit(0)).alias("mine"), other.alias("other"))
        rows = dealt.select("mask", "val", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    else:
        rows = signed.select("mask", "val", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "fp")
    key = ["mask", "val", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda b: link_buckets(b, k), "a long, b long")


def _classed(docs: DataFrame, id_col: str, text_col: str, k: int, block: int, key: str) -> DataFrame:
    """(doc_id, key, fp, component_id) of every row."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"))
    rows = stored(fingerprints(named, "id", "text", "key"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(near_links(nodes.select("fp"), k, block))
    linked = stored(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "first", "root"), "linked")
    tops = linked.groupBy("root").agg(F.min("first").alias("top"))
    of = linked.join(tops, "root").select(F.col("fp").alias("node"), "top")
    ids = stored(nodes.join(of, nodes["fp"] == of["node"], "left").select(F.col("fp").alias("node"), F.coalesce("top", "first").alias("component_id")), "classes")
    return rows.join(ids, rows["fp"] == ids["node"]).select("doc_id", "key", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Fingerprints link at k or fewer differing bits; equal ones always link. Null and empty texts have the
    fingerprint zero; a text of any length is shingled whole. A null id is never a component's id while another
    member has one. Repeated rows give repeated results. An empty table gives no rows; other columns of docs are
    not read.
    """
    rows = _classed(docs, id_col, text_col, k, block, id_col)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """docs with one document of each component: the one with the smallest id. All columns stay.

    Of several rows of a component that share the smallest id one stays; a text of another component stays
    whatever id it shares. Rows without an id stay.
    """
    names = docs.columns
    docs, key = with_row_key(docs, id_col)
    rows = _classed(docs, id_col, text_col, k, BLOCK, key)
    if key == id_col:
        gone = rows.where("doc_id <> component_id").select("key")
    else:
        rows = stored(rows, "classed")
        stays = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("key").alias("stays"))
        gone = rows.where("doc_id is not null").join(stays, "component_id").where("key <> stays").select("key")
    return without_rows(docs, gone, key).select(*names)
