import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from symweave.llm import kdshards, queries

from .helpers import AWKWARD, LONG, docs, empty


def sizes(rows):
    by = defaultdict(int)
    for r in rows:
        by[r["shard"]] += r["size"]
    return by


def held(rows, table, shards):
    """What every result must be: all rows, their sizes and sums, shards in range, slots without gaps."""
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in table)
    want = Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in table)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute(points, shards, first=0):
    """points (coordinates, hash, bytes), copies merged -> {hash: shard} by the same rule over sorted lists."""
    if shards == 1:
        return {h: first for _, h, _ in points}
    if not points:
        return {}
    dims = range(len(points[0][0]))
    widths = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in dims]
    dim = widths.index(max(widths))
    order = sorted(points, key=lambda p: (p[0][dim], p[1]))
    half = shards // 2
    want = sum(p[2] for p in points) * half / shards
    at, best, k = 0, abs(want), 0
    for i, p in enumerate(order):
        at += p[2]
        if abs(at - want) < best:
            best, k = abs(at - want), i + 1
    return brute(order[:k], half, first) | brute(order[k:], shards - half, first + half)


@pytest.mark.parametrize("listed", [1000, 3])
def test_equals_sorted_lists(spark, monkeypatch, listed):
    monkeypatch.setattr(kdshards, "LISTED", listed)
    monkeypatch.setattr(kdshards, "BINS", 4 if listed < 10 else 512)
    draw = random.Random(5)
    rows = [(i, f"text {i} " * draw.randint(1, 9), draw.choice(["en", "de", None]), f"src{draw.randint(0, 5)}", draw.randint(0, 50)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = kdshards.kd_shards(table, shards=7).collect()
    held(got, [r[:2] for r in rows], 7)
    hashes = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    code = {None: 0.0, "de": 0.0, "en": 1.0}
    points = [((code[lang], int(source[3:]) / 5, n / max(r[4] for r in rows)), hashes[i], len(text.encode()) + 16) for i, text, lang, source, n in rows]
    low = min(r[4] for r in rows)
    assert low == 0
    want = brute(points, 7)
    assert {r.doc_id: r.shard for r in got} == {i: want[hashes[i]] for i in hashes}


def test_whole_table(spark, sf):
    got = queries.op12_kd_shards(spark, sf).collect()
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held(got, table, 40)
    by, most = sizes(got), max(r["size"] for r in got)
    mean = sum(by.values()) / 40
    assert max(by.values()) <= mean + most
    text = dict(table)
    small = mean * kdshards.PIECE
    group = Counter(text.values())
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if group[t] * (len(t) + 16) <= small)


def test_a_third_of_all_rows_in_one_group_of_copies(spark):
    rows = [(i, f"some words of document {i}") for i in range(2000)] + [(5000 + i, "copied all over") for i in range(1000)]
    got = kdshards.kd_shards(docs(spark, rows), shards=10).collect()
    held(got, rows, 10)
    by = sizes(got)
    mean = sum(by.values()) / 10
    assert len(by) == 10 and all(abs(b - mean) < 0.05 * mean for b in by.values())
    spread = {r["shard"] for r in got if r["doc_id"] >= 5000}
    assert len(spread) <= 5  # a fourth of the bytes: as many shards as that takes, and one at either end


def test_target_bytes_and_blocks_of_slots(spark, monkeypatch):
    monkeypatch.setattr(kdshards, "BLOCK_ROWS", 7)
    rows = [(i, "x" * 84) for i in range(100)]
    got = kdshards.kd_shards(docs(spark, [(i, f"{t}{i:03}") for i, t in rows]), shards=None, target_bytes=1030, dims=()).collect()
    held(got, [(i, f"{t}{i:03}") for i, t in rows], 10)
    assert all(b == 1030 for b in sizes(got).values())


def test_awkward_rows(spark):
    got = kdshards.kd_shards(docs(spark, AWKWARD), shards=3).collect()
    held(got, AWKWARD, 3)
    assert kdshards.kd_shards(empty(spark)).count() == 0
    one = kdshards.kd_shards(docs(spark, [(1, LONG)]), shards=40).collect()
    assert len(one) == 1 and one[0]["slot"] == 0
    repeats = [(4, "same")] * 50 + [(None, None)] * 50
    held(kdshards.kd_shards(docs(spark, repeats), shards=4).collect(), repeats, 4)


def test_dimensions_of_any_type(spark):
    rows = [(i, f"t{i}", float("nan") if i % 7 == 0 else i / 3, i % 2 == 0, f"common/prefix/{'é' * (i % 3)}{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, f double, b boolean, s string").withColumn("d", F.expr("date_add(date'2020-01-01', cast(doc_id as int))"))
    got = kdshards.kd_shards(table, shards=6, dims=("f", "b", "s", "d", "missing")).collect()
    held(got, [r[:2] for r in rows], 6)
    assert len(sizes(got)) == 6


def test_written_shards_hold_every_document_in_order(spark, tmp_path):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    kdshards.write_shards(docs(spark, rows), str(tmp_path / "out"), shards=5, file_rows=9)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    at = {r.doc_id: (r.shard, r.slot) for r in kdshards.kd_shards(docs(spark, rows), shards=5).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == at
    with pytest.raises(ValueError, match="distinct"):
        kdshards.write_shards(docs(spark, [(1, "a"), (1, "b")]), str(tmp_path / "no"))
    with pytest.raises(ValueError, match="slot"):
        kdshards.write_shards(docs(spark, rows).withColumn("slot", F.lit(0)), str(tmp_path / "no"))
