import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from symweave.llm import exact_dedup

from .helpers import AWKWARD, docs, empty


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keyed = [m for m in members if m[0] is not None]
        keep = min(keyed, key=lambda m: (-len(m[1]), m[0]))[0] if keyed else None
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs(spark, AWKWARD)).collect()]
    assert sorted(got, key=repr) == brute(AWKWARD)


def test_colliding_hashes_do_not_merge(spark):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs(spark, AWKWARD), hash_fn=lambda c: F.lit(b"same")).collect()]
    assert sorted(got, key=repr) == brute(AWKWARD)


def test_extreme_ids_and_empty_table(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab "), (0, "ab")]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    assert got == {-(2**63): -(2**63), 2**63 - 1: -(2**63), 0: -(2**63)}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(exact_dedup.ORACLE).select("doc_id, keep_id, group_size, kept, text_sha256").fetchall())
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect()) == want


def test_drop_copies_keeps_columns(spark):
    left = exact_dedup.drop_copies(docs(spark, [(1, "a b"), (2, "ab"), (3, "c"), (None, "ab")]))
    assert left.columns == docs(spark, []).columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 3, None]


def test_drop_copies_tells_rows_apart_by_more_than_their_id(spark):
    rows = [(0, "b"), (1, "unique"), (1, "b"), (5, "x y"), (5, "x y"), (5, "xy"), (7, "xy"), (None, "alone"), (None, "b")]
    left = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(docs(spark, rows)).collect()]
    assert sorted(left, key=str) == sorted([(0, "b"), (1, "unique"), (5, "x y"), (None, "alone"), (None, "b")], key=str)
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_only_repeated_hashes_send_their_texts(spark):
    plan = exact_dedup.exact_dedup(docs(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_bitmap_holds_every_key(spark):
    from symweave.llm.common import BIT_WORDS, bit_words, may_hold

    keys = [0, -1, 2**63 - 1, -(2**63), 5, 64 * BIT_WORDS + 7]
    words = bit_words(spark.createDataFrame([(k,) for k in keys], "key long"))
    rows = spark.createDataFrame([(k, "clash") for k in [*keys, 6, 8, -3]], "k long, text string")
    assert sorted(r.k for r in may_hold(rows, "k", words).collect()) == sorted(keys)


def test_columns_with_internal_names_stay(spark):
    for rows in ([(1, "a b"), (2, "ab"), (3, "c")], [(1, "a b"), (2, "ab"), (2, "c")]):
        table = docs(spark, rows).selectExpr("*", "doc_id * 10 as __row", "'kept' as __gone", "text as __ROW_", "0 as stays")
        left = exact_dedup.drop_copies(table)
        assert left.columns == table.columns
        assert sorted((r.doc_id, r["__row"], r["__gone"], r["__ROW_"]) for r in left.collect()) == [(i, 10 * i, "kept", t) for i, t in (rows[0], rows[2])]
