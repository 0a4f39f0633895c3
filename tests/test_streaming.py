import pytest
from pyspark.sql import functions as F

from symweave.schema import SYMBOLS
from symweave.sources.store import BucketedTable, VersionedTable
from symweave.streaming import changes as ch

SCHEMA = "uri string, kind string, version long, text string"


def code(name, body="int x;"):
    return f"package p.q; class {name} {{ {body} }}"


def test_latest_and_live(spark):
    df = spark.createDataFrame([("/a.java", "open", 1, "x"), ("/a.java", "change", 3, "z"), ("/a.java", "change", 2, "y"), ("/b.java", "open", 1, "x"), ("/b.java", "close", 2, None)], SCHEMA)
    assert {(r.uri, r.text) for r in ch.live_buffers(df).collect()} == {("/a.java", "z")}


def test_routes(spark):
    df = spark.createDataFrame([("/a.java", "watched", 1, None), ("/o.java", "watched", 1, None), ("/w/build.gradle", "watched", 1, None), ("/d.java", "delete", 1, None)], SCHEMA)
    got = {r.uri: r.route for r in ch.route(df, spark.createDataFrame([("/o.java",)], "uri string")).collect()}
    assert got == {"/a.java": "reindex", "/o.java": "skip_open", "/w/build.gradle": "build", "/d.java": "delete"}


def test_stream_keeps_the_index(spark, tmp_path):
    feed, store = tmp_path / "feed", tmp_path / "index"
    batches = [
        [("/A.java", "open", 1, code("A")), ("/B.java", "open", 1, code("B"))],
        [("/A.java", "change", 2, code("A", "int y; void f() {}")), ("/A.java", "change", 3, code("A", "int z;")), ("/B.java", "delete", 4, None)],
    ]
    state = {"path": None}

    def read():
        return spark.read.schema(SYMBOLS).parquet(state["path"]) if state["path"] else spark.createDataFrame([], SYMBOLS)

    def publish(table, batch_id):
        path = f"{store}/v={batch_id}"
        table.write.mode("overwrite").parquet(path)
        state["path"] = path

    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
        stream = spark.readStream.schema(SCHEMA).parquet(str(feed))
        ch.maintain_index(stream, read, publish, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.fully_qualified_name for r in read().collect()} == {"p.q.A", "p.q.A#z"}


def test_bucketed_upkeep_rewrites_what_a_batch_touches(spark, tmp_path):
    feed, path = tmp_path / "feed", str(tmp_path / "index")
    files = [(f"/F{i}.java", "open", 1, code(f"F{i}")) for i in range(12)]
    batches = [files, [("/F1.java", "change", 2, code("F1", "int z;"))], [("/F2.java", "delete", 3, None)]]
    states = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(feed))
        stream = spark.readStream.schema(SCHEMA).parquet(str(feed))
        table = BucketedTable(spark, path, SYMBOLS, "file_path", 4, ["fully_qualified_name"])  # as after a restart
        ch.maintain_buckets(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
        states.append(table._pointer()["parts"])
    moved = [b for b, v in states[1].items() if v != states[0].get(b)]
    assert [int(b) for b in moved] == table.touched(spark.createDataFrame([("/F1.java",)], "file_path string"))
    expected = {r.fully_qualified_name for r in ch.apply_batch(spark.createDataFrame([], SYMBOLS), spark.createDataFrame([r for b in batches for r in b], SCHEMA)).collect()}
    got = [r.fully_qualified_name for r in table.read().collect()]
    assert "p.q.F1#z" in got and "p.q.F2" not in got and "p.q.F11" in got
    assert len(got) == len(expected) and set(got) == expected


def test_bucketed_table_empties_and_refuses(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, n long")
    table = BucketedTable(spark, str(tmp_path / "t"), rows.schema, "k", 8)
    assert table.read().isEmpty() and table.publish(rows) == 0
    assert sorted(r.n for r in table.read().collect()) == [1, 2, 3, 4]
    table.publish_buckets(rows.limit(0), table.touched(spark.createDataFrame([("a",)], "k string")), note="x")
    left = {r.n for r in table.read().collect()}
    assert not left & {1, 2} and table.stamps == {"note": "x"} and table.version == 1
    with pytest.raises(ValueError):
        table.publish(rows, 1)
    with pytest.raises(ValueError):
        BucketedTable(spark, str(tmp_path / "t"), rows.schema, "k", 9)


def test_vacuum_keeps_what_is_needed(spark, tmp_path):
    rows = spark.createDataFrame([(k, 1) for k in "abcdef"], "k string, n long")
    whole = VersionedTable(spark, str(tmp_path / "w"), rows.schema)
    parts = BucketedTable(spark, str(tmp_path / "b"), rows.schema, "k", 4)
    one = parts.touched(spark.createDataFrame([("a",)], "k string"))
    assert whole.vacuum() == [] and parts.vacuum() == []
    for n in range(4):
        whole.publish(rows)
        parts.publish_buckets(rows if n == 0 else parts.read(one).withColumn("n", F.col("n") + 1), list(range(4)) if n == 0 else one)
    assert whole.vacuum() == ["v=0", "v=1"] and whole.read().count() == 6
    before = sorted(parts.read().collect())
    assert parts.vacuum() == [f"v=0/__bucket={one[0]}", "v=1"] and sorted(parts.read().collect()) == before
    assert whole.vacuum() == [] and parts.vacuum() == []


def test_bursts_close_after_the_watermark(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:20"), ("a", "2024-01-01 00:02:00"), ("b", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "uri string, t string").select("uri", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uri string, ts timestamp").parquet(str(tmp_path / "in"))
    q = ch.bursts(stream, "30 seconds", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.uri, r.n) for r in spark.table("bursts").collect()) == [("a", 1), ("a", 2)]
