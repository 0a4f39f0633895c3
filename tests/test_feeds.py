"""Keyed state with timers, requests that wait, a changelog of diagnostics, and inputs that cannot be taken."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.sources.quarantine import Quarantine
from symweave.sources.store import VersionedTable
from symweave.streaming import barrier, ttl
from symweave.streaming.diagnostics import SAID, DiagnosticsFeed, accumulated


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_buffers_go_after_a_while_without_reads_and_their_state_with_them(spark, tmp_path):
    held = []

    def feed(*reads):
        spark.createDataFrame([(u, at(m)) for u, m in reads], "uri string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("uri string, ts timestamp").parquet(str(tmp_path / "in"))
        run = ttl.with_ttl(stream, 30 * 60_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination()
        held.append(run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
        return spark.read.parquet(str(tmp_path / "out"))

    feed(("a", 0), ("b", 10), ("a", 20), (None, 20), ("c", 25))
    assert {r.uri for r in ttl.evicted(feed(("d", 45))).collect()} == {"b"}  # a and c were read less than thirty minutes before
    out = feed(("b", 70), ("d", 71))
    assert {(r.uri, r.last) for r in ttl.evicted(out).collect()} == {("a", at(20)), ("c", at(25))}  # b was read again
    assert {(r.uri, r.n) for r in out.where("not evicted").groupBy("uri").agg(F.count("*").alias("n")).collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 1)}
    assert held == [3, 3, 2]


def test_requests_are_answered_once_and_not_before_their_version(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, wants long")
    waiting = VersionedTable(spark, str(tmp_path / "waiting"), schema)
    version, answers = [3], {}

    def ask(*requests, lose=False):
        spark.createDataFrame(list(requests), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def answer(rows, batch_id):
            answers[batch_id] = sorted(r.id for r in rows.collect())
            if lose:
                raise RuntimeError("lost")

        run = barrier.answer_when_ready(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: version[0], answer, waiting, str(tmp_path / "checkpoint"))
        try:
            run.awaitTermination()
        except Exception as e:
            assert lose and "lost" in str(e)

    ask((1, 2), (2, 3), (3, 4), (4, 9), (5, None))
    assert answers == {0: [1, 2]}
    version[0] = 4
    ask((6, 1), lose=True)  # breaks off after answering, runs again under the same number
    ask((7, 5))
    assert answers == {0: [1, 2], 1: [3, 6], 2: []} and sorted(r.id for r in waiting.read().collect()) == [4, 7]
    version[0] = 9
    ask((None, None))
    assert answers[3] == [4, 7] and waiting.read().count() == 0


def test_a_changelog_takes_back_what_no_longer_holds(spark, tmp_path):
    feed = DiagnosticsFeed(spark, str(tmp_path / "feed"), buckets=4)
    bad, worse, good = ("package p.q;\n" + b for b in ("class X { int n = \"text\"; }", "import a.Unused;\nclass X { int n = \"text\"; }", "class X { }"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, kind string, version long, text string")
    holds = lambda: {(r.path, r.code) for r in accumulated(feed.changelog()).collect()}
    feed.apply(batch(("/A.java", "open", 1, bad), ("/B.java", "open", 2, bad), ("/B.java", "change", 3, good), ("/C.java", "open", 1, None)), 0)
    assert holds() == {("/A.java", "type_mismatch_assignment")}
    feed.apply(batch(("/A.java", "change", 5, worse), ("/B.java", "change", 2, bad)), 1)  # the second is older than what is known
    assert holds() == {("/A.java", "type_mismatch_assignment"), ("/A.java", "unused_import")}
    feed.apply(batch(("/A.java", "change", 5, worse), ("/A.java", "close", 6, None), ("/B.java", "change", 9, bad)), 2)
    feed.apply(batch(("/B.java", "change", 99, good)), 2)  # was published, is not applied again
    assert holds() == {("/B.java", "type_mismatch_assignment")}
    signs = feed.changelog().groupBy("batch").agg(F.sort_array(F.collect_list("sign")).alias("s")).collect()
    assert {r.batch: r.s for r in signs} == {0: [1], 1: [-1, 1, 1], 2: [-1, -1, 1]} and feed.changelog().columns == [*SAID, "sign", "batch"]


def test_what_cannot_be_taken_waits_with_its_reason(spark, tmp_path):
    kept = Quarantine(spark, str(tmp_path / "quarantine"), buckets=4)
    refuse = ["bad"]

    def take(inputs):
        broken = F.col("text").isNull() | F.col("text").contains(refuse[0])
        return inputs.where(~broken), inputs.where(broken).select("path", F.when(F.col("text").isNull(), "no text").otherwise("parser").alias("reason"))

    offer = lambda n, *rows, gone=None: sorted(r.path for r in kept.offer(spark.createDataFrame(list(rows), "path string, text string"), take, n, gone).collect())
    assert offer(0, ("/a", "good"), ("/b", "bad"), ("/c", None), (None, "good"), ("/d", "bad too")) == ["/a"]
    assert {(r.path, r.reason, r.attempts) for r in kept.waiting().collect()} == {("/b", "parser", 1), ("/c", "no text", 1), (None, "no path", 1), ("/d", "parser", 1)}
    assert offer(1, ("/b", "mended"), gone=spark.createDataFrame([("/c",)], "path string")) == ["/b"]
    assert {(r.path, r.batch, r.attempts) for r in kept.waiting().collect()} == {("/d", 1, 2), (None, 0, 1)}
    refuse[0] = "never"
    assert offer(2, ("/e", "fine"))[:1] == ["/d"] and kept.waiting().count() == 1
