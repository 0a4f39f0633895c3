"""Reports of steps and streams, emptied tables, and signatures that count as one."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.engine import Engine
from symweave.operators import requests
from symweave.progress import Progress, StreamProgress
from symweave.sources import workspace
from symweave.sources.store import BucketedTable, VersionedTable


def test_steps_report_what_their_jobs_counted(spark):
    rows = []
    progress = Progress(rows.append)
    files = spark.createDataFrame([("/A.java", "package p.q;\nclass A { }"), ("/B.java", "class {")], "path string, text string")
    engine = Engine(spark, workspace.with_language(files), progress=progress)
    assert engine.symbols.count() == 1
    assert [(r["step"], r["event"]) for r in rows] == [("parse", "begin"), ("parse", "report"), ("parse", "end")]
    assert rows[1] == {"step": "parse", "event": "report", "what": "files", "rows": 2, "errors": 0} and rows[2]["failed"] is None
    with pytest.raises(ValueError), progress.step("broken") as step:
        step.counted(spark.range(3), "numbers")
        raise ValueError
    assert [r["event"] for r in rows[3:]] == ["begin", "end"] and rows[-1]["failed"] == "ValueError"
    with progress.step("sum") as step:
        step.counted(spark.range(5), "numbers", most=F.max("id")).collect()
    assert rows[-2] == {"step": "sum", "event": "report", "what": "numbers", "rows": 5, "most": 4}


def test_streams_report_begin_batches_and_end(spark, tmp_path):
    rows = []
    listener = StreamProgress(rows.append)
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        run = stream.writeStream.queryName("counting").foreachBatch(lambda batch, i: batch.count() and None).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    mine = [r for r in rows if r["step"] == "counting"]
    assert mine[0]["event"] == "begin" and mine[-1]["event"] == "end" and mine[-1]["failed"] is None
    assert sum(r["rows"] for r in mine if r["event"] == "report") == 7


def test_emptied_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType())])
    for table in (VersionedTable(spark, str(tmp_path / "a"), schema), BucketedTable(spark, str(tmp_path / "b"), schema, "k", 4)):
        table.publish(spark.range(9).withColumnRenamed("id", "k"))
        assert table.truncate(revision="r2") == 1
        assert table.read().count() == 0 and table.stamps == {"revision": "r2"}


def test_variable_arguments_are_arrays_and_unknown_parameters_alike(spark):
    schema = "fqn string, parent_name string, short_name string, kind string, param_types array<string>"
    members = spark.createDataFrame([("a#f", "a", "f", "Function", ["String..."]), ("b#f", "b", "f", "Function", ["String[]"]), ("b#g", "b", "g", "Function", None), ("a#g", "a", "g", "Function", None), ("b#g", "b", "g", "Function", []), ("c#f", "c", "f", "Function", ["String[]"])], schema)
    components = spark.createDataFrame([("a", "a"), ("b", "a")], "fqn string, component string")
    got = requests.hierarchy_functions(members.where("parent_name = 'a'"), components, members)
    assert sorted((r.fqn, r.param_types) for r in got.collect()) == [("a#f", ["String..."]), ("a#g", None), ("b#f", ["String[]"]), ("b#g", None)]
