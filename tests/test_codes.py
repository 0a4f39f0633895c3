"""The mixed hierarchy on numbers of types, and closures of large graphs, whose lower types are set aside."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from symweave.durable import stored
from symweave.operators import hierarchy
from symweave.plans import queries
from symweave.universe import Universe
from tests.test_joint import SCHEMA, as_dict, graph, held


@pytest.mark.parametrize(("seed", "cycles"), [(21, False), (23, True)])
def test_types_set_aside_get_all_first_ways(spark, seed, cycles):
    edges = graph(seed, 12, 22, cycles) + [(f"leaf{i}", f"t{i % 12}", i % 3) for i in range(30)] + [(f"leaf{i}", "t3", 2) for i in range(20)] + [(f"low{i}", f"leaf{i}", 0) for i in range(9)]
    held(as_dict(hierarchy.closure(spark.createDataFrame(edges, SCHEMA), peeled_rows=0)), edges, cycles)


def test_names_settle_alike_where_types_are_set_aside(spark):
    edges = [("A", "B", "B", 0), ("B", "C", "C", 0), ("A#X", "Y", None, 0), ("B#Y", "Z", None, 0), ("C#Z", "D", "D", 1), ("D", "E", "E", 0), ("E#W", "Q", None, 0), ("F", "X", "A#X", 0), ("G", "F", "F", 0), ("G#V", "W", None, 1)]
    frame = spark.createDataFrame([*edges, ("F#T", "W", None, 0)], "child string, name string, parent string, ordinal int")
    nested = spark.createDataFrame([(x.partition("#")[0], x.partition("#")[2], x) for x in ("A#X", "B#Y", "C#Z", "E#W", "G#V", "F#T")], "owner string, name string, fqn string")
    scopes = nested.selectExpr("fqn as child", "owner as scope", "1 as level")
    found, closed = hierarchy.joint_closure(frame, nested, scopes, peeled_rows=0)
    got = {(r.child, r.name): r.parent for r in found.collect()}
    assert len(got) == 11 and got["A#X", "Y"] == "B#Y" and got["B#Y", "Z"] == "C#Z" and got["E#W", "Q"] is None
    # F inherits E's types by A#X, B#Y, C#Z and D, which three rounds find out
    assert got["F#T", "W"] == got["G#V", "W"] == "E#W"
    ways = as_dict(closed)
    assert ways["G"]["E"] == [0, 0, 0, 0, 1, 0] and ways["G#V"] == {"E#W": [1]} and ways["F"]["C#Z"] == [0, 0, 0]


def test_numbers_give_what_texts_give(spark, sf, monkeypatch):
    of = lambda: [sorted(map(str, f(Universe(spark, sf)).collect())) for f in (queries.parents_by_context_and_inheritance, queries.closure_of_resolved_parents, queries.definition_below_libraries)]
    assert Universe(spark, sf).coded
    coded = of()
    monkeypatch.setattr(Universe, "coded", False)
    assert coded == of() and all(coded)


def test_numbers_are_not_taken_where_they_do_not_tell(spark, sf, tmp_path):
    for name, table, change in (("lib", "part", ("p_name", "l ib")), ("twice", "supplier", ("s_suppkey", 3)), ("nowhere", "supplier", ("s_nationkey", None))):
        os.makedirs(tmp_path / name)
        for t in ("part", "supplier", "lineitem"):
            rows = pq.read_table(f"{sf}/{t}.parquet")
            if t == table:
                at = rows.schema.get_field_index(change[0])
                rows = rows.set_column(at, rows.schema.field(at), pa.array([change[1], *rows.column(at).to_pylist()[1:]], rows.schema.field(at).type))
            pq.write_table(rows, tmp_path / name / f"{t}.parquet")
        assert not Universe(spark, str(tmp_path / name)).coded


def test_what_was_shuffled_goes_when_it_is_stored(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    assert stored(spark.range(1000).selectExpr("id % 500 as a").groupBy("a").count(), "groups").count() == 500
    assert tracker.shuffleStatuses().size() <= before + 1  # that of the count
