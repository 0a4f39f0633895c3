import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from symweave.operators import hierarchy


def walk(edges, start):
    """Depth-first with a visited set, parents in order of their ordinals: ancestors in the order they are met."""
    out, seen = [], {start}

    def go(node):
        for _, parent in sorted((o, p) for c, p, o in edges if c == node):
            if parent not in seen:
                seen.add(parent)
                out.append(parent)
                go(parent)

    go(start)
    return out


def closed(spark, edges, recursive_edges=100):
    rows = hierarchy.closure(spark.createDataFrame(edges, "child string, parent string, ordinal int"), recursive_edges).collect()
    got = {}
    for r in sorted(rows, key=lambda r: list(r.path)):
        got.setdefault(r.child, []).append(r.ancestor)
    return got


@pytest.mark.parametrize("recursive", [0, 100])
def test_grandparent_by_the_first_parent_comes_before_the_second_parent(spark, recursive):
    edges = [("A", "B", 0), ("A", "C", 1), ("B", "D", 0), ("C", "D", 0), ("D", "E", 0)]
    assert closed(spark, edges, recursive)["A"] == ["B", "D", "E", "C"]


@pytest.mark.parametrize("recursive", [0, 100])
def test_cycles_end(spark, recursive):
    edges = [("A", "B", 0), ("B", "C", 0), ("C", "D", 0), ("D", "B", 0), ("A", "A", 1), ("X", None, 0)]
    got = closed(spark, edges, recursive)
    assert got["A"] == ["B", "C", "D"] and got["B"] == ["C", "D"] and "X" not in got


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=10))
def test_closure_is_depth_first_order_of_trees_and_reaches_all(spark, pairs):
    edges = [(f"n{a}", f"n{b}", i) for i, (a, b) in enumerate(dict.fromkeys(pairs)) if a != b] or [("n0", "n1", 0)]
    got = closed(spark, edges)
    assert got == closed(spark, edges, 0)
    for c, _, _ in edges:
        assert set(got[c]) == set(walk(edges, c))


def test_more_levels_than_a_recursive_query_has(spark):
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "3")
    try:
        edges = [(f"n{i}", f"n{i + 1}", 0) for i in range(6)]
        assert closed(spark, edges, 1000)["n0"] == ["n1", "n2", "n3", "n4", "n5", "n6"]
    finally:
        spark.conf.unset("spark.sql.cteRecursionLevelLimit")


def test_component(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("y", "x"), ("z", None)], "child string, parent string")
    assert {r.fqn: r.component for r in hierarchy.component(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_required_methods_of_interfaces_and_abstract_classes(spark):
    types = spark.createDataFrame([("p.I", "Interface"), ("p.C", "Class")], "fqn string, kind string")
    schema = "fqn string, short_name string, parent_name string, kind string, modifiers array<string>, param_types array<string>"
    rows = [("p.I#a", "a", "p.I", "Function", [], []), ("p.I#b", "b", "p.I", "Function", ["default"], []), ("p.I#c", "c", "p.I", "Function", ["static"], []), ("p.C#d", "d", "p.C", "Function", ["abstract"], []), ("p.C#e", "e", "p.C", "Function", [], []), ("p.I#F", "F", "p.I", "Field", [], None)]
    assert {r.short_name for r in hierarchy.required_methods(types, spark.createDataFrame(rows, schema)).collect()} == {"a", "d"}


MEMBERS = "fqn string, short_name string, parent_name string, kind string, modifiers array<string>, param_types array<string>, return_type string"


def test_members_of_libraries_and_fields_are_inherited(spark):
    from symweave.operators import diagnostics, lookups

    own = spark.createDataFrame([("p.B#own", "own", "p.B", "Function", [], [], "int"), ("p.P#f", "f", "p.P", "Field", [], None, "int"), ("p.B#size", "size", "p.B", "Function", [], [], "String")], MEMBERS)
    lib = spark.createDataFrame([("e.Base#run", "run", "e.Base", "a.jar", True, "Function", "void"), ("e.Base#run", "run", "e.Base", "a-sources.jar", False, "Function", "void"), ("e.Base#size", "size", "e.Base", "a.jar", False, "Function", "int"), ("e.Base", "Base", "e", "a.jar", False, "Class", None)], "fqn string, short_name string, parent_name string, jar_path string, needs_decompilation boolean, kind string, return_type string")
    both = lookups.with_external(own, lib)
    assert sorted(r.fqn for r in both.collect()) == ["e.Base#run", "e.Base#size", "p.B#own", "p.B#size", "p.P#f"]
    closed = hierarchy.closure(spark.createDataFrame([("p.B", "p.P", 0), ("p.B", "e.Base", 1)], "child string, parent string, ordinal int"))
    types = spark.createDataFrame([("p.B",), ("p.P",)], "fqn string")
    reach = hierarchy.with_self(closed, types)
    assert {r.name for r in hierarchy.reachable_names(reach, both).where("type_fqn = 'p.B'").collect()} == {"own", "size", "f", "run"}
    sites = spark.createDataFrame([(i, "java", "p.B", m) for i, m in enumerate(("own", "f", "run", "absent", "toString"))], "i int, language string, receiver string, method string")
    assert [r.method for r in diagnostics.method_not_found(sites, reach, both, types).collect()] == ["absent"]
    wrong = diagnostics.override_incompatible(both, closed).collect()
    assert [(r.type_fqn, r.name, r.own_return, r.from_fqn, r.return_type) for r in wrong] == [("p.B", "size", "String", "e.Base", "int")]


def test_levels_keep_one_table(spark):
    chain = [(f"n{i}", f"n{i + 1}", 0) for i in range(9)]
    assert closed(spark, chain, 0) == closed(spark, chain, 100)
