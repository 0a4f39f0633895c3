"""Closures by doubling, kept up to date, and found together with the names of parents."""

import random

import pytest
from pyspark.sql import functions as F

from symweave.operators import hierarchy, resolve
from symweave.sources.closures import StoredClosure

SCHEMA = "child string, parent string, ordinal int"


def first_ways(edges):
    """child -> ancestor -> the least list of ordinals of all ways that visit no type twice."""
    out = {}
    step = {}
    for c, p, o in edges:
        if p is not None and c != p:
            step.setdefault(c, {})
            step[c][p] = min(o, step[c].get(p, o))

    def go(start, at, path, seen):
        for p, o in step.get(at, {}).items():
            if p not in seen:
                way = [*path, o]
                held = out.setdefault(start, {})
                held[p] = min(way, held.get(p, way))
                go(start, p, way, seen | {p})

    for c in step:
        go(c, c, [], {c})
    return out


def as_dict(df):
    out = {}
    for r in df.collect():
        assert r.depth == len(r.path) and r.ancestor not in out.get(r.child, {})
        out.setdefault(r.child, {})[r.ancestor] = list(r.path)
    return out


def graph(seed, types, edges, cycles=False):
    draw = random.Random(seed)
    rows = []
    for _ in range(edges):
        a, b = draw.randrange(types), draw.randrange(types)
        if not cycles and a <= b:
            a, b = b + 1, a
        rows.append((f"t{a}", f"t{b}" if draw.random() > 0.05 else None, draw.randint(0, 3)))
    return rows


@pytest.mark.parametrize(("seed", "cycles"), [(1, False), (2, False), (3, True), (4, True)])
def test_closure_is_the_least_of_all_simple_ways(spark, seed, cycles):
    edges = graph(seed, 12, 22, cycles)
    held(as_dict(hierarchy.closure(spark.createDataFrame(edges, SCHEMA), 0 if seed % 2 else 1000)), edges, cycles)


def held(got, edges, cycles):
    """The first ways; with cycles, ways to the same ancestors that visit no type twice, and first ones beside the cycles."""
    want = first_ways(edges)
    if not cycles:
        assert got == want
        return
    assert {c: set(up) for c, up in got.items()} == {c: set(up) for c, up in want.items()}
    turning = {c for c, up in want.items() if any(a in want and c2 in want[a] and a in want.get(c2, {}) for a in [c, *up] for c2 in [c, *up])}
    assert all(up == want[c] for c, up in got.items() if c not in turning)
    step = {}
    for c, p, o in edges:
        if p is not None and c != p:
            step.setdefault((c, o), set()).add(p)

    def leads(at, way, to, seen):
        return at == to if not way else any(p not in seen and leads(p, way[1:], to, seen | {p}) for p in step.get((at, way[0]), ()))

    assert all(leads(c, way, a, {c}) for c, up in got.items() for a, way in up.items())


def test_many_ways_and_many_levels(spark):
    ladder = [e for i in range(25) for e in ((f"n{i}", f"l{i}", 0), (f"n{i}", f"r{i}", 1), (f"l{i}", f"n{i + 1}", 0), (f"r{i}", f"n{i + 1}", 0))]
    got = as_dict(hierarchy.closure(spark.createDataFrame(ladder, SCHEMA)))
    assert got["n0"]["n25"] == [0] * 50 and got["n0"]["r24"] == [*[0] * 48, 1] and len(got["n0"]) == 75
    chain = [(f"c{i}", f"c{i + 1}", 0) for i in range(150)]
    got = as_dict(hierarchy.closure(spark.createDataFrame(chain, SCHEMA)))
    assert len(got["c0"]) == 150 and len(got["c0"]["c150"]) == 150


@pytest.mark.parametrize(("seed", "cycles"), [(11, False), (12, True)])
def test_updates_equal_the_closure_anew(spark, tmp_path, seed, cycles):
    draw = random.Random(seed)
    edges = graph(seed, 30, 45, cycles)
    kept = StoredClosure(spark, str(tmp_path / "closure"), buckets=8)
    kept.build(spark.createDataFrame(edges, SCHEMA))
    closed = hierarchy.closure(spark.createDataFrame(edges, SCHEMA))
    for _ in range(2):
        names = draw.sample(sorted({c for c, _, _ in edges}), 4) + ["new"]
        batch = [(n, f"t{draw.randrange(30)}", draw.randint(0, 2)) for n in names[1:] for _ in range(draw.randint(0, 2))]
        if not cycles:
            batch = [(c, p, o) for c, p, o in batch if c == "new" or int(p[1:]) < int(c[1:])]
        edges = [e for e in edges if e[0] not in names] + batch
        now, changed = spark.createDataFrame(edges, SCHEMA), spark.createDataFrame([(n,) for n in names], "child string")
        kept.apply(spark.createDataFrame(batch, SCHEMA), changed)
        closed = hierarchy.updated_closure(closed, now, changed)
        assert as_dict(kept.ways.read()) == as_dict(closed) == as_dict(hierarchy.closure(now))
        held(as_dict(closed), edges, cycles)
        assert {(r.child, r.ancestor) for r in kept.below.read().collect()} == {(c, a) for c, up in first_ways(edges).items() for a in up}


def test_a_batch_reads_what_it_affects_and_can_come_again(spark, tmp_path):
    edges = [(f"leaf{i}", f"mid{i % 40}", 0) for i in range(400)] + [(f"mid{i}", f"top{i % 4}", 0) for i in range(40)]
    kept = StoredClosure(spark, str(tmp_path / "closure"), buckets=128)
    kept.build(spark.createDataFrame(edges, SCHEMA))
    batch, changed = spark.createDataFrame([("mid7", "top0", 0)], SCHEMA), spark.createDataFrame([("mid7",)], "child string")
    broken = kept.ways.publish_buckets
    kept.ways.publish_buckets = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        kept.apply(batch, changed)
    kept.ways.publish_buckets = broken
    done = kept.apply(batch, changed)
    want = [e for e in edges if e[0] != "mid7"] + [("mid7", "top0", 0)]
    assert as_dict(kept.ways.read()) == first_ways(want)
    assert done["below"] == 11 and done["read"] < 60 and done["written"] < 40  # of 3 x 128 buckets
    assert kept.apply(batch, changed, version=kept.version) == {"below": 0, "read": 0, "written": 0}


def test_parents_that_only_inheritance_settles(spark):
    edges = [
        ("p.Base", "Lib", "x.Lib", 0),
        ("p.A", "Base", "p.Base", 0),
        ("p.A#X", "Inner", None, 0),  # p.Base, above p.A, declares one
        ("p.Base#Inner", "Root", "p.Root", 0),
        ("p.B", "X", "p.A#X", 0),
        ("p.B#Y", "Deep", None, 0),  # p.Root declares one, which p.B only reaches once the parent of p.A#X is settled
        ("p.B#Y#Z", "Own", None, 0),  # p.B itself declares one: the scope two levels out
        ("p.B#Y#Z", "Y", None, 1),  # and one of this name, which is around the child
        ("p.C", "Deep", None, 0),  # in no type: nothing inherits into its file
        ("p.A#Q", "Nowhere", None, 0),
    ]
    nested = [("p.Base", "Inner", "p.Base#Inner"), ("p.Root", "Deep", "p.Root#Deep"), ("p.B", "Own", "p.B#Own"), ("p.B", "Y", "p.B#Y"), ("p.Base", "Own", "p.Base#Own"), ("p.A", "X", "p.A#X"), ("p.Other", "Nowhere", "p.Other#Nowhere")]
    scopes = [("p.A#X", "p.A", 1), ("p.A#Q", "p.A", 1), ("p.B#Y", "p.B", 1), ("p.B#Y#Z", "p.B#Y", 1), ("p.B#Y#Z", "p.B", 2)]
    tables = [spark.createDataFrame(*x) for x in ((edges, "child string, name string, parent string, ordinal int"), (nested, "owner string, name string, fqn string"), (scopes, "child string, scope string, level int"))]
    got, closed = hierarchy.joint_closure(*tables)
    parents = {(r.child, r.name): r.parent for r in got.collect()}
    assert {k: v for k, v in parents.items() if (*k, None) in {(c, n, p) for c, n, p, _ in edges}} == {
        ("p.A#X", "Inner"): "p.Base#Inner", ("p.B#Y", "Deep"): "p.Root#Deep", ("p.B#Y#Z", "Own"): "p.B#Own", ("p.B#Y#Z", "Y"): "p.B#Y", ("p.C", "Deep"): None, ("p.A#Q", "Nowhere"): None,
    }
    assert as_dict(closed) == first_ways([(c, parents[c, n], o) for c, n, _, o in edges])


def test_members_that_a_library_class_above_declares(spark):
    reach = spark.createDataFrame([("p.B", "p.B", 0, []), ("p.B", "ext.Base", 1, [0]), ("p.C", "p.C", 0, []), ("p.C", "p.B", 1, [0]), ("p.C", "ext.Base", 2, [0, 0]), ("p.C", "p.I", 1, [1])], "child string, ancestor string, depth int, path array<int>")
    members = spark.createDataFrame([("p.I", "run", "p.I#run"), ("p.B", "own", "p.B#own")], "parent_name string, short_name string, fqn string")
    external = spark.createDataFrame([("ext.Base", "run", "ext.Base#run", True, "a.jar"), ("ext.Base", "run", "ext.Base#run", False, "b.jar"), ("ext.Base", "own", "ext.Base#own", False, "b.jar")], "parent_name string, short_name string, fqn string, needs_decompilation boolean, jar_path string")
    asked = spark.createDataFrame([("p.B", "run"), ("p.C", "run"), ("p.C", "own"), ("ext.Base", "run"), ("p.B", "gone")], "receiver string, method string")
    got = {(r.receiver, r.method): (r.target, r.depth) for r in resolve.resolve_members(asked, reach, members, external).collect()}
    assert got == {("p.B", "run"): ("ext.Base#run", 1), ("p.C", "run"): ("ext.Base#run", 2), ("p.C", "own"): ("p.B#own", 1), ("ext.Base", "run"): ("ext.Base#run", 0)}


def test_engine_finds_what_libraries_and_inner_types_pass_on(spark):
    from symweave.engine import EXTERNAL, Engine
    from symweave.sources import workspace

    files = {
        "/Base.java": "package p.b;\nimport ext.v.Lib;\npublic class Base extends Lib {\n  static class Inner {\n    void deep() { }\n  }\n}\n",
        "/Use.java": "package q.u;\nimport p.b.Base;\npublic class Use extends Base {\n  class Own extends Inner { }\n  void run() {\n    Use u = new Use();\n    u.fromLibrary();\n  }\n}\n",
    }
    lib = [("ext.v.Lib", "Lib", "ext.v", "ext.v", "a.jar", False, "Class"), ("ext.v.Lib#fromLibrary", "fromLibrary", "ext.v", "ext.v.Lib", "a.jar", False, "Function")]
    engine = Engine(spark, workspace.with_language(spark.createDataFrame(list(files.items()), "path string, text string")), spark.createDataFrame(lib, EXTERNAL))
    line = files["/Use.java"].split("\n")[6]
    cursors = spark.createDataFrame([("/Use.java", 6, line.index("fromLibrary"))], "file_path string, line int, col int")
    assert [(r.target, r.origin) for r in engine.definition(cursors).collect()] == [("ext.v.Lib#fromLibrary", "external")]
    reach = {(r.child, r.ancestor) for r in engine.reach.collect()}
    assert ("q.u.Use", "ext.v.Lib") in reach and ("q.u.Use#Own", "p.b.Base#Inner") in reach
    assert not engine.diagnostics().where(F.col("code") == "method_not_found").count()
