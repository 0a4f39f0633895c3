"""Private library types, parents known by their short names alone, and what library parents require."""

import io
import zipfile

from pyspark.sql import functions as F

from symweave.operators import diagnostics, hierarchy
from symweave.sources import archive


def test_children_of_private_types_go_to_the_type_around(spark):
    source = "package p.q; public class A { private static class B { public static class C { private class D { void low() { } } void mid() { } } int f; private int g; } void top() { } }"
    hidden = "package p.q; private class H { class I { void run() { } } }"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("p/q/A.java", source)
        z.writestr("p/q/H.java", hidden)
    jars = spark.createDataFrame([("/repo/x-sources.jar", None, buffer.getvalue())], "jar_path string, alt_jar_path string, content binary")
    symbols = archive.scan_jars(jars, private_types=True).select(F.explode("symbols").alias("s")).select("s.*").withColumnsRenamed({"fully_qualified_name": "fqn", "symbol_type": "kind"})
    got = {r.fqn: r.parent_name for r in hierarchy.without_private(symbols.select("jar_path", "fqn", "short_name", "parent_name", "kind", "modifiers")).collect()}
    assert got == {"p.q.A": "p.q", "p.q.A#C": "p.q.A", "p.q.A#C#low": "p.q.A#C", "p.q.A#C#mid": "p.q.A#C", "p.q.A#f": "p.q.A", "p.q.A#top": "p.q.A", "p.q.I": "p.q", "p.q.I#run": "p.q.I"}
    plain = {s.fully_qualified_name for r in archive.scan_jars(jars).collect() for s in r.symbols}
    assert "p.q.A#B" not in plain and "p.q.A#B#C" in plain


def test_short_names_give_edges_only_where_one_type_in_sight_has_them(spark):
    edges = [("p.A", "Base", None), ("p.B", "Two", None), ("p.C", "Far", None), ("p.D", "Base", None), ("p.E", "Up", "r.Up"), ("p.E", "Near", None)]
    types = [("p.Base", "Base", "p"), ("q.Base", "Base", "q"), ("p.Two", "Two", "p"), ("q.Two", "Two", "q"), ("z.Far", "Far", "z"), ("r.Near", "Near", "r"), ("r.Up", "Up", "r")]
    packages = [("p.A", "p"), ("p.B", "p"), ("p.B", "q"), ("p.C", "p"), ("p.D", "q"), ("p.D", "q"), ("p.E", "p")]
    got = hierarchy.loose_edges(spark.createDataFrame(edges, "child string, name string, parent string"), spark.createDataFrame(types, "fqn string, short_name string, package_name string"), spark.createDataFrame(packages, "child string, package string"))
    assert {(r.child, r.parent) for r in got.collect()} == {("p.A", "p.Base"), ("p.D", "q.Base"), ("p.E", "r.Up"), ("p.E", "r.Near")}


def test_library_parents_require_their_methods(spark):
    types = spark.createDataFrame([("p.A", "Class", []), ("p.B", "Class", ["abstract"])], "fqn string, kind string, modifiers array<string>")
    supers = spark.createDataFrame([("p.A", "ext.I"), ("p.B", "ext.I")], "symbol_fqn string, super_fqn string")
    members = [("p.A", "one", "Function", [], ["int"]), ("ext.I", "one", "Function", [], ["int"]), ("ext.I", "two", "Function", [], []), ("ext.I", "own", "Function", ["default"], []), ("ext.I", "unknown", "Function", None, None)]
    members = spark.createDataFrame(members, "parent_name string, short_name string, kind string, modifiers array<string>, param_types array<string>")
    parents = types.select("fqn", "kind").unionByName(spark.createDataFrame([("ext.I", "Interface")], "fqn string, kind string"))
    assert [tuple(r) for r in diagnostics.unimplemented_methods(types, supers, members, parents).collect()] == [("p.A", "ext.I", "two", [])]
    assert diagnostics.unimplemented_methods(types, supers, members).count() == 0
