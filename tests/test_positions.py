import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.functions import strings
from symweave.operators import hierarchy, positions
from symweave.sources import workspace
from symweave.sources.store import VersionedTable

FILES = {
    "/Base.java": "package p.q;\npublic class Base {\n  public Item item() { return null; }\n}\n",
    "/Item.java": "package p.q;\npublic class Item { public String name() { return null; } }\n",
    "/Use.java": "package p.q;\nimport x.y.Lib;\npublic class Use extends Base {\n  void run(int n) {\n    Use other = new Use();\n    other.item();\n    int m = n;\n    Lib lib = null;\n    lib.go();\n    if (m > n) { long k = m; int n2 = n; }\n  }\n  void next(int n) { n = n + 1; this.n = n; }\n}\n",
}


@pytest.fixture(scope="module")
def world(spark):
    files = workspace.with_language(spark.createDataFrame(list(FILES.items()), "path string, text string"))
    parsed = workspace.parse(files)
    symbols = workspace.lookup_view(workspace.symbols(parsed))
    imports = workspace.facts(parsed, "imports").select(F.col("path").alias("file_path"), "ordinal", "import_text", "is_wildcard")
    external = spark.createDataFrame([("x.y.Lib", "Lib", "x.y", "x.y", "l.jar", False, "Class"), ("x.y.Lib#go", "go", "x.y", "x.y.Lib", "l.jar", False, "Function")], "fqn string, short_name string, package_name string, parent_name string, jar_path string, needs_decompilation boolean, kind string")
    closed = hierarchy.closure(spark.createDataFrame([("p.q.Use", "p.q.Base", 0)], "child string, parent string, ordinal int"))
    return parsed, imports, symbols, external, hierarchy.with_self(closed, symbols.where("kind = 'Class'")), symbols.where("kind in ('Function', 'Field')")


def cursor(line, needle, nth=0, path="/Use.java"):
    row, at = FILES[path].split("\n")[line], -1
    for _ in range(nth + 1):
        at = row.index(needle, at + 1)
    return (path, line, at)


def test_symbol_at_position(spark, world):
    parsed, imports, symbols, external, reach, members = world
    want = {
        cursor(2, "Base"): ("project", "p.q.Base"),
        cursor(4, "Use"): ("project", "p.q.Use"),
        cursor(5, "item"): ("project", "p.q.Base#item"),  # inherited, through the variable's type
        cursor(5, "other"): ("local", "/Use.java:4:8"),
        cursor(8, "go"): ("external", "x.y.Lib#go"),
        cursor(7, "Lib"): ("external", "x.y.Lib"),
    }
    at = spark.createDataFrame(list(want), "file_path string, line int, col int")
    got = {(r.file_path, r.line, r.col): (r.origin, r.target) for r in positions.symbols_at(at, parsed, imports, symbols, external, reach, members).collect()}
    assert got == want


def test_local_references_know_their_scope(spark, world):
    parsed = world[0]
    at = spark.createDataFrame([cursor(6, "n", 1)], "file_path string, line int, col int")
    got = {(r.line, r.col) for r in positions.local_references(at, parsed).collect()}
    assert all(line < 11 for line, _ in got) and {cursor(6, "n", 1)[1:], cursor(9, "n)")[1:]} <= got


def test_narrowing_candidates(world):
    rows = workspace.facts(world[0], "narrowing").collect()
    assert ("int", "n") in {(r.declared_type, r.rhs_name) for r in rows} and ("long", "m") in {(r.declared_type, r.rhs_name) for r in rows}


def test_identifiers_and_offsets(spark):
    df = spark.createDataFrame([("ok_1", "java"), ("class", "java"), ("def", "groovy"), ("def", "java"), ("1a", "java"), ("é", "kotlin"), ("fun", "kotlin"), ("x\n", "java"), (None, "java")], "n string, g string")
    assert [r[0] for r in df.select(strings.is_valid_identifier(F.col("n"), F.col("g"))).collect()] == [True, False, False, True, False, False, False, False, False]
    text = spark.createDataFrame([("aé\n日本x\n", 1, 2), ("ab", 0, 1), ("ab\nc", 1, 9)], "t string, l int, c int")
    assert [r[0] for r in text.select(strings.byte_offset(F.col("t"), F.col("l"), F.col("c"))).collect()] == [10, 1, 4]


def test_versions_swap_whole(spark, tmp_path):
    schema = T.StructType([T.StructField("fqn", T.StringType()), T.StructField("v", T.IntegerType())])
    table = VersionedTable(spark, str(tmp_path / "t"), schema, ["fqn"])
    assert table.version == -1 and table.read().count() == 0 and table.stamps == {}
    table.publish(spark.createDataFrame([("a", 1)], schema), revision="r1")
    table.publish(table.read().unionByName(spark.createDataFrame([("b", 2)], schema)), revision="r2")
    assert table.version == 1 and {r.fqn for r in table.read().collect()} == {"a", "b"} and table.stamps == {"revision": "r2"}
    with pytest.raises(ValueError):
        table.publish(table.read(), version=1)


def test_edits_come_in_order_of_place(spark):
    from symweave.operators import requests

    rows = [("/b", 2, 1, "x"), ("/a", 10, 3, "x"), ("/a", 2, 9, "x"), ("/a", 2, 9, "x"), ("/a", 2, 1, "y")]
    df = spark.createDataFrame(rows, "file_path string, line int, col int, new_text string")
    assert [tuple(r) for r in requests.edits(df, df).collect()] == [("/a", 2, 1, "y"), ("/a", 2, 9, "x"), ("/a", 10, 3, "x"), ("/b", 2, 1, "x")]


def test_folders_are_left_out_below_the_root_only(spark, tmp_path):
    from symweave.engine import Engine
    from symweave.sources import workspace

    root = tmp_path / "build" / "proj"
    for name in ("src/A.java", "build/B.java", "x/out/C.kt", "output/D.groovy"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("class A { }")
    got = {r.path.removeprefix(f"{root}/") for r in workspace.scan_workspace(spark, str(root)).collect()}
    assert got == {"src/A.java", "output/D.groovy"}
    buffers = spark.createDataFrame([(f"{root}/src/A.java", "class B { }"), (f"{root}/target/E.java", "class E { }")], "path string, text string")
    engine = Engine.of_workspace(spark, str(root), buffers=buffers)
    assert {r.text for r in engine.files.collect()} == {"class B { }", "class A { }"}


def test_packages_of_the_jdk_that_are_read():
    from symweave.sources.archive import wanted

    jar = "/opt/jdk/lib/src.zip"
    assert all(wanted(jar, f"java.base/{p}/X.java") for p in ("java/lang", "java/nio/file", "java/time", "java/text")) and wanted(jar, "java.sql/java/sql/Date.java")
    assert not wanted(jar, "java.desktop/javax/swing/JFrame.java") and wanted("/lib/a.jar", "javax/swing/JFrame.class")


def test_prefixes_as_data_equal_single_searches(spark):
    from symweave.operators import lookups

    names = [f"com.{p}.{s}{i}" for p in ("red", "r", "blue") for s in ("Red", "Re", "Blue", "r") for i in range(60)]
    symbols = spark.createDataFrame([(n, n.rpartition(".")[2], n.rpartition(".")[0], "Class") for n in names] + [("com.red.Red1#m", "m", "com.red", "Function")], "fqn string, short_name string, package_name string, kind string")
    prefixes = ["com", "com.r", "reD", "b", "zzz", "com.red.Red59", ""]
    many = lookups.prefix_search_many(symbols, spark.createDataFrame([(p,) for p in prefixes], "prefix string")).collect()
    for p in prefixes:
        assert {(r.fqn, r.probe) for r in many if r.prefix == p} == {(r.fqn, r.probe) for r in lookups.prefix_search(symbols, p).collect()}, p
    assert lookups.prefix_search_many(symbols, spark.createDataFrame([], "prefix string")).count() == 0
