import pytest

from symweave.engine import EXTERNAL, Engine
from symweave.sources import workspace

FILES = {
    "/Shape.java": "package p.q;\npublic interface Shape {\n  double area(int scale);\n}\n",
    "/Root.java": "package p.q;\npublic abstract class Root {\n  private void hidden() { }\n  static void shared() { }\n  String label() { return \"x\"; }\n}\n",
    "/Last.java": "package p.q;\npublic final class Last extends Root implements Shape {\n  public double area(int scale) { return 1.0; }\n}\n",
    "/Bad.java": "package p.q;\nimport x.y.Gone;\npublic class Bad extends Last implements Shape {\n  Gone gone;\n  int label() { return 1; }\n  void run() {\n    Root r = new Root();\n    r.hidden();\n    r.shared();\n    r.absent();\n    r.label();\n    Last last = null;\n    last.area(\"no\");\n  }\n}\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    files = workspace.with_language(spark.createDataFrame(list(FILES.items()), "path string, text string"))
    return Engine(spark, files)


def at(path, line, needle):
    return (path, line, FILES[path].split("\n")[line].index(needle))


def cursors(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, line int, col int")


def test_definition_hover_and_implementations(spark, engine):
    c = cursors(spark, at("/Bad.java", 10, "label"), at("/Bad.java", 6, "Root"), at("/Last.java", 1, "Shape"))
    got = {(r.file_path, r.line): (r.target, r.target_file) for r in engine.locations(c).collect()}
    assert got == {("/Bad.java", 10): ("p.q.Root#label", "/Root.java"), ("/Bad.java", 6): ("p.q.Root", "/Root.java"), ("/Last.java", 1): ("p.q.Shape", "/Shape.java")}
    hover = {r.line: r.markdown for r in engine.hover(c).collect()}
    assert hover[10] == "```java\npackage p.q\n\nString label()\n```" and "public abstract class Root" in hover[6]
    impl = {r.target for r in engine.implementations(cursors(spark, at("/Last.java", 1, "Shape"))).collect()}
    assert impl == {"p.q.Last", "p.q.Bad"}


def test_references_and_rename(spark, engine):
    c = cursors(spark, at("/Root.java", 1, "Root"))
    want = {("/Root.java", 1), ("/Last.java", 1), ("/Bad.java", 6)}
    assert {(r.file_path, r.line) for r in engine.references(c).collect()} == want
    edits = engine.rename(c, "Base").collect()
    assert {(e.file_path, e.line) for e in edits} == want and all(e.new_text == "Base" for e in edits) and len(edits) == 4
    assert engine.rename(c, "class").count() == 0
    local = engine.rename(cursors(spark, at("/Bad.java", 8, "r.")), "other").collect()
    assert {(e.file_path, e.line) for e in local} == {("/Bad.java", n) for n in (6, 7, 8, 9, 10)}


def test_diagnostics(engine):
    got = {(r.file_path, r.code, r.line) for r in engine.diagnostics().collect()}
    assert {
        ("/Bad.java", "unresolved_symbol", 3),
        ("/Bad.java", "final_class_extended", 2),
        ("/Bad.java", "unimplemented_abstract_methods", 2),
        ("/Bad.java", "abstract_class_instantiated", 6),
        ("/Bad.java", "inaccessible_member", 7),
        ("/Bad.java", "static_member_via_instance", 8),
        ("/Bad.java", "method_not_found", 9),
        ("/Bad.java", "wrong_argument_types", 12),
        ("/Bad.java", "override_incompatible_signature", 2),
    } == got


MORE = {
    "/Top.java": "package p.q;\ninterface Top {\n  int go(int a);\n}\n",
    "/Mid.java": "package p.q;\nclass Mid implements Top {\n  private int size;\n  Mid(int size) { this.size = size; }\n  int getSize() { return size; }\n  public int go(int a) { return a; }\n  public int go() { return 1; }\n}\n",
    "/Far.java": "package p.q;\nclass Far {\n  int go(int a) { return a; }\n}\n",
    "/Use.java": "package p.q; import lib.Pair;\nclass Use {\n  void run(Top top, long wide) {\n    Mid mid = new Mid(3);\n    top.go(1);\n    mid.getSize();\n    int slim = wide;\n    long same = wide;\n    Pair<Mid> odd = null;\n    Pair<Mid, Top> even = new Pair<>();\n  }\n}\n",
}


@pytest.fixture(scope="module")
def more(spark):
    """Sources do not say how many parameters a type has; class files do."""
    library = spark.createDataFrame([("lib.Pair", "Pair", "lib", "lib", "/lib.jar", True, "Class", 2)], EXTERNAL + ", n_type_params int")
    return Engine(spark, workspace.with_language(spark.createDataFrame(list(MORE.items()), "path string, text string")), library)


def edits_of(spark, engine, path, line, col, name):
    return {(e.file_path, e.line, e.new_text) for e in engine.rename(cursors(spark, (path, line, col)), name).collect()}


def test_rename_goes_by_kind(spark, more):
    assert edits_of(spark, more, "/Mid.java", 1, 7, "Core") == {("/Mid.java", 1, "Core"), ("/Mid.java", 3, "Core"), ("/Use.java", 3, "Core"), ("/Use.java", 8, "Core"), ("/Use.java", 9, "Core")}
    hierarchy = edits_of(spark, more, "/Top.java", 2, 7, "walk")
    assert {("/Top.java", 2, "walk"), ("/Mid.java", 5, "walk"), ("/Use.java", 4, "walk")} <= hierarchy and not any(p == "/Far.java" for p, _, _ in hierarchy)
    field = edits_of(spark, more, "/Mid.java", 2, 15, "extent")
    assert {("/Mid.java", 2, "extent"), ("/Mid.java", 4, "getExtent"), ("/Use.java", 5, "getExtent")} <= field
    assert edits_of(spark, more, "/Use.java", 6, 16, "broad") == {("/Use.java", n, "broad") for n in (2, 6, 7)}
    assert edits_of(spark, more, "/Top.java", 2, 7, "class") == set()


def test_type_arguments_and_narrowing(more):
    got = {(r.code, r.line) for r in more.diagnostics().where("file_path = '/Use.java'").collect()}
    assert got == {("wrong_type_argument_count", 8), ("narrowing_conversion", 6)}


def test_completion(spark, engine):
    offers = {r.fqn: r.rank for r in engine.complete(spark.createDataFrame([("la", "p.q")], "prefix string, package_name string")).collect()}
    assert offers == {"p.q.Last": 1}
    members = {r.short_name for r in engine.complete_members(spark.createDataFrame([("p.q.Root", [])], "receiver string, jars array<string>")).collect()}
    assert members == {"hidden", "shared", "label"}
