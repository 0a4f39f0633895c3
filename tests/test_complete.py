"""Completion at cursors: members after a dot, types elsewhere."""

from symweave.engine import EXTERNAL, Engine
from symweave.sources import workspace

FILES = {
    "/Shape.java": "package p.q;\npublic class Shape {\n  int area() { return 1; }\n  int around() { return 1; }\n  int size;\n}\n",
    "/Use.java": "package p.r;\nimport p.q.Shape;\npublic class Use {\n  void run() {\n    Shape s = new Shape();\n    s.ar();\n    Shape.si();\n    Sha x;\n    none.x();\n  }\n}\n",
}


def test_mode_follows_what_stands_before_the_cursor(spark):
    lib = [("e.x.ShadowBox", "ShadowBox", "e.x", "e.x", "a.jar", False, "Class")]
    engine = Engine(spark, workspace.with_language(spark.createDataFrame(list(FILES.items()), "path string, text string")), spark.createDataFrame(lib, EXTERNAL))
    lines = FILES["/Use.java"].split("\n")
    places = {"member": (5, lines[5].index("ar") + 2), "all": (5, lines[5].index(".") + 1), "type": (6, lines[6].index("si") + 2), "prefix": (7, lines[7].index("Sha") + 3), "none": (8, lines[8].index("x") + 1), "beyond": (99, 3)}
    rows = engine.complete_at(spark.createDataFrame([("/Use.java", *p) for p in places.values()], "file_path string, line int, col int")).collect()
    got = {what: sorted((r.mode, r.name, r.origin, r.rank) for r in rows if (r.line, r.col) == p) for what, p in places.items()}
    assert got["member"] == [("member", "area", "project", 0), ("member", "around", "project", 0)]
    assert got["all"] == [("member", "area", "project", 0), ("member", "around", "project", 0), ("member", "size", "project", 0)]
    assert got["type"] == [("member", "size", "project", 0)]
    assert got["prefix"] == [("prefix", "ShadowBox", "external", 3), ("prefix", "Shape", "project", 2)]
    assert got["none"] == [] and got["beyond"] == []
