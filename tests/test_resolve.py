import re

from symweave.operators import diagnostics, lookups, maintain, rank, requests, resolve

SYMBOLS = "fqn string, short_name string, package_name string, parent_name string, file_path string, language string, kind string, modifiers array<string>, param_types array<string>, return_type string"


def symbols(spark, rows):
    full = [(f, f.replace("#", ".").rpartition(".")[2], f.rpartition(".")[0], f.rpartition("#")[0] or f.rpartition(".")[0], f"/{f}", "java", kind, mods, params, ret) for f, kind, mods, params, ret in rows]
    return spark.createDataFrame(full, SYMBOLS)


def external(spark, rows):
    return spark.createDataFrame([(f, f.replace("#", ".").rpartition(".")[2], f.rpartition(".")[0], f.rpartition("#")[0], j, d, "Class") for f, j, d in rows], "fqn string, short_name string, package_name string, parent_name string, jar_path string, needs_decompilation boolean, kind string")


def test_resolution_order(spark):
    own = symbols(spark, [("me.Near", "Class", [], None, None), ("wild.Seen", "Class", [], None, None)])
    ext = external(spark, [("java.lang.String", "jdk", False), ("wild.Near", "w", False)])
    imports = spark.createDataFrame([("f", 0, "java.lang.*", True), ("f", 1, "a.Named", False), ("f", 2, "b.Named", False), ("f", 3, "wild.*", True)], "file_path string, ordinal int, import_text string, is_wildcard boolean")
    refs = spark.createDataFrame([("f", "me", n) for n in ("x.y.Z", "Named", "String", "Near", "Seen", "Nowhere")], "file_path string, package_name string, name string")
    got = {r.name: (r.fqn, r.priority) for r in resolve.resolve_fqn(refs, imports, own, ext).collect()}
    # wildcard imports come before the own package, unlike in the language itself
    assert got == {"x.y.Z": ("x.y.Z", 1), "Named": ("a.Named", 2), "String": ("java.lang.String", 3), "Near": ("wild.Near", 3), "Seen": ("wild.Seen", 3), "Nowhere": ("me.Nowhere", 4)}
    strict = {r.name for r in resolve.resolve_fqn(refs, imports, own, ext, strict=True).collect()}
    assert strict == set(got) - {"Nowhere"}
    assert {r.name: r.fqn for r in resolve.resolve_by_import(refs, imports).collect()} == {"x.y.Z": None, "Named": "a.Named", "String": None, "Near": None, "Seen": None, "Nowhere": None}


def test_members_by_inheritance_accessor_and_library(spark):
    members = symbols(spark, [("p.A#own", "Function", [], [], None), ("p.B#own", "Function", [], [], None), ("p.B#getName", "Function", [], [], None), ("p.C#name", "Field", [], None, None), ("p.B#isOn", "Function", [], [], None)])
    reach = spark.createDataFrame([("p.A", "p.A", 0, []), ("p.A", "p.B", 1, [0]), ("p.A", "p.C", 2, [0, 0])], "child string, ancestor string, depth int, path array<int>")
    asked = spark.createDataFrame([("p.A", m) for m in ("own", "name", "on", "none")] + [("ext.L", "x")], "receiver string, method string")
    ext = external(spark, [("ext.L#x", "l1.jar", True), ("ext.L#x", "l0.jar", False)])
    got = {(r.receiver, r.method): r.target for r in resolve.resolve_members(asked, reach, members, ext).collect()}
    assert got == {("p.A", "own"): "p.A#own", ("p.A", "name"): "p.B#getName", ("p.A", "on"): "p.B#isOn", ("ext.L", "x"): "ext.L#x"}


def test_overload_selection(spark):
    members = symbols(spark, [("p.A#f", "Function", [], ["int"], None), ("p.A#f", "Function", [], ["String"], None), ("p.A#f", "Function", [], ["int", "int"], None)])
    sites = spark.createDataFrame([(1, "p.A", "f", 1, ["String"]), (2, "p.A", "f", 2, ["x", "y"]), (3, "p.A", "f", 1, ["Other"]), (4, "p.A", "f", 0, [])], "site int, receiver string, method string, argc int, arg_types array<string>")
    got = {r.site: (r.n, r.chosen) for r in resolve.select_overload(sites, members, ["site"]).collect()}
    assert got == {1: (2, "String"), 2: (1, "int,int"), 3: (2, None)}


def test_prefix_search_quirks(spark):
    types = symbols(spark, [("com.x.JavaService", "Class", [], None, None), ("com.x.Javas", "Class", [], None, None), ("javas.Thing", "Class", [], None, None), ("javas.Thing#m", "Function", [], [], None)])
    # the prefix is capitalised and lower-cased, so JavaS finds Javas but not JavaService
    assert {r.fqn for r in lookups.prefix_search(types, "JavaS").collect()} == {"com.x.Javas", "javas.Thing"}
    many = spark.createDataFrame([(f"p.T{i:04d}", "Class", [], None, None) for i in range(300)], "f string, k string, m array<string>, p array<string>, r string")
    assert lookups.prefix_search(symbols(spark, [tuple(r) for r in many.collect()]), "p.").count() == 100
    plan = lookups.prefix_search(spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("p_name as fqn", "p_brand as short_name", "p_type as kind", "p_name as file_path"), "red")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,red)" in plan


def test_null_parameters_are_not_callable(spark):
    members = symbols(spark, [("p.A#f", "Field", [], None, None), ("p.A#f", "Function", [], [], None)])
    sites = spark.createDataFrame([(1, "p.A", "f", 0)], "site int, receiver string, method string, argc int")
    assert resolve.by_arity(sites, members).count() == 1


def test_replace_by_file_is_idempotent_and_whole(spark):
    old = spark.createDataFrame([("a", f"s{i}", 0) for i in range(1500)] + [("b", "t", 0)], "file_path string, fqn string, v int")
    batch = spark.createDataFrame([("a", f"s{i}", 1) for i in range(1200)] + [("a", "s1", 2)], "file_path string, fqn string, v int")
    once = maintain.replace_by_file(old, batch, ["file_path", "fqn"], ["v"])
    twice = maintain.replace_by_file(once, batch, ["file_path", "fqn"], ["v"])
    assert once.count() == 1201 and sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_deleting_a_jar_takes_its_edges(spark):
    ext = external(spark, [("a.X", "j1", False), ("a.Y", "j1", False), ("a.Y", "j2", False)])
    edges = spark.createDataFrame([("a.X", "P", None), ("a.Y", "P", None)], "symbol_fqn string, super_short_name string, super_fqn string")
    left, kept = maintain.delete_jars(ext, edges, spark.createDataFrame([("j1",)], "jar_path string"))
    assert [r.fqn for r in left.collect()] == ["a.Y"] and [r.symbol_fqn for r in kept.collect()] == ["a.Y"]


def test_full_reindex_decision():
    assert not maintain.needs_full_reindex(True, True, True, "2", "2")
    assert maintain.needs_full_reindex(True, True, True, "1", "2") and maintain.needs_full_reindex(True, False, True, "2", "2") and maintain.needs_full_reindex(True, True, True, None, "2")


def test_first_group_keeps_all_rows_of_the_first_source(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (2, "w")], "k int, v string")
    assert sorted((r.k, r.v) for r in rank.first_group(["k"], a, b).collect()) == [(1, "x"), (1, "y"), (2, "w")]


def test_spans_contain_both_ends(spark):
    hits = spark.createDataFrame([("f", 1, c) for c in (4, 5, 9, 10)] + [("g", 1, 6)], "file_path string, line int, col int")
    spans = spark.createDataFrame([("f", 1, 5, 1, 9)], "file_path string, s_line int, s_col int, e_line int, e_col int")
    assert sorted((r.file_path, r.col) for r in requests.outside_spans(hits, spans).collect()) == [("f", 4), ("f", 10), ("g", 6)]


def test_signature_variables_agree_with_anything(spark):
    df = spark.createDataFrame([(["String"], ["T"]), (["String"], ["int"]), ([], []), (["a"], [])], "c array<string>, p array<string>")
    assert [r[0] for r in df.select(diagnostics.implements(df.c, df.p)).collect()] == [True, False, True, False]


def test_arguments_of_unknown_kind_are_let_pass(spark):
    members = symbols(spark, [("p.A#f", "Function", [], ["int"], None)])
    sites = spark.createDataFrame([(1, "p.A", "f", ["string_literal"]), (2, "p.A", "f", ["identifier"]), (3, "p.A", "f", ["int_literal"]), (4, "p.A", "f", ["null_literal"])], "site int, receiver string, method string, arg_kinds array<string>")
    assert {r.site for r in diagnostics.wrong_argument_types(sites, members, ["site"]).collect()} == {1, 4}


def test_exploded_fields_are_not_broadcast(spark):
    """Fields exploded from few rows look few to Spark, and a million types' fields would go through the driver."""
    asked = spark.range(3).selectExpr("concat('T', id) as type_fqn", "explode(array('m', 'isle', '', 'x', cast(null as string))) as field")
    rows = [("T0", "getM"), ("T0", "isM"), ("T1", "isM"), ("T1", "get"), ("T2", "isIsle"), ("T2", "getx"), ("T2", "m")]
    members = spark.createDataFrame([(t, n, f"{t}#{n}", "Function") for t, n in rows] + [("T2", "getM", "T2#getM", "Field")], "parent_name string, short_name string, fqn string, kind string")
    got = resolve.property_accessors(asked, members)
    assert sorted((r.type_fqn, r.field, r.accessor) for r in got.collect()) == [("T0", "m", "getM"), ("T1", "", "get"), ("T1", "m", "isM"), ("T2", "isle", "isIsle")]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_names_are_resolved_by_file_number_without_a_shuffle_of_references(spark):
    """Where files have numbers and the names are at hand, references and imports are shuffled to their files and no further."""
    refs = spark.createDataFrame([(1, "p", "A"), (1, "p", "B"), (1, "p", "C"), (1, "p", "D"), (2, "q", "A"), (2, "q", "x.Y"), (2, None, "C"), (1, "p", None)], "k long, package_name string, name string").repartition("k")
    lines = [(1, 5, "z.B", False), (1, 4, "y.B", False), (1, 9, "w.*", True), (1, 8, "v.*", True), (2, 1, "w.*", True), (2, 2, "z.D", False)]
    imports = spark.createDataFrame(lines, "k long, ordinal long, import_text string, is_wildcard boolean").repartition("k")
    known = symbols(spark, [("w.C", "Class", [], None, None), ("v.C", "Class", [], None, None), ("p.A", "Class", [], None, None)])
    names = refs.select("name").where("name is not null")
    for strict, rest in ((True, []), (False, [(1, "D", "p.D", 4), (2, "A", "q.A", 4)])):
        got = resolve.resolve_fqn(refs, imports, known, external(spark, [("w.Z", "j", False)]), strict, "k", names)
        want = [(1, "A", "p.A", 4), (1, "B", "y.B", 2), (1, "C", "v.C", 3), (2, "C", "w.C", 3), (2, "x.Y", "x.Y", 1), *rest]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k#" in plan and not re.search(r"hashpartitioning\(k#\d+L?, name#", plan)
