"""Golden cases for the extraction of the three languages."""

import pytest

from symweave.sources import workspace
from symweave.sources.parse import facts_of

GROOVY = """package com.acme

import groovy.transform.CompileStatic

/** A person. */
@CompileStatic
class Person extends Base implements Named {
    String name
    private int age = 3

    String greet(String other, int times = 2) {
        def text = "hi ${other}"
        return text.toUpperCase()
    }
}
"""

KOTLIN = """package com.acme

data class User(
    val name: String,
    val job: String = "none",
    count: Int
) : Base(), Repo<User> {
    override fun find(id: Long): User? = null
    val size: Int
        get() = 3
}
"""

JAVA = """package com.acme.core;

import java.util.List;
import static java.util.Map.entry;

public abstract class Service<T> implements Repo<T> {
    private static final int MAX = 5, MIN = 1;
    enum Mode { ON, OFF; int code() { return 1; } }
    public Service(int n) { this.n = n; }
    /** Finds it. */
    protected abstract List<T> find(String key, int... more) throws Exception;
    @Override public String toString() { Helper h = new Helper(MAX); return h.name(1, "x").trim(); }
}
"""


def by_name(f):
    return {s["fully_qualified_name"]: s for s in f["symbols"]}


def test_groovy_class():
    f = facts_of("/a.groovy", GROOVY, "groovy")
    s = by_name(f)
    assert f["error"] is None and f["package"] == "com.acme" and not f["diagnostics"]
    c = s["com.acme.Person"]
    assert (c["symbol_type"], c["parent_name"], c["modifiers"]) == ("Class", "com.acme", [])
    assert (c["line_start"], c["char_start"], c["line_end"], c["char_end"]) == (4, 0, 14, 1)  # doc and annotation lie inside
    assert (c["ident_line_start"], c["ident_char_start"], c["ident_char_end"]) == (6, 6, 12)
    assert c["metadata"]["annotations"] == ["CompileStatic"] and c["metadata"]["documentation"] == "A person." and c["metadata"]["parameters"] is None
    assert s["com.acme.Person#name"]["metadata"]["return_type"] == "String" and s["com.acme.Person#age"]["modifiers"] == ["private"]
    g = s["com.acme.Person#greet"]["metadata"]
    assert g["return_type"] == "String" and g["parameters"] == [{"name": "other", "type_name": "String", "default_value": None}, {"name": "times", "type_name": "int", "default_value": "2"}]
    assert {(x["super_short_name"], x["super_fqn"]) for x in f["supers"]} == {("Base", None), ("Named", None)}
    assert ("text", "toUpperCase") in {(c["receiver"], c["method"]) for c in f["calls"]}


def test_kotlin_data_class():
    f = facts_of("/a.kt", KOTLIN, "kotlin")
    s = by_name(f)
    c = s["com.acme.User"]
    assert c["modifiers"] == ["data"] and (c["ident_line_start"], c["ident_char_start"], c["ident_char_end"]) == (2, 11, 15)
    assert [p["name"] for p in c["metadata"]["parameters"]] == ["val name", "val job", "count"] and c["metadata"]["parameters"][1]["default_value"] == '"none"'
    n = s["com.acme.User#name"]
    assert (n["symbol_type"], n["modifiers"], n["metadata"]["return_type"]) == ("Field", ["val"], "String")
    assert (n["line_start"], n["char_start"], n["char_end"], n["ident_char_start"], n["ident_char_end"]) == (3, 4, 20, 8, 12)
    assert s["com.acme.User#find"]["modifiers"] == ["override"] and s["com.acme.User#find"]["metadata"]["return_type"] == "User?"
    assert "com.acme.User#count" not in s and "com.acme.User#size" in s
    assert {x["super_short_name"] for x in f["supers"]} == {"Base", "Repo"}
    assert f["overrides"][0]["method"] == "find"


def test_java_class():
    f = facts_of("/a.java", JAVA, "java")
    s = by_name(f)
    assert f["error"] is None
    assert s["com.acme.core.Service"]["modifiers"] == ["public", "abstract"]
    assert {"com.acme.core.Service#MAX", "com.acme.core.Service#MIN", "com.acme.core.Service#find", "com.acme.core.Service#Mode", "com.acme.core.Service#Mode#code"} <= set(s)
    assert s["com.acme.core.Service#MIN"]["modifiers"] == ["private", "static", "final"]
    find = s["com.acme.core.Service#find"]
    assert find["metadata"]["parameters"][1]["type_name"] == "int..." and find["metadata"]["documentation"] == "Finds it." and find["metadata"]["return_type"] == "List<T>"
    assert "com.acme.core.Service#Service" not in s
    assert ("Helper", 11) in {(c["type_name"], c["line"]) for c in f["creations"]}
    call = next(c for c in f["calls"] if c["method"] == "name")
    assert call["receiver"] == "h" and [a["kind"] for a in call["args"]] == ["int", "string"]
    assert next(c for c in f["calls"] if c["method"] == "trim")["receiver"] == "h#name"
    assert [i["raw"] for i in f["imports"] if not i["is_implicit"]] == ["java.util.List", "static java.util.Map.entry"]
    assert ("h", "Helper") in {(d["name"], d["type_name"]) for d in f["scope_decls"]}


def test_names_nest_by_kind():
    f = facts_of("/a.java", "package p.q; class A { void m() { class Local { int x; } } interface B { void n(); } }", "java")
    assert {"p.q.A", "p.q.A#m", "p.q.A#m.Local", "p.q.A#m.Local#x", "p.q.A#B", "p.q.A#B#n"} == set(by_name(f))


def test_packages():
    assert facts_of("/a.java", "class A { int x; }", "java")["symbols"] == []
    assert facts_of("/a.java", "package one; class A { }", "java")["symbols"] == []  # one segment is only recognised in Kotlin
    assert list(by_name(facts_of("/a.kt", "package one\nclass A", "kotlin"))) == ["one.A"]
    assert sorted(by_name(facts_of("/a.kt", "package one.two\nclass A { fun f() = 1 }\nfun top(x: Int): Int = x", "kotlin"))) == ["one.two.A", "one.two.A#f", "one.two.top"]


@pytest.mark.parametrize(
    "language, body, code",
    [
        ("java", "import a.B;\nimport a.B;\nclass X { B b; }", "duplicate_import"),
        ("java", "import a.B; class X { }", "unused_import"),
        ("kotlin", "import a.B as C\nclass X { val c: C? = null }", None),
        ("kotlin", "import a.B as C\nclass X { val c: B? = null }", "unused_import"),
        ("java", "class X { int f() { g(); } }", "missing_return_statement"),
        ("java", "class X { int f() { run(() -> { return 1; }); } }", "missing_return_statement"),
        ("java", "class X { int f() { if (a) { return 1; } } void g() { } int h(); }", None),
        ("kotlin", "class X { fun f(): Int { throw E() }\nfun g(): Int = 3\nfun h() { } }", None),
        ("kotlin", "class X { fun f(): Int { g() } }", "missing_return_statement"),
        ("java", "class X { void f(int a) { } void f(int b) { } }", "duplicate_method_signature"),
        ("groovy", "class X { void f(int a) { }\n void f(String b) { } }", None),
        ("java", "class X { void f(Object o) { x = (List<String>) o; } }", "unchecked_cast"),
        ("kotlin", "class X { fun f(o: Any) { g(o as List<String>) } }", "unchecked_cast"),
        ("java", "class X { void f(Object o) { x = (String) o; } }", None),
        ("java", "class X { void f() { int n; use(n); } }", "variable_used_before_assignment"),
        ("java", "class X { void f() { int n; n = 1; use(n); } }", None),
        ("java", "class X { void f() { int n; if (a) { n = 1; } use(n); } }", None),
        ("java", 'class X { int n = "a"; }', "type_mismatch_assignment"),
        ("java", "class X { long n = 3; double d = 2; Object o = 'c'; }", None),
        ("kotlin", 'class X { val n: Int = "a" }', "type_mismatch_assignment"),
        ("java", 'class X { int f() { return "a"; } }', "incompatible_return_type"),
        ("kotlin", "class X { val s: String = null }", "null_safety_violation"),
        ("kotlin", "class X { val s: String? = null }", None),
        ("kotlin", "class X { fun f(a: String?): String { return a } }", "null_safety_violation"),
        ("java", "class X { void f() { g(; } }", "syntax_error"),
        ("java", 'class X { String s = "open;\n }', "syntax_error"),
        ("java", "class X { /* } ", "syntax_error"),
    ],
)
def test_diagnostics(language, body, code):
    f = facts_of("/x", f"package p.q{';' if language == 'java' else ''}\n{body}", language)
    assert f["error"] is None
    assert {d["code"] for d in f["diagnostics"]} == ({code} if code else set())


def test_chains_literals_and_spans():
    f = facts_of("/x.groovy", "package p.q\nclass X { def f(items) { def n = items.first(1).name\n def s = 'x'\n def d = 1.5\n // note\n items.each { it.go() } } }", "groovy")
    types = {d["name"]: d["type_name"] for d in f["scope_decls"]}
    assert types["n"] == "items#first#name" and types["s"] == "String" and types["d"] == "BigDecimal"
    assert ("it", "go") in {(c["receiver"], c["method"]) for c in f["calls"]} and {"lambda"} == {a["kind"] for c in f["calls"] if c["method"] == "each" for a in c["args"]}
    assert {s["kind"] for s in f["spans"]} == {"comment", "string"}


def test_broken_input_never_raises():
    for text in ("", "package", "package a.b; class", "class X {", "}}}", "import", "package p.q; class A { int f(", "@", "package p.q\nfun", '"', "/*", "package p.q; enum E { A(1) { void f() {} }, B; }"):
        for language in ("java", "groovy", "kotlin"):
            assert facts_of("/x", text, language)["error"] is None, (language, text)


def test_workspace_scan(spark, tmp_path):
    for name, text in {"src/A.java": JAVA, "src/u.kt": KOTLIN, "build/B.java": JAVA, "src/n.txt": "x", "deep/er/P.groovy": GROOVY}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = workspace.scan_workspace(spark, str(tmp_path))
    assert sorted(r.path.rpartition("/")[2] for r in files.collect()) == ["A.java", "P.groovy", "u.kt"]
    parsed = workspace.parse(files)
    view = workspace.lookup_view(workspace.symbols(parsed))
    assert {"com.acme.User", "com.acme.Person#greet", "com.acme.core.Service#find"} <= {r.fqn for r in view.collect()}
    assert workspace.facts(parsed, "calls").where("method = 'trim'").first().receiver == "h#name"
    buffers = spark.createDataFrame([(files.where("language = 'kotlin'").first().path, "package z.y\nclass Fresh"), ("/new/N.java", "package n.m; class N {}")], "path string, text string")
    fresh = workspace.symbols(workspace.parse(workspace.with_buffers(files, buffers)))
    names = {r.fully_qualified_name for r in fresh.collect()}
    assert {"z.y.Fresh", "n.m.N", "com.acme.Person"} <= names and "com.acme.User" not in names


def test_facts_of_few_files_are_held_at_once(monkeypatch):
    """A batch of many files, or of large ones, gives its first facts before the rest is parsed."""
    import pyarrow as pa

    from symweave.sources import workspace

    read, whole = [], workspace.facts_of
    monkeypatch.setattr(workspace, "facts_of", lambda path, text, language: read.append(path) or whole(path, text, language))
    files = lambda n, text: pa.RecordBatch.from_pylist([{"path": f"/F{i}.java", "language": "java", "text": text} for i in range(n)])
    out = workspace._facts(iter([files(300, "class A { int f; }")]))
    assert next(out).num_rows == len(read) == workspace.PARSED_FILES
    assert sum(b.num_rows for b in out) == len(read) - workspace.PARSED_FILES == 300 - workspace.PARSED_FILES
    read.clear()
    out = workspace._facts(iter([files(5, "class A { } " + " " * workspace.PARSED_CHARS), files(1, None)]))
    assert next(out).num_rows == len(read) == 1 and sum(b.num_rows for b in out) == 5
