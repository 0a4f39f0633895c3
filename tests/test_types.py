import io
import struct
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st

from symweave.functions import strings, types
from symweave.sources import archive, dependencies
from symweave.sources.classfile import read_class
from pyspark.sql import functions as F

NAMES = st.sampled_from(["A", "Foo", "int", "K", "List"])
TYPES = st.recursive(NAMES, lambda inner: st.builds(lambda b, a: f"{b}<{', '.join(a)}>", NAMES, st.lists(inner, min_size=1, max_size=3)), max_leaves=8)


@given(TYPES)
def test_unbound_substitution_is_identity(text):
    assert types.substitute(text, {}) == text


@given(TYPES)
def test_parsing_keeps_all_arguments(text):
    base, args = types.parse_type(text)
    assert text == (f"{base}<{', '.join(args)}>" if args else base)


def test_substitution_reaches_every_depth():
    assert types.substitute("Map<K, List<Map<V, K>>>", {"K": "A", "V": "B<C>"}) == "Map<A, List<Map<B<C>, A>>>"
    assert types.bindings(["K", "V", "K"], ["a", "b"]) == {"K": "a", "V": "b"}
    assert types.parse_type("Map<K, V>?") == ("Map", ["K", "V"]) and types.parse_type("Map<K") == ("Map", [])


@pytest.mark.parametrize("d, want", [("()V", ([], "void")), ("([BII)Z", (["byte[]", "int", "int"], "boolean")), ("(Ljava/lang/String;[[J)[Ljava/util/List;", (["java.lang.String", "long[][]"], "java.util.List[]"))])
def test_descriptors(d, want):
    assert types.method_types(d) == want


def test_signatures():
    assert types.class_type_params("<K:Ljava/lang/Object;V::Ljava/lang/Comparable<TV;>;>Ljava/lang/Object;") == ["K", "V"]
    assert types.class_type_params(None) == []
    assert types.method_signature("<T:Ljava/lang/Object;>(TT;[ILjava/util/Map<-TT;*>;)Ljava/util/Map<TT;+Ljava/lang/Number;>.Entry<TT;>;") == (["T"], ["T", "int[]", "Map<T, ?>"], "Entry<T>")


@pytest.mark.parametrize("text, want", [("@NotNull java.util.List<String>", "List"), ("int...", "int[]"), ("Int?", "int"), ("Map<K, List<V>>[]", "Map[]"), ("Any", "Object")])
def test_parameter_names(text, want):
    assert types.normalise_param(text) == want


def class_bytes(flags=0x0421):
    """A public abstract class p.q.Thing<T> extends p.q.Base: fields and methods of every visibility."""
    pool, index = [], {}

    def utf(s):
        if s not in index:
            pool.append(b"\x01" + struct.pack(">H", len(s)) + s.encode())
            index[s] = len(pool)
        return index[s]

    def cls(name):
        u = utf(name)
        pool.append(b"\x07" + struct.pack(">H", u))
        return len(pool)

    pool.append(b"\x05" + bytes(8))  # a long takes two places
    pool.append(b"")
    this, above = cls("p/q/Thing"), cls("p/q/Base")
    sig = utf("Signature")

    def member(access, name, descriptor, generic=None):
        head = struct.pack(">HHH", access, utf(name), utf(descriptor))
        return head + (struct.pack(">HHIH", 1, sig, 2, utf(generic)) if generic else struct.pack(">H", 0))

    fields = [member(0x0009, "COUNT", "I"), member(0x0002, "hidden", "I")]
    methods = [member(0x0401, "find", "(Ljava/lang/String;[I)Ljava/lang/Object;", "(Ljava/lang/String;[I)TT;"), member(0x0002, "secret", "()V"), member(0x0001, "<init>", "()V")]
    own = struct.pack(">HHIH", 1, sig, 2, utf("<T:Ljava/lang/Object;>Lp/q/Base;"))
    body = struct.pack(">HHHH", flags, this, above, 0) + struct.pack(">H", 2) + b"".join(fields) + struct.pack(">H", 3) + b"".join(methods) + own
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool) + 1) + b"".join(pool) + body


def test_class_file():
    c = read_class(class_bytes())
    assert (c["name"], c["kind"], c["modifiers"], c["parents"], c["type_params"]) == ("p.q.Thing", "Class", ["public", "abstract"], ["p.q.Base"], ["T"])
    assert [m["short_name"] for m in c["members"]] == ["COUNT", "find", "<init>"]
    find = c["members"][1]
    assert [p["type_name"] for p in find["parameters"]] == ["java.lang.String", "int[]"] and find["return_type"] == "java.lang.Object" and find["generic"] == ([], ["String", "int[]"], "T")
    assert read_class(class_bytes(0x0420)) is None
    assert read_class(class_bytes(0x0601))["kind"] == "Interface"


def jar(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return str(path)


def test_jar_scan(spark, tmp_path):
    byte = jar(tmp_path / "lib.jar", {"p/q/Thing.class": class_bytes(), "module-info.class": b"x", "p/q/Bad.class": b"nonsense", "readme.md": "x", "p/q/Long.java": "\n" * 10_001})
    src = jar(tmp_path / "lib-sources.jar", {"p/q/Thing.java": "package p.q; public class Thing<T> { private int no; public T find(String k) { return null; } }"})
    broken = tmp_path / "broken.jar"
    broken.write_bytes(b"no zip")
    pairs = dependencies.pair_jars(spark.createDataFrame([(byte,), (src,), (str(broken),), (str(tmp_path / "x-tests.jar"),)], "path string"))
    chosen = dependencies.choose_jar(pairs)
    assert {(r.jar_path, r.alt_jar_path) for r in chosen.collect()} == {(byte, src), (str(broken), None)}
    rows = archive.scan_jars(archive.load_jars(spark, chosen)).cache()
    found = rows.select(F.explode("symbols").alias("s")).select("s.*").collect()
    assert {r.fully_qualified_name for r in found} == {"p.q.Thing", "p.q.Thing#COUNT", "p.q.Thing#find", "p.q.Thing#<init>"}
    assert all(r.needs_decompilation and r.alt_jar_path == src for r in found)
    assert {r.error is None for r in rows.collect()} == {True, False} and rows.where("error is not null").count() == 2
    from_source = archive.scan_jars(archive.load_jars(spark, spark.createDataFrame([(src, None)], "jar_path string, alt_jar_path string")))
    got = {r.fully_qualified_name: r for r in from_source.select(F.explode("symbols").alias("s")).select("s.*").collect()}
    assert set(got) == {"p.q.Thing", "p.q.Thing#find"} and not got["p.q.Thing"].needs_decompilation


def test_wanted_entries():
    assert archive.wanted("/x/a.jar", "a/B.class") and not archive.wanted("/x/a.jar", "a/B.txt")
    assert archive.wanted("/jdk/src.zip", "java.base/java/lang/String.java") and not archive.wanted("/jdk/src.zip", "java.base/sun/misc/X.java")


def test_classpaths(spark):
    lines = spark.createDataFrame([('{"sourceDirs": ["/w/a/"], "jarPaths": ["x.jar"]}',), ("broken {",), ('{"sourceDirs": ["/w/ab"], "jarPaths": ["y.jar"]}',)], "value string")
    subs = dependencies.classpaths(lines)
    assert subs.count() == 2
    files = spark.createDataFrame([("/w/a/p/X.java",), ("/w/ab/Y.java",), ("/w/abc/Z.java",)], "file_path string")
    got = {r.file_path: r.jars for r in dependencies.jars_of_files(files, subs.withColumn("ordinal", F.monotonically_increasing_id())).collect()}
    assert got == {"/w/a/p/X.java": ["x.jar"], "/w/ab/Y.java": ["y.jar"], "/w/abc/Z.java": []}


def test_text_functions(spark):
    df = spark.createDataFrame([("foo.bar.ba", 10, "/**\n * Says *it*.\n *\n * @param x\n */", "new A(b(c), d).e().f")], "line string, col int, doc string, chain string")
    r = df.select(strings.receiver_at(F.col("line"), F.col("col")), strings.prefix_at(F.col("line"), F.col("col")), strings.strip_comment(F.col("doc")), strings.normalise_qualifier(F.col("chain")), strings.capitalise(F.lit("fooBar"))).first()
    assert tuple(r) == ("bar", "ba", "Says *it*.\n\n@param x", "A#e#f", "FooBar")
    texts = spark.createDataFrame([(1, "id $id id_x\nid.id ID"), (2, "none")], "id int, text string")
    assert [(r.line, r.n) for r in strings.occurrences(texts, "id").orderBy("line").collect()] == [(0, 2), (1, 2)]
    assert [(r.line, r.n) for r in strings.occurrences(texts, "id", dollar=True).orderBy("line").collect()] == [(0, 1), (1, 2)]


def test_hover(spark):
    df = spark.createDataFrame([("java", "p.q", "run", "Function", ["public"], ["int a", "int b", "int c", "int d"], "void", "Runs."), ("kotlin", "p", "T", "Enum", [], None, None, None)], "l string, p string, n string, k string, m array<string>, a array<string>, r string, d string")
    got = [r[0] for r in df.select(strings.hover(*(F.col(c) for c in "lpnkmar"), F.col("d"))).collect()]
    assert got[0] == "```java\npackage p.q\n\npublic void run(\n  int a,\n  int b,\n  int c,\n  int d\n)\n```\n\n---\nRuns." and got[1] == "```kotlin\npackage p\n\nenum class T\n```"
