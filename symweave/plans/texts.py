"""Queries over text functions, workspaces, classpaths, revisions and archives, on inputs written from the driver's tables."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import shared_path
from ..engine import Engine
from ..functions import strings
from ..operators import maintain, requests
from ..sources import archive, dependencies, revisions, workspace
from ..sources.postings import PostingIndex
from ..universe import EXTENSION, Universe, pick, text
from .queries import joined, query


# ---- text functions ---------------------------------------------------------------------------------------


@query
def valid_identifier(u: Universe) -> DataFrame:
    short = F.col("short_name")
    name = F.element_at(F.array(short, text("_", short), text("9", short), text(short, "-a"), F.lit("class"), F.lit("fun"), F.lit("def"), F.lit("")), (F.col("k") % 8 + 1).cast("int"))
    return u.types.select("fqn", strings.is_valid_identifier(name, F.col("language")).alias("ok"))


@query
def cursor_words(u: Universe) -> DataFrame:
    """The receiver left of the dot and the prefix that ends at a cursor some characters before the end of a line."""
    line = F.when(F.col("k") % 5 == 4, text("  x", F.col("short_name"))).otherwise(text("  return ", F.col("short_name"), ".call", F.col("k")))
    col = (F.length(line) - F.col("k") % 3).cast("int")
    return u.types.select("fqn", strings.receiver_at(line, col).alias("receiver"), strings.prefix_at(line, col).alias("prefix"))


@query
def strip_comment_markers(u: Universe) -> DataFrame:
    short = F.col("short_name")
    doc = F.when(F.col("k") % 3 == 0, text("/**\n * About ", short, ".\n *\n * More ", F.col("k"), ".\n */")).when(F.col("k") % 3 == 1, text("/* ", short, " */")).otherwise(text("/// ", short, "\n// ", F.col("k")))
    return u.types.select("fqn", strings.strip_comment(doc).alias("doc"))


@query
def occurrences_with_dollar(u: Universe) -> DataFrame:
    """Whole words where $ belongs to identifiers."""
    content = text(F.col("short_name"), "\nm3 + m3$x + $m3\nthis.m3(am3, m3)\n", F.repeat(F.lit("m3;"), (F.col("k") % 4).cast("int")))
    return strings.occurrences(u.types.select(F.col("k").alias("id"), content.alias("text")), "m3", dollar=True)


@query
def byte_offset_of_position(u: Universe) -> DataFrame:
    content = text("é", F.col("short_name"), "\nü→", F.col("fqn"), "\n")
    col = F.when(F.col("k") % 7 == 0, 10_000).otherwise(2 + F.col("k") % 5).cast("int")
    return u.types.select("fqn", strings.byte_offset(content, F.lit(1), col).cast("long").alias("offset"))


@query
def qualifier_normalised(u: Universe) -> DataFrame:
    """Calls in calls, nested as deep as the key's remainder says."""
    deep = (F.col("k") % 9).cast("int")
    written = text(F.when(F.col("k") % 2 == 0, "new ").otherwise(""), F.col("short_name"), "(", F.repeat(F.lit("f(a, "), deep), F.repeat(F.lit(")"), deep), ").next.last", F.when(F.col("k") % 5 == 0, "(open").otherwise(""))
    return u.types.select("fqn", strings.normalise_qualifier(written).alias("qualifier"))


@query
def hits_outside_spans(u: Universe) -> DataFrame:
    """Positions in a file but for those in its comments and strings."""
    hits = u.type_refs.select("file_path", "line", "col", "name")
    spans = u.types.select("file_path", (F.col("k") % 100 * 10).cast("int").alias("s_line"), F.lit(8).alias("s_col"), (F.col("k") % 100 * 10 + 99).cast("int").alias("e_line"), F.lit(20).alias("e_col"))
    return requests.outside_spans(hits, spans)


# ---- workspaces, classpaths and revisions -----------------------------------------------------------------


@query
def workspace_files_with_buffers(u: Universe) -> DataFrame:
    """Files below a root that itself lies in a folder called build; open buffers win, and may have no file."""
    root = "/build/ws"
    folder = pick(("src", "build", "a/.git", "outer", "src/bin/x"), F.col("k"))
    ending = pick(("java", "groovy", "kt", "md"), F.col("k"))
    path = text(root, "/m", F.col("k") % 3, "/", folder, "/", F.col("short_name"), ".", ending)
    files = u.types.where(F.col("k") % 7 != 0).select(path.alias("path"), F.lit("disk").alias("text"))
    buffers = u.types.where((F.col("k") % 7 == 0) | (F.col("k") % 3 == 0)).select(path.alias("path"), F.lit("open").alias("text"))
    return workspace.with_buffers(files, buffers, root)


@query
def jar_choice(u: Universe) -> DataFrame:
    s = F.col("s_suppkey")
    jar = lambda end: text("/repo/lib-", s, end)
    jars = u.table("supplier").select(F.explode(F.array(F.when(s % 2 == 0, jar(".jar")), F.when(s % 3 == 0, jar("-sources.jar")), F.when(s % 5 == 0, jar("-tests.jar")))).alias("path"))
    return dependencies.choose_jar(dependencies.pair_jars(jars))


@query
def classpath_of_files(u: Universe) -> DataFrame:
    """One JSON line per subproject, one that overlaps another, and lines that are no JSON; two folders have none."""
    module = u.types.select((F.col("k") % 7).alias("m")).distinct().where("m < 5")
    as_json = lambda jar: text('{"sourceDirs": ["/ws/m', F.col("m"), '/src/"], "jarPaths": ["', jar, '", "/repo/b.jar"]}')
    lines = module.select(F.explode(F.array(as_json(text("/repo/a", F.col("m"), ".jar")), F.when(F.col("m") == 1, as_json(F.lit("/repo/z.jar"))), F.when(F.col("m") == 2, F.lit("not json")))).alias("value"))
    subprojects = dependencies.classpaths(lines).withColumn("ordinal", F.element_at("jar_paths", 1))
    return dependencies.jars_of_files(u.types.select("file_path"), subprojects).select("file_path", joined("jars").alias("jars"))


@query
def build_file_predicate(u: Universe) -> DataFrame:
    path = text("/ws/m", F.col("k") % 7, "/", pick(("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "my.build.gradle", "build.gradle/x", "pom.xml"), F.col("k")))
    return u.types.select("fqn", dependencies.is_build_file(path).alias("ok"))


@query
def changed_files_between_revisions(u: Universe) -> DataFrame:
    revision = text("r", F.col("k") % 10)
    commits = u.types.select(revision.alias("revision"), (F.col("k") % 10).alias("ordinal")).distinct()
    changes = u.types.select(revision.alias("revision"), text("src/", F.col("short_name"), ".", pick((*EXTENSION, "md"), F.col("k"))).alias("path"))
    return revisions.changed_files(commits, changes, "r2", "r6", "/ws/")


@query
def source_positions_of_classes(u: Universe) -> DataFrame:
    """Identifier positions of bytecode symbols from their source jars."""
    lib = u.external_types.where("needs_decompilation")
    zero = [F.lit(0).alias(c) for c in ("ident_line_start", "ident_line_end", "ident_char_start", "ident_char_end")]
    byte = lib.select("fqn", "jar_path", F.lit("lib-sources.jar").alias("alt_jar_path"), *zero)
    s = F.col("s").cast("int")
    found = lib.where("s % 3 <> 0").select("fqn", F.lit("lib-sources.jar").alias("jar_path"), s.alias("ident_line_start"), s.alias("ident_line_end"), F.lit(13).alias("ident_char_start"), (F.length("short_name") + 13).alias("ident_char_end"))
    return maintain.enrich_with_sources(byte, found)


# ---- archives ---------------------------------------------------------------------------------------------


class _Pool:
    """Constants of a class file, each text once."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.texts: dict[str, int] = {}

    def _add(self, part: bytes) -> int:
        self.parts.append(part)
        return len(self.parts)

    def text(self, value: str) -> int:
        if value not in self.texts:
            raw = value.encode()
            self.texts[value] = self._add(struct.pack(">BH", 1, len(raw)) + raw)
        return self.texts[value]

    def type(self, name: str) -> int:
        return self._add(struct.pack(">BH", 7, self.text(name)))


def class_file(name: str, flags: int, faces: list[str], fields: list[tuple], methods: list[tuple]) -> bytes:
    """A class without code, in the public format; members are (access, name, descriptor, signature or None)."""
    pool = _Pool()

    def member(access: int, label: str, descriptor: str, signature: str | None) -> bytes:
        head = struct.pack(">HHH", access, pool.text(label), pool.text(descriptor))
        return head + (struct.pack(">HHIH", 1, pool.text("Signature"), 2, pool.text(signature)) if signature else b"\0\0")

    body = struct.pack(">HHHH", flags, pool.type(name), pool.type("java/lang/Object"), len(faces)) + b"".join(struct.pack(">H", pool.type(f)) for f in faces)
    for members in (fields, methods):
        body += struct.pack(">H", len(members)) + b"".join(member(*m) for m in members)
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool.parts) + 1) + b"".join(pool.parts) + body + b"\0\0"


def jar_bytes(s: int, n: int) -> bytes:
    """The jar of a supplier: a class (public for three of four), a Groovy source, entries to skip, for some a broken one."""
    out, package = io.BytesIO(), f"ext/n{n}"
    fields = [(0x0002, "hidden", "I", None), (0x0009, "NAME", "Ljava/lang/String;", None)]
    methods = [(0x0001, f"m{s % 5}", "(Ljava/lang/String;[J)I", None), (0x0002, "secret", "()V", None), (0x1001, "bridge", "()V", None), (0x0404, "same", "(Ljava/lang/Object;)Ljava/lang/Object;", "<T:Ljava/lang/Object;>(TT;)TT;")]
    flags = (0x0001 if s % 4 != 3 else 0) | (0x0010 if s % 3 == 0 else 0x0400 if s % 3 == 1 else 0x0200)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(f"{package}/Lib{s}.class", class_file(f"{package}/Lib{s}", flags, [f"ext/Face{s % 3}"], fields, methods))
        z.writestr(f"{package}/Src{s}.groovy", f"package ext.n{n}\n\nclass Src{s} {{\n    private int kept\n    String label(int a) {{ return 'x' }}\n}}\n")
        z.writestr("module-info.class", b"skipped")
        z.writestr("META-INF/NOTE.txt", b"skipped")
        if s % 6 == 0:
            z.writestr("Broken.class", b"not a class")
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _jar(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([jar_bytes(a, b) for a, b in zip(s, n)])


def _entries(u: Universe) -> DataFrame:
    s = F.col("s_suppkey")
    alt = F.when(s % 2 == 0, text("/repo/lib-", s, "-sources.jar"))
    return archive.scan_jars(u.table("supplier").select(text("/repo/lib-", s, ".jar").alias("jar_path"), alt.alias("alt_jar_path"), _jar(s, F.col("s_nationkey")).alias("content")))


@query
def jar_scan_symbols(u: Universe) -> DataFrame:
    s = _entries(u).select(F.explode("symbols").alias("s")).select("s.*")
    return s.select(
        "jar_path", "alt_jar_path", F.col("fully_qualified_name").alias("fqn"), "parent_name", F.col("symbol_type").alias("kind"), joined("modifiers").alias("mods"), "needs_decompilation",
        F.array_join(F.transform("metadata.parameters", lambda p: p["type_name"]), ",").alias("params"), F.col("metadata.return_type").alias("return_type"),
        joined("metadata.method_type_params").alias("formals"), F.col("metadata.generic_return_type").alias("generic_return"),
    )


@query
def jar_scan_edges(u: Universe) -> DataFrame:
    return _entries(u).select("jar_path", F.explode("supers").alias("e")).select("jar_path", "e.*")


@query
def jar_scan_errors(u: Universe) -> DataFrame:
    """Entries that cannot be read, which stop nothing."""
    return _entries(u).where("error is not null").select("jar_path", "entry", "error", F.size("symbols").cast("long").alias("n"))


# ---- positions --------------------------------------------------------------------------------------------


def _small_files(u: Universe) -> DataFrame:
    """A Java file per type with documentation, annotations, overloads, locals, calls and creations."""
    short = F.col("short_name")
    content = text(
        "package ", F.col("package_name"), ";\n\n/** About ", short, ". */\n@Deprecated\nclass ", short, " {\n    /** Counts. */\n    @Override\n    public int size(int a) { return a; }\n"
        "    int size() { return 0; }\n    int run(", short, " other) {\n        int n = ", F.col("k"), ";\n        ", short, " made = new ", short, "();\n        return other.size(n);\n    }\n}\n",
    )
    return u.types.select(text("/ws/small/", short, ".java").alias("path"), F.lit("java").alias("language"), content.alias("text"))


def _small_engine(u: Universe) -> Engine:
    many = 4 * u.spark.sparkContext.defaultParallelism
    return Engine(u.spark, _small_files(u).repartition(many, "path"))


@query
def parse_documented_symbols(u: Universe) -> DataFrame:
    """Documentation, annotations and the place of each declared name."""
    rows = workspace.symbols(workspace.parse(_small_files(u)))
    return rows.select("file_path", F.col("fully_qualified_name").alias("fqn"), F.col("metadata.documentation").alias("doc"), joined("metadata.annotations").alias("annotations"), "ident_line_start", "ident_char_start", "ident_char_end")


@query
def symbol_at_position(u: Universe) -> DataFrame:
    """Cursors on a local, a parameter, a called method and a type, in every file."""
    places = F.array(*(F.struct(F.lit(x).alias("line"), F.lit(y).alias("col")) for x, y in ((12, 15), (12, 21), (12, 26), (11, 8))))
    cursors = u.types.select(text("/ws/small/", F.col("short_name"), ".java").alias("file_path"), F.explode(places).alias("p")).select("file_path", "p.line", "p.col")
    return _small_engine(u).definition(cursors).select("file_path", "line", "col", "name", "origin", "target")


@query
def references_by_index(u: Universe) -> DataFrame:
    """Whole-word references to every type outside comments, read from stored postings; a third of the files had other
    contents when the index was built."""
    half = u.types.select(F.col("k").alias("h_k"), F.col("short_name").alias("other"))
    rows = u.types.join(half, F.floor(F.col("k") / 2) == F.col("h_k"))
    short, other = F.col("short_name"), F.col("other")
    content = text("package ", F.col("package_name"), ";\n// ", short, " and ", other, "\nclass ", short, " extends ", other, " {\n    String s = \"", other, "\"; /* ", short, "\n  ", other, " */ ", other, " f;\n}\n")
    path = text("/ws/refs/", short, ".java")
    now = rows.select(path.alias("path"), F.lit("java").alias("language"), content.alias("text"), "k")
    before = now.withColumn("text", F.when(F.col("k") % 3 == 0, F.lit("class Old { Old old; }\n")).otherwise(F.col("text"))).unionByName(now.where("k % 5 = 0").withColumn("path", F.concat("path", F.lit("-gone"))))

    index = PostingIndex(u.spark, shared_path(u.spark, "postings"), buckets=16)
    index.build(before)
    changed = now.where("k % 3 = 0")
    index.replace(changed, gone=before.where("path like '%-gone'").select(F.col("path").alias("file_path")))
    return index.references(u.types.select(F.col("short_name").alias("name")))
