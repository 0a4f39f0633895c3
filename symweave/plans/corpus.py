"""Queries that go through the parser, the type functions, jar lists and the change feed as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..durable import shared_path, stored
from ..functions import types as typefn
from ..sources import dependencies, workspace
from ..sources.store import BucketedTable
from ..streaming import ttl
from ..streaming.diagnostics import DiagnosticsFeed, accumulated
from ..universe import Universe, pick, text
from .queries import joined, query


def _lines(col: str) -> F.Column:
    return F.array_join(F.array_sort(F.collect_set(col)), "\n")


def source_corpus(u: Universe) -> DataFrame:
    """path, language, text: one source file per type, written from its declaration and its members."""
    kotlin, java = F.col("language") == "kotlin", F.col("language") == "java"
    end = F.when(java, ";").otherwise("")
    params = F.transform("param_types", lambda p, i: F.when(F.col("language") == "kotlin", F.concat(F.lit("p"), i.cast("string"), F.lit(": "), p)).otherwise(F.concat(p, F.lit(" p"), i.cast("string"))))
    mods = F.array_join(F.filter("modifiers", lambda m: ~(kotlin & (m == "static"))), " ")
    head = F.when(mods == "", "").otherwise(F.concat(mods, F.lit(" ")))
    listed = F.array_join(params, ", ")
    line = (
        F.when(kotlin & (F.col("kind") == "Function"), F.concat(F.lit("    "), head, F.lit("fun "), "short_name", F.lit("("), listed, F.lit("): "), "return_type", F.lit(" { throw x }")))
        .when(kotlin, F.concat(F.lit("    "), head, F.lit("val "), "short_name", F.lit(": "), "return_type"))
        .when(F.col("kind") == "Function", F.concat(F.lit("    "), head, "return_type", F.lit(" "), "short_name", F.lit("("), listed, F.lit(") { return x"), end, F.lit(" }")))
        .otherwise(F.concat(F.lit("    "), head, "return_type", F.lit(" "), "short_name", end))
    )
    bodies = u.members.select("parent_name", "language", "kind", "modifiers", "short_name", "param_types", "return_type").withColumn("row", line).groupBy("parent_name").agg(_lines("row").alias("rows"))
    word = (
        F.when(F.col("kind") == "Interface", "interface")
        .when((F.col("kind") == "Enum") & kotlin, "enum class")
        .when(F.col("kind") == "Enum", "enum")
        .when((F.col("kind") == "Annotation") & kotlin, "annotation class")
        .when(F.col("kind") == "Annotation", "@interface")
        .otherwise("class")
    )
    above = u.supers.where("super_fqn is not null").select(F.col("symbol_fqn").alias("c_fqn"), "super_short_name", "super_fqn")
    t = u.types.join(bodies, F.col("fqn") == F.col("parent_name"), "left").join(above, F.col("fqn") == F.col("c_fqn"), "left")
    extends = F.coalesce(F.concat(F.when(kotlin, " : ").otherwise(" extends "), "super_short_name"), F.lit(""))
    mods_t = F.array_join("modifiers", " ")
    content = text(
        "package ", F.col("package_name"), end, "\n\n", F.coalesce(F.concat(F.lit("import "), "super_fqn", end, F.lit("\n\n")), F.lit("")),
        F.when(mods_t == "", "").otherwise(F.concat(mods_t, F.lit(" "))), word, " ", F.col("short_name"), extends, " {\n",
        F.when(F.col("kind") == "Enum", "    ONE, TWO;\n").otherwise(""), F.coalesce("rows", F.lit("")), "\n}\n",
    )
    return t.select(F.col("file_path").alias("path"), "language", content.alias("text"))


def _parsed(u: Universe) -> DataFrame:
    """Small texts take long to parse, so they are dealt out by number and not by size."""
    many = 4 * u.spark.sparkContext.defaultParallelism
    return u.kept("parsed", lambda: stored(workspace.parse(source_corpus(u).repartition(many, "path")).select("symbols", "supers"), "parsed"))


@query
def parse_corpus_symbols(u: Universe) -> DataFrame:
    """Every source file of the corpus parsed, and its symbols as a relation."""
    rows = workspace.symbols(_parsed(u))
    return rows.select("fully_qualified_name", "symbol_type", "parent_name", "file_path", joined("modifiers").alias("mods"), F.array_join(F.transform("metadata.parameters", lambda p: p["type_name"]), ",").alias("params"), F.col("metadata.return_type").alias("return_type"))


@query
def parse_corpus_supers(u: Universe) -> DataFrame:
    return workspace.supers(_parsed(u))


@query
def dia_parser_rules(u: Universe) -> DataFrame:
    """Rules that need a file's tokens, over a corpus with one planted fault per file."""
    body = {
        0: "import a.B;\nimport a.B;\nclass X { B b; }",
        1: "import a.Unused;\nclass X { }",
        2: "class X { int f() { g(); } }",
        3: 'class X { int n = "text"; }',
        4: "class X { Object f(Object o) { return (List<String>) o; } }",
        5: 'class X { int f() { return "text"; } }',
        6: "class X { void f() { int n; use(n); n = 1; } }",
        7: "class X { void f() { g(; } }",
        8: "class X { int f(int a) { return a; } int f(int b) { return b; } }",
    }
    pickd = F.element_at(F.create_map(*[x for k, v in body.items() for x in (F.lit(k), F.lit(v))]), (F.col("k") % 10).cast("int"))
    content = F.when(F.col("k") % 10 == 9, text("package ", F.col("package_name"), "\nclass X { val s: String = null }")).otherwise(text("package ", F.col("package_name"), ";\n", pickd))
    path = text("/ws/faults/F", F.col("k"), F.when(F.col("k") % 10 == 9, ".kt").otherwise(".java"))
    files = u.types.select(path.alias("path"), content.alias("text"))
    return workspace.facts(workspace.parse(workspace.with_language(files)), "diagnostics").select("path", "code", "severity").distinct()


@query
def jar_pairing(u: Universe) -> DataFrame:
    s = F.col("s_suppkey")
    jars = u.table("supplier").select(F.explode(F.array(F.when(s % 2 == 0, text("/repo/lib-", s, ".jar")), F.when(s % 3 == 0, text("/repo/lib-", s, "-sources.jar")))).alias("path"))
    return dependencies.pair_jars(jars)


@query
def jar_name_filter(u: Universe) -> DataFrame:
    s = F.col("s_suppkey")
    jars = u.table("supplier").select(F.when(s % 7 == 6, None).otherwise(text("/repo/lib-", s, pick((".jar", "-tests.jar", "-javadoc.jar", "-test.jar", "-sources.jar"), s))).alias("path"), s.alias("s"))
    return jars.where(dependencies.keep_jar(F.col("path")))


@query
def line_entry_guard(u: Universe) -> DataFrame:
    """Entries short enough to read, here with a limit of five line feeds."""
    return u.table("documents").where(~workspace.too_long(F.col("text"), 5)).select("doc_id")


@query
def type_ref_parse(u: Universe) -> DataFrame:
    k = F.col("k")
    written = F.when(k % 3 == 0, F.col("short_name")).when(k % 3 == 1, text("Map<", F.col("short_name"), ", List<T", k % 4, ">>")).otherwise(text(" Set <", F.col("short_name"), ">?"))
    return u.types.select("fqn", typefn.parse_type_udf(written).alias("t")).select("fqn", F.col("t.base").alias("base"), F.array_join("t.args", "|").alias("args"))


@query
def type_substitution(u: Universe) -> DataFrame:
    written = F.when(F.col("k") % 2 == 0, F.lit("Map<K, List<V>>")).otherwise(F.lit("V"))
    return u.types.select("fqn", typefn.substitute_udf(written, F.array(F.lit("K"), F.lit("V")), F.array(F.col("short_name"), F.lit("int"))).alias("resolved"))


@query
def param_type_normalise(u: Universe) -> DataFrame:
    k = F.col("k")
    written = F.when(k % 5 == 0, text("@Nullable java.util.List<", F.col("short_name"), ">")).when(k % 5 == 1, text(F.col("short_name"), "...")).when(k % 5 == 2, F.lit("Int?")).when(k % 5 == 3, text(F.col("fqn"), "[][]")).otherwise(F.lit("Integer"))
    return u.types.select("fqn", typefn.normalise_param_udf(written).alias("name"))


@query
def descriptor_parse(u: Universe) -> DataFrame:
    k = F.col("k")
    written = text("(", pick(("", "I", "[BII", "Ljava/lang/String;[[J"), k), ")", pick(("V", "Z", "[Ljava/util/List;"), k))
    return u.types.select("fqn", typefn.method_types_udf(written).alias("t")).select("fqn", F.array_join("t.params", ",").alias("params"), F.col("t.result").alias("result"))


@query
def signature_parse(u: Universe) -> DataFrame:
    k = F.col("k")
    written = text(pick(("", "<T:Ljava/lang/Object;>", "<K::Ljava/lang/Comparable<TK;>;V:Ljava/lang/Object;>"), k), "(", pick(("TT;", "Ljava/util/Map<TK;+Ljava/util/List<*>;>;"), k), ")Ljava/util/Map$Entry<TK;TV;>;")
    return u.types.select("fqn", typefn.method_signature_udf(written).alias("t")).select("fqn", F.array_join("t.formals", ",").alias("formals"), F.array_join("t.params", "|").alias("params"), F.col("t.result").alias("result"))


@query
def stream_debounce_upsert(u: Universe) -> DataFrame:
    """The newest buffer of each uri, kept by micro-batches over the event stream in a bucketed table. What is current
    stands in the table's own pointer, so a stream that starts again from its checkpoint goes on from there; a batch that
    was published before it was committed is skipped when it comes again."""
    spark = u.spark
    schema = spark.read.parquet(f"{u.sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{u.sf_dir}/events.parquet*")
    base = shared_path(spark, "stream")
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "change")
    changes = stream.select(F.col("user_id").alias("uri"), kind.alias("kind"), F.col("event_id").alias("version")).where("kind is not null")
    table = BucketedTable(spark, f"{base}/buffers", T.StructType.fromDDL("uri long, version long, kind string"), "uri", 16)

    def step(batch: DataFrame, batch_id: int) -> None:
        buckets = table.touched(batch.select("uri")) if batch_id > table.version else []
        if buckets:
            rows = batch.unionByName(table.read(buckets))
            table.publish_buckets(rows.groupBy("uri").agg(F.max("version").alias("version"), F.max_by("kind", "version").alias("kind")), buckets, batch_id)

    run = changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read()


def _in_quarters(u: Universe, base: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """The event table as a feed in four parts by time. The stream runs until it has read what there is, and starts again
    from its checkpoint for each part."""
    table = u.spark.read.parquet(f"{u.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = table.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - lo) * 4 / (hi - lo + 1)), F.lit(3))
    for i in range(4):
        table.where(part == i).write.mode("append").parquet(f"{base}/events")
        start(u.spark.readStream.schema(table.schema).parquet(f"{base}/events")).awaitTermination()


@query
def stream_ttl_eviction(u: Universe) -> DataFrame:
    """Buffers that the stream has evicted by the end of the feed: thirty minutes after their last read."""
    base = shared_path(u.spark, "ttl")

    def start(stream: DataFrame) -> StreamingQuery:
        changes = ttl.with_ttl(stream.select(F.col("user_id").alias("uri"), "ts"), 30 * 60 * 1000)
        return changes.writeStream.format("parquet").option("path", f"{base}/changes").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    _in_quarters(u, base, start)
    return ttl.evicted(u.spark.read.schema("uri long, micros long, evicted boolean").parquet(f"{base}/changes"))


@query
def stream_diagnostics(u: Universe) -> DataFrame:
    """The accumulated changelog of diagnostics over a feed that opens, changes and closes buffers."""
    base = shared_path(u.spark, "diagnostics")
    faults = F.array(*(F.lit(x) for x in (
        "import a.B;\nimport a.B;\nclass X { B b; }", "import a.Unused;\nclass X { }", "class X { int f() { g(); } }", 'class X { int n = "text"; }', "class X { }",
    )))
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "close").otherwise("change")
    content = F.concat(F.lit("package p.q;\n"), F.element_at(faults, (F.col("event_id") % 5 + 1).cast("int")))
    place = text("/ws/open/U", F.col("user_id"), ".java").alias("path")
    feed = DiagnosticsFeed(u.spark, f"{base}/feed", buckets=8)
    _in_quarters(u, base, lambda stream: feed.follow(stream.select(place, kind.alias("kind"), F.col("event_id").alias("version"), content.alias("text")), f"{base}/checkpoint"))
    return accumulated(feed.changelog()).select("path", "code", "severity")
