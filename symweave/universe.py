"""Index and fact relations projected from the driver's tables, so that every relational operator runs at any scale.

Column rules are integer arithmetic on the tables' keys; plans/oracle.py states the same projection as SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import stored
from .operators import hierarchy, resolve

# Parameter types, argument kinds, numeric types and languages that the rules choose from by remainder.
PARAM_TYPES = ("int", "String", "List<String>", "T")
ARG_KINDS = ("int_literal", "string_literal", "null_literal", "char_literal", "identifier")
NUMERIC = ("byte", "short", "int", "long", "float", "double")
LANGUAGE = ("java", "groovy", "kotlin")
EXTENSION = ("java", "groovy", "kt")

#: Names up to which those that lines mention are broadcast (about 100 bytes each).
BROADCAST_NAMES = 500_000

#: Relations that several queries read, by session, folder, state of the folder's tables, and name.
_kept: dict[tuple[str, str, tuple, str], object] = {}


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


class Universe:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _state(self) -> tuple[tuple[str, int, int], ...]:
        """Name, size and time of each file of the tables that the index is projected from."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{t}.parquet") for t in ("part", "supplier", "lineitem")]
        found = (f for p in paths for f in p.getFileSystem(conf).listStatus(p))
        return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))

    def kept[T](self, name: str, make: Callable[[], T]) -> T:
        """What make() gives (a stored table, or what was found of one), made once a session and state of the tables."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self._state, name)
        if key not in _kept:
            _kept[key] = make()
        return _kept[key]

    @cached_property
    def types(self) -> DataFrame:
        """k, package_name, short_name, fqn, kind, modifiers, language, file_path of each type."""
        k = F.col("p_partkey")
        bare = F.replace("p_name", F.lit(" "), F.lit(""))
        rows = self.table("part").select(
            k.alias("k"),
            text("com.r", F.col("p_size") % 5, ".n", F.col("p_size") % 25).alias("package_name"),
            text(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 1000), k).alias("short_name"),
            F.when(k % 10 == 0, "Interface").when(k % 10 == 5, "Enum").when(k % 10 == 6, "Annotation").otherwise("Class").alias("kind"),
            F.when(k % 4 == 0, F.array(F.lit("abstract"))).when(k % 9 == 0, F.array(F.lit("final"))).otherwise(F.expr("cast(array() as array<string>)")).alias("modifiers"),
            pick(LANGUAGE, k).alias("language"),
            pick(EXTENSION, k).alias("ext"),
        )
        return rows.select("*", text(F.col("package_name"), ".", F.col("short_name")).alias("fqn"), text("/ws/m", F.col("k") % 7, "/src/", F.col("short_name"), ".", F.col("ext")).alias("file_path")).drop("ext")

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")

    @cached_property
    def members(self) -> DataFrame:
        """Functions and fields of the types, with overloads: fqn, short_name, parent_name, kind, modifiers, param_types, return_type, position."""
        return self.kept("members", lambda: stored(self._members(), "members"))

    def _members(self) -> DataFrame:
        o, n, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
        owner = self.types.select(F.col("k").alias("o_k"), F.col("fqn").alias("parent_name"), "package_name", "file_path", "language")
        result = self.types.select(F.col("k").alias("r_k"), F.col("short_name").alias("r_short"))
        function = n <= 4
        name = F.when(function & (o % 20 == 19), text("getM", k % 5)).when(function & (o % 20 == 18), text("isM", k % 5)).otherwise(text("m", o % 20))
        arity = n % 4
        params = F.when(function, F.transform(F.expr("if(l_linenumber % 4 = 0, cast(array() as array<bigint>), sequence(0L, cast(l_linenumber % 4 as bigint) - 1))"), lambda i: pick(PARAM_TYPES, o + i)))
        # all that a member shows follows from the owner, the order key modulo 60 and the line number, so rows are made
        # distinct on those small integers before any text is built
        keys = self.lines.select("l_partkey", (F.col("l_orderkey") % 60).alias("l_orderkey"), "l_linenumber").distinct()
        rows = keys.join(owner, k == F.col("o_k")).join(result, F.floor(k / 2) == F.col("r_k"))
        rows = rows.select(
            name.alias("short_name"),
            "parent_name",
            "package_name",
            "file_path",
            "language",
            F.when(function, "Function").otherwise("Field").alias("kind"),
            F.when(n % 3 == 0, F.array(F.lit("private"))).when(n % 5 == 0, F.array(F.lit("static"))).otherwise(F.expr("cast(array() as array<string>)")).alias("modifiers"),
            params.alias("param_types"),
            F.when(o % 3 == 0, F.col("r_short")).when(o % 3 == 1, "int").otherwise("void").alias("return_type"),
            (100 + (o % 20) * 10 + arity).cast("int").alias("line"),
        )
        return rows.withColumn("fqn", text(F.col("parent_name"), "#", F.col("short_name")))

    @cached_property
    def symbols(self) -> DataFrame:
        own = self.types.select("fqn", "short_name", "package_name", F.col("package_name").alias("parent_name"), "file_path", "language", "kind", "modifiers", F.lit(None).cast("array<string>").alias("param_types"), F.lit(None).cast("string").alias("return_type"), (F.col("k") % 50).cast("int").alias("line"))
        return own.unionByName(self.members.select(*own.columns))

    @cached_property
    def supers(self) -> DataFrame:
        child = self.types.where("k > 0").select("k", F.col("fqn").alias("symbol_fqn"))
        parent = self.types.select(F.col("k").alias("s_k"), F.col("short_name").alias("super_short_name"), F.col("fqn").alias("s_fqn"))
        return child.join(parent, F.floor(F.col("k") / 3) == F.col("s_k")).select("symbol_fqn", "super_short_name", F.when(F.col("k") % 11 != 0, F.col("s_fqn")).alias("super_fqn"))

    @property
    def closure(self) -> DataFrame:
        """child, ancestor, depth, path without the types themselves."""
        return self.kept("closure", self.close)

    def close(self) -> DataFrame:
        return hierarchy.closure(self.supers.select(F.col("symbol_fqn").alias("child"), F.col("super_fqn").alias("parent"), F.lit(0).alias("ordinal")))

    @property
    def reach(self) -> DataFrame:
        return hierarchy.with_self(self.closure, self.types)

    @property
    def library_reach(self) -> DataFrame:
        """reach, where types of a number that leaves three by seven extend a library class besides."""
        lib = self.external_types.where("not needs_decompilation").select(F.col("s"), F.col("fqn").alias("lib_fqn"))
        below = self.types.where("k % 7 = 3").join(lib, F.floor(F.col("k") / 7) == F.col("s")).select(F.col("fqn").alias("ancestor"), "lib_fqn")
        over = self.reach.join(below, "ancestor").select("child", F.col("lib_fqn").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(F.lit(1))).alias("path"))
        return self.reach.unionByName(over)

    @cached_property
    def nested_types(self) -> DataFrame:
        """Types inside types: every fifth type, from the second on, declares one that extends the type of a fourth of its number. Columns of types, and owner."""
        own = self.types.where("k % 5 = 2")
        name = text("Inner", F.col("k") % 3)
        none = F.expr("cast(array() as array<string>)")
        return own.select("k", "package_name", name.alias("short_name"), text(F.col("fqn"), "#", name).alias("fqn"), F.lit("Class").alias("kind"), none.alias("modifiers"), "language", "file_path", F.col("fqn").alias("owner"))

    @cached_property
    def mixed_edges(self) -> DataFrame:
        """child, name, parent, ordinal: parents by name that a file settles or not; library parents second; third, for
        every fourth type, from the fifth on, the type inside one of about half its number. Types inside types
        have a named parent and one that only the types around them can settle."""
        places = self.types.select(F.col("fqn").alias("symbol_fqn"), "file_path", "package_name", "k")
        how = (self.numbered_imports, "k") if self.numbered else (self.imports, "file_path")
        # only types can be parents, so members are not asked for
        first = resolve.parents_in_context(self.supers, places, how[0], self.types.select("fqn", "kind"), self.external_types, how[1])
        first = first.select(F.col("symbol_fqn").alias("child"), F.col("super_short_name").alias("name"), F.col("super_fqn").alias("parent"), F.lit(0).alias("ordinal"))
        lib = self.external_types.where("not needs_decompilation").select("s", F.col("short_name").alias("name"), F.col("fqn").alias("parent"))
        second = self.types.where("k % 7 = 3").join(lib, F.floor(F.col("k") / 7) == F.col("s")).select(F.col("fqn").alias("child"), "name", "parent", F.lit(1).alias("ordinal"))
        half = self.nested_types.select(F.col("k").alias("h_k"), F.col("short_name").alias("name"), F.col("fqn").alias("parent"))
        third = self.types.where("k % 4 = 1 and k > 4").join(half, F.floor(F.col("k") / 10) * 5 + 2 == F.col("h_k")).select(F.col("fqn").alias("child"), "name", "parent", F.lit(2).alias("ordinal"))
        above = self.types.select(F.col("k").alias("a_k"), F.col("short_name").alias("name"), F.col("fqn").alias("parent"))
        inner = self.nested_types.join(above, F.floor(F.col("k") / 4) == F.col("a_k")).select(F.col("fqn").alias("child"), "name", "parent", F.lit(0).alias("ordinal"))
        open_ = self.nested_types.select(F.col("fqn").alias("child"), text("Inner", (F.col("k") + 1) % 3).alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("ordinal"))
        return first.unionByName(second).unionByName(third).unionByName(inner).unionByName(open_)

    @cached_property
    def joint(self) -> tuple[DataFrame, DataFrame]:
        """mixed_edges with the parents that inheritance settles, and their closure."""
        if self.coded:
            return self._named_edges(), self._named_ways()
        closed = self.kept("joint-closure", self._joint)
        return self.kept("joint-edges", lambda: closed), closed

    @property
    def coded(self) -> bool:
        """Whether joint can be found on numbers: numbered, libraries too, and no import names a type of the project."""
        return self.numbered and self.kept("coded", self._coded)

    def _coded(self) -> bool:
        s, large = F.col("s_suppkey"), F.lit(1 << 50)
        odd = self.types.where((F.abs("k") > large) | F.col("short_name").rlike("^(Lib|Missing)[0-9-]"))
        odd_lib = self.table("supplier").where(s.isNull() | F.col("s_nationkey").isNull() | (F.abs(s) > large))
        return odd.isEmpty() and odd_lib.isEmpty() and self.table("supplier").groupBy(s).count().where("count > 1").isEmpty()

    @property
    def codes(self) -> DataFrame:
        """code, fqn, short_name: a type has four times its number, a type inside it one more, a library type two more than four times its."""
        own = self.types.select((F.col("k") * 4).alias("code"), "fqn", "short_name")
        inner = self.nested_types.select((F.col("k") * 4 + 1).alias("code"), "fqn", "short_name")
        lib = self.external_types.where("not needs_decompilation").select((F.col("s") * 4 + 2).alias("code"), "fqn", "short_name")
        return own.unionByName(inner).unionByName(lib)

    @property
    def coded_joint(self) -> tuple[DataFrame, DataFrame]:
        """joint in codes; a name is the code of a type of that name, or -1 - i for Inneri."""
        return self.kept("coded-joint", self._coded_joint)

    def _coded_joint(self) -> tuple[DataFrame, DataFrame]:
        k, none = F.col("k"), F.lit(None).cast("long")
        inner_name = lambda x: (-1 - x % 3).cast("long")
        row = lambda child, name, parent, ordinal: (child.alias("child"), name.alias("name"), parent.alias("parent"), F.lit(ordinal).cast("byte").alias("ordinal"))
        own = self.types.select("k")
        there = own.select(k.alias("p"))
        p = F.col("p")
        settled = own.where("k > 0 and k % 11 <> 0").join(there, F.floor(k / 3) == p).select(*row(k * 4, p * 4, p * 4, 0))
        above = self.types.select(k.alias("p"), F.col("short_name").alias("super_short_name"))
        asked = own.where("k > 0 and k % 11 = 0").join(above, F.floor(k / 3) == p).select(k.alias("symbol_fqn"), "super_short_name", F.lit(None).cast("string").alias("super_fqn"), "p")
        # only the type of that name can be found: no other has it, no import of another thing ends in it
        imports = self.numbered_imports.where("k > 0 and k % 11 = 0")
        found = resolve.parents_in_context(asked, self.types.select(k.alias("symbol_fqn"), "file_path", "package_name", "k"), imports, self.types.select("fqn", "kind"), self.external_types, "k")
        first = found.select(*row(F.col("symbol_fqn") * 4, p * 4, F.when(F.col("super_fqn").isNotNull(), p * 4), 0))
        lib = self.table("supplier").select(F.col("s_suppkey").alias("p"))
        second = own.where("k % 7 = 3").join(lib, F.floor(k / 7) == p).select(*row(k * 4, p * 4 + 2, p * 4 + 2, 1))
        third = own.where("k % 4 = 1 and k > 4").join(there.where("p % 5 = 2"), F.floor(k / 10) * 5 + 2 == p).select(*row(k * 4, inner_name(p), p * 4 + 1, 2))
        within = own.where("k % 5 = 2")
        around = within.join(there, F.floor(k / 4) == p).select(*row(k * 4 + 1, p * 4, p * 4, 0))
        edges = settled.unionByName(first).unionByName(second).unionByName(third).unionByName(around).unionByName(within.select(*row(k * 4 + 1, inner_name(k + 1), none, 1)))
        nested = within.select((k * 4).alias("owner"), inner_name(k).alias("name"), (k * 4 + 1).alias("fqn"))
        return hierarchy.joint_closure(edges, nested, nested.select(F.col("fqn").alias("child"), F.col("owner").alias("scope"), F.lit(1).alias("level")))

    def _named_edges(self) -> DataFrame:
        edges = self.coded_joint[0].withColumn("code", F.coalesce("parent", F.when(F.col("name") >= 0, F.col("name"))))
        to = self.codes.select("code", F.col("fqn").alias("to"), "short_name")
        rows = edges.join(to, "code", "left").withColumn("name", F.coalesce("short_name", text("Inner", -1 - F.col("name")))).drop("code")
        rows = rows.join(self.codes.select(F.col("code").alias("child"), "fqn"), "child")
        return rows.select(F.col("fqn").alias("child"), "name", F.when(F.col("parent").isNotNull(), F.col("to")).alias("parent"), F.col("ordinal").cast("int").alias("ordinal"))

    def _named_ways(self) -> DataFrame:
        named = lambda col: self.codes.select(F.col("code").alias(col), F.col("fqn").alias(f"{col}_fqn"))
        rows = self.coded_joint[1].join(named("ancestor"), "ancestor").join(named("child"), "child")
        return rows.select(F.col("child_fqn").alias("child"), F.col("ancestor_fqn").alias("ancestor"), "depth", "path")

    def _joint(self) -> DataFrame:
        nested = self.nested_types.select("owner", F.col("short_name").alias("name"), "fqn")
        scopes = self.nested_types.select(F.col("fqn").alias("child"), F.col("owner").alias("scope"), F.lit(1).alias("level"))
        edges, closed = hierarchy.joint_closure(self.mixed_edges, nested, scopes)
        self.kept("joint-edges", lambda: edges)
        return closed

    @cached_property
    def external_types(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(s.alias("s"), "s_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select(
            "s",
            text("ext.n", F.col("s_nationkey"), ".Lib", F.col("s")).alias("fqn"),
            text("Lib", F.col("s")).alias("short_name"),
            text("ext.n", F.col("s_nationkey")).alias("package_name"),
            text("ext.n", F.col("s_nationkey")).alias("parent_name"),
            text("lib", F.col("j"), ".jar").alias("jar_path"),
            (F.col("j") == 1).alias("needs_decompilation"),
            F.lit("Class").alias("kind"),
            (F.col("s") % 3).cast("int").alias("n_type_params"),
        )

    @cached_property
    def external_members(self) -> DataFrame:
        own = self.external_types.where("not needs_decompilation").select("s", F.col("fqn").alias("parent_name"), "package_name", "jar_path")
        rows = self.lines.select(F.col("l_suppkey").alias("s"), "l_linenumber").distinct().join(own, "s")
        return rows.select(text(F.col("parent_name"), "#x", F.col("l_linenumber")).alias("fqn"), text("x", F.col("l_linenumber")).alias("short_name"), "package_name", "parent_name", "jar_path", F.lit(False).alias("needs_decompilation"), F.lit("Function").alias("kind"))

    @cached_property
    def external_symbols(self) -> DataFrame:
        cols = ["fqn", "short_name", "package_name", "parent_name", "jar_path", "needs_decompilation", "kind"]
        return self.external_types.select(*cols).unionByName(self.external_members.select(*cols))

    @cached_property
    def import_lines(self) -> DataFrame:
        """Explicit imports as they stand in each file, repeats included: file_path, ordinal, import_text."""
        lib = self.external_types.where("not needs_decompilation").select("s", F.col("fqn").alias("import_text"))
        rows = self.lines.join(lib, F.col("l_suppkey") == F.col("s")).join(self.types.select("k", "file_path"), F.col("l_partkey") == F.col("k"))
        order = Window.partitionBy("file_path").orderBy("l_orderkey", "l_linenumber", "l_suppkey")
        return rows.select("file_path", F.row_number().over(order).alias("ordinal"), "import_text")

    @cached_property
    def imports(self) -> DataFrame:
        """file_path, ordinal, import_text, is_wildcard: libraries, missing classes and one wildcard of a package."""
        files = self.types.select("k", "file_path")
        lib = self.external_types.where("not needs_decompilation").select("s", F.col("fqn").alias("import_text"))
        pairs = self.lines.select("l_partkey", "l_suppkey", (F.col("l_linenumber") == 7).alias("seven")).distinct().join(files, F.col("l_partkey") == F.col("k"))
        known = pairs.select("file_path", "l_suppkey").distinct().join(lib, F.col("l_suppkey") == F.col("s")).select("file_path", F.col("l_suppkey").alias("ordinal"), "import_text", F.lit(False).alias("is_wildcard"))
        gone = pairs.where("seven and l_suppkey % 2 = 0").select("file_path", (F.col("l_suppkey") + 1_000_000).alias("ordinal"), text("gone.pkg.Missing", F.col("l_suppkey")).alias("import_text"), F.lit(False).alias("is_wildcard")).distinct()
        other = self.types.select(F.col("k").alias("o_k"), F.col("package_name").alias("o_pkg"))
        wild = files.join(other, F.floor(F.col("k") / 2) == F.col("o_k")).select("file_path", F.lit(2_000_000).cast("long").alias("ordinal"), text(F.col("o_pkg"), ".*").alias("import_text"), F.lit(True).alias("is_wildcard"))
        return known.unionByName(gone).unionByName(wild)

    @property
    def numbered(self) -> bool:
        """Whether a type's number alone says its texts, and they say the number: no name is missing, ends in a digit or has a # or a dot (which only members' and qualified names
        have besides), no number occurs twice."""
        return self.kept("numbered", self._numbered)

    def _numbered(self) -> bool:
        part = self.table("part")
        odd = part.where(F.col("p_partkey").isNull() | F.col("p_size").isNull() | F.coalesce(F.trim("p_name").rlike("[0-9]$|[#.]"), F.lit(True)))
        return odd.isEmpty() and part.groupBy("p_partkey").count().where("count > 1").isEmpty()

    @property
    def mentioned(self) -> DataFrame:
        """n_k, n_short of the types that some line's supplier key names; broadcast while they are few."""
        return self.kept("mentioned", self._mentioned)

    def _mentioned(self) -> DataFrame:
        asked = self.lines.select(F.col("l_suppkey").alias("n_k")).distinct()
        found = stored(self.types.select(F.col("k").alias("n_k"), F.col("short_name").alias("n_short")).join(asked, "n_k", "left_semi"), "mentioned")
        return F.broadcast(found) if found.count() <= BROADCAST_NAMES else found

    @cached_property
    def numbered_refs(self) -> DataFrame:
        """k, name, line, col: type_refs by the number of the file's type, dealt out by it. Rows are made distinct on the lines' small
        integers, which say all that a mention shows, in the one shuffle that brings them to their files."""
        n = F.col("l_linenumber")
        own = self.lines.select(F.col("l_partkey").alias("k"), "l_suppkey", "l_linenumber", (F.col("l_orderkey") % 1000).cast("int").alias("line"))
        rows = own.where("k is not null").repartition("k").distinct().join(self.mentioned, F.col("l_suppkey") == F.col("n_k"))
        name = F.when(n == 7, text("Missing", F.col("l_suppkey"))).when(n == 6, text("Lib", F.col("l_suppkey"))).otherwise(F.col("n_short"))
        return rows.select("k", name.alias("name"), "line", (n * 4).cast("int").alias("col"))

    @cached_property
    def numbered_imports(self) -> DataFrame:
        """imports by the number of the file's type, dealt out by it: k, ordinal, import_text, is_wildcard."""
        lib = self.external_types.where("not needs_decompilation").select("s", F.col("fqn").alias("import_text"))
        few = self.table("supplier").count() <= BROADCAST_NAMES
        pairs = self.lines.select(F.col("l_partkey").alias("k"), "l_suppkey", (F.col("l_linenumber") == 7).alias("seven")).where("k is not null").repartition("k")
        known = pairs.select("k", "l_suppkey").distinct().join(F.broadcast(lib) if few else lib, F.col("l_suppkey") == F.col("s"))
        known = known.select("k", F.col("l_suppkey").alias("ordinal"), "import_text", F.lit(False).alias("is_wildcard"))
        gone = pairs.where("seven and l_suppkey % 2 = 0").select("k", "l_suppkey").distinct().select("k", (F.col("l_suppkey") + 1_000_000).alias("ordinal"), text("gone.pkg.Missing", F.col("l_suppkey")).alias("import_text"), F.lit(False).alias("is_wildcard"))
        other = self.types.select(F.col("k").alias("o_k"), F.col("package_name").alias("o_pkg"))
        wild = self.types.select("k").join(other, F.floor(F.col("k") / 2) == F.col("o_k")).select("k", F.lit(2_000_000).cast("long").alias("ordinal"), text(F.col("o_pkg"), ".*").alias("import_text"), F.lit(True).alias("is_wildcard"))
        return known.unionByName(gone).unionByName(wild)

    @property
    def asked_names(self) -> DataFrame:
        """name: every name of numbered_refs, and some that a line's supplier key could have given."""
        n_k = F.col("n_k")
        return self.mentioned.select(F.explode(F.array("n_short", text("Lib", n_k), text("Missing", n_k))).alias("name"))

    def resolved_refs(self, strict: bool = False) -> DataFrame:
        """file_path, package_name, name, fqn, priority of type_refs' names, and k, the number of the file's type, where there is one."""
        if not self.numbered:
            return resolve.resolve_fqn(self.type_refs, self.imports, self.symbols, self.external_symbols, strict)
        at = self.types.select("k", "file_path", "package_name")
        names = self.asked_names
        refs = self.numbered_refs.join(at.drop("file_path"), "k")
        types = self.types.select("fqn", "kind")
        return resolve.resolve_fqn(refs, self.numbered_imports, types, self.external_types, strict, "k", names).join(at.drop("package_name"), "k")

    @cached_property
    def type_refs(self) -> DataFrame:
        """file_path, package_name, name, line, col: a mention of a type by its short name."""
        at = self.types.select("k", "file_path", "package_name")
        if self.numbered:
            return self.numbered_refs.join(at, "k").select("file_path", "package_name", "name", "line", "col")
        named = self.types.select(F.col("k").alias("n_k"), F.col("short_name").alias("n_short"))
        n = F.col("l_linenumber")
        rows = self.lines.join(at, F.col("l_partkey") == F.col("k")).join(named, F.col("l_suppkey") == F.col("n_k"))
        name = F.when(n == 7, text("Missing", F.col("l_suppkey"))).when(n == 6, text("Lib", F.col("l_suppkey"))).otherwise(F.col("n_short"))
        return rows.select("file_path", "package_name", name.alias("name"), (F.col("l_orderkey") % 1000).cast("int").alias("line"), (n * 4).cast("int").alias("col")).distinct()

    @cached_property
    def call_sites(self) -> DataFrame:
        """site keys (l_orderkey, l_linenumber, l_partkey, l_suppkey), file_path, language, receiver, method, argc, arg_kinds."""
        at = self.types.select("k", "file_path", "language")
        project = self.types.select(F.col("k").alias("p_k"), F.col("fqn").alias("p_fqn"))
        lib = self.external_types.where("not needs_decompilation").select("s", F.col("fqn").alias("e_fqn"))
        o, n = F.col("l_orderkey"), F.col("l_linenumber")
        rows = self.lines.drop("l_quantity").distinct().join(at, F.col("l_partkey") == F.col("k")).join(project, F.col("l_suppkey") == F.col("p_k")).join(lib, F.col("l_suppkey") == F.col("s"))
        kinds = F.transform(F.expr("if(l_linenumber % 4 = 0, cast(array() as array<bigint>), sequence(0L, cast(l_linenumber % 4 as bigint) - 1))"), lambda i: pick(ARG_KINDS, o + i))
        return rows.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "file_path", "language",
            F.when(n == 6, F.col("e_fqn")).otherwise(F.col("p_fqn")).alias("receiver"),
            F.when(n == 6, text("x", o % 8)).otherwise(text("m", o % 25)).alias("method"),
            (n % 4).cast("int").alias("argc"),
            kinds.alias("arg_kinds"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """uri, kind, version, ts of editor events."""
        kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "change").when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "signup", "watched").otherwise("delete")
        return self.table("events").select(F.col("user_id").alias("uri"), kind.alias("kind"), F.col("event_id").alias("version"), "ts")
