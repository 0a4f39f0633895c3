"""The whole way: files and libraries in, answers for relations of cursors out."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import stored
from .functions import strings
from .operators import diagnostics as dia
from .operators import hierarchy, lookups, positions, requests, resolve
from .operators.rank import completion_rank, first_by, union_all
from .progress import Progress
from .sources import workspace

#: Names up to which a counted list of them is broadcast.
BROADCAST_NAMES = 100_000
EXTERNAL = "fqn string, short_name string, package_name string, parent_name string, jar_path string, needs_decompilation boolean, kind string"


class Engine:
    """Answers requests over one snapshot of sources.

    files(path, language, text) as workspace.scan_workspace gives them; external symbols under lookup columns (see
    external_view), none if left out. Parsed facts are stored once; everything else is a query over them.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, external: DataFrame | None = None, progress: Progress | None = None) -> None:
        self.spark, self.files = spark, files
        self.progress = progress or Progress(lambda row: None)
        self.external = external if external is not None else spark.createDataFrame([], EXTERNAL)

    @classmethod
    def of_workspace(cls, spark: SparkSession, root: str, external: DataFrame | None = None, buffers: DataFrame | None = None) -> Engine:
        files = workspace.scan_workspace(spark, root)
        return cls(spark, workspace.with_buffers(files, buffers, root) if buffers is not None else files, external)

    @staticmethod
    def external_view(entries: DataFrame) -> DataFrame:
        """Rows of archive.scan_jars under the lookup columns."""
        s = entries.select(F.explode("symbols").alias("s")).select("s.*")
        return s.select(
            F.col("fully_qualified_name").alias("fqn"), "short_name", "package_name", "parent_name", "jar_path", "needs_decompilation", F.col("symbol_type").alias("kind"), "modifiers",
            F.transform("metadata.parameters", lambda p: p["type_name"]).alias("param_types"), F.col("metadata.return_type").alias("return_type"), F.size("metadata.type_params").alias("n_type_params"),
        )

    # -- the index --

    @cached_property
    def parsed(self) -> DataFrame:
        with self.progress.step("parse") as step:
            return stored(step.counted(workspace.parse(self.files), "files", errors=F.count("error")), "parsed")

    @cached_property
    def symbols(self) -> DataFrame:
        return stored(workspace.lookup_view(workspace.symbols(self.parsed)), "symbols")

    @property
    def types(self) -> DataFrame:
        return self.symbols.where(~F.col("kind").isin("Function", "Field"))

    @property
    def members(self) -> DataFrame:
        return self.symbols.where(F.col("kind").isin("Function", "Field"))

    @cached_property
    def all_members(self) -> DataFrame:
        """Members of the project and, below them, of the libraries."""
        return stored(lookups.with_external(self.members, self.external), "all-members")

    @cached_property
    def imports(self) -> DataFrame:
        return stored(workspace.facts(self.parsed, "imports").select(F.col("path").alias("file_path"), "ordinal", "import_text", "is_wildcard"), "imports")

    @cached_property
    def _joint(self) -> tuple[DataFrame, DataFrame]:
        """Edges and closure: parents that the context of their file settles, project ones and known libraries, and those
        that the types around the child declare or inherit."""
        typed = self.types.select("fqn", "short_name", "parent_name").unionByName(self.external.where(~F.col("kind").isin("Function", "Field")).select("fqn", "short_name", "parent_name"))
        nested = typed.where(F.col("fqn") == F.concat("parent_name", F.lit("#"), "short_name")).select(F.col("parent_name").alias("owner"), F.col("short_name").alias("name"), "fqn").distinct()
        # a.B#C#D stands in a.B#C (1) and a.B (2)
        parts = F.split("fqn", "#")
        around = self.types.where(F.contains("fqn", F.lit("#"))).select(F.col("fqn").alias("child"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "#").alias("scope")))).alias("s"))
        own = self._declared_edges.select(F.col("symbol_fqn").alias("child"), F.col("super_short_name").alias("name"), F.col("super_fqn").alias("parent"), "ordinal").distinct()
        return hierarchy.joint_closure(own, nested, around.select("child", "s.scope", "s.level").distinct())

    @property
    def edges(self) -> DataFrame:
        """symbol_fqn, super_short_name, super_fqn, ordinal: a parent that nothing settles has no super_fqn."""
        return self._joint[0].select(F.col("child").alias("symbol_fqn"), F.col("name").alias("super_short_name"), F.col("parent").alias("super_fqn"), "ordinal")

    @cached_property
    def _declared_edges(self) -> DataFrame:
        """The same, parents resolved in the context of their file alone."""
        d = workspace.facts(self.parsed, "class_decls").select(F.col("path").alias("file_path"), F.col("package").alias("package_name"), F.col("name").alias("short_name"), F.col("line").alias("d_line"), F.posexplode("parents").alias("ordinal", "name"))
        owned = d.join(self.types.select("file_path", "short_name", "fqn", F.col("line").alias("d_line")), ["file_path", "short_name", "d_line"])
        named = resolve.resolve_fqn(owned.select("file_path", "package_name", "name"), self.imports, self.symbols, self.external, strict=True).select("file_path", "name", F.col("fqn").alias("super_fqn"))
        rows = owned.join(named, ["file_path", "name"], "left").select(F.col("fqn").alias("symbol_fqn"), F.substring_index("name", ".", -1).alias("super_short_name"), "super_fqn", "ordinal")
        return stored(rows, "edges")

    @property
    def closure(self) -> DataFrame:
        return self._joint[1]

    @property
    def reach(self) -> DataFrame:
        return hierarchy.with_self(self.closure, self.types)

    # -- requests: cursors(file_path, line, col) --

    def definition(self, cursors: DataFrame) -> DataFrame:
        """file_path, line, col, name, origin, target."""
        return positions.symbols_at(cursors, self.parsed, self.imports, self.symbols, self.external, self.reach, self.members)

    def locations(self, cursors: DataFrame) -> DataFrame:
        """The definitions with where they stand: target_file, target_line (every overload)."""
        at = self.symbols.select(F.col("fqn").alias("target"), F.col("file_path").alias("target_file"), F.col("line").alias("target_line"))
        return self.definition(cursors).join(at, "target", "left")

    def hover(self, cursors: DataFrame) -> DataFrame:
        """file_path, line, col, markdown: of the first overload by place."""
        params = F.transform("metadata.parameters", lambda p: F.concat_ws(" ", p["type_name"], p["name"]))
        meta = workspace.symbols(self.parsed).select(
            F.col("fully_qualified_name").alias("target"), "line_start",
            strings.hover(F.col("file_type"), F.col("package_name"), F.col("short_name"), F.col("symbol_type"), F.col("modifiers"), params, F.col("metadata.return_type"), F.col("metadata.documentation")).alias("markdown"),
        )
        return self.definition(cursors).join(first_by(meta, ["target"], ["line_start", "markdown"]), "target").select("file_path", "line", "col", "markdown")

    def implementations(self, cursors: DataFrame) -> DataFrame:
        """file_path, line, col, target: implementers of the type, or of the method with as many parameters, at each cursor."""
        found = self.definition(cursors).select("file_path", "line", "col", F.col("target").alias("asked"))
        types = requests.implementations_of_types(self.types, self.edges)
        methods = requests.implementations_of_methods(self.members, types).select(F.concat("type_fqn", F.lit("#"), "method").alias("asked"), "target")
        return found.join(types.select(F.col("type_fqn").alias("asked"), F.col("symbol_fqn").alias("target")).unionByName(methods), "asked").select("file_path", "line", "col", "target").distinct()

    def mentions(self, names: DataFrame) -> DataFrame:
        """names(name) -> every identifier of that name outside comments and strings: file_path, line, col, name."""
        asked = stored(names.select("name").distinct(), "names")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_NAMES else asked
        return workspace.facts(self.parsed, "idents").join(asked, "name", "left_semi").select(F.col("path").alias("file_path"), "line", "col", "name")

    def references(self, cursors: DataFrame) -> DataFrame:
        """target, file_path, line, col: mentions that resolve to what stands at the cursors, and its declarations."""
        return self._uses(cursors, self._asked(cursors))

    def _asked(self, cursors: DataFrame) -> DataFrame:
        """name, target, origin of what stands at the cursors."""
        return stored(self.definition(cursors).select("name", "target", "origin").union(self._declared_at(cursors)).distinct(), "asked")

    def _uses(self, cursors: DataFrame, asked: DataFrame) -> DataFrame:
        """Mentions and declarations of asked(name, target, origin); local ones are those of the cursors."""
        local = positions.local_references(cursors, self.parsed).join(asked.where("origin = 'local'").select("name", "target"), "name").select("target", "file_path", "line", "col")
        rest = asked.where("origin <> 'local'")
        found = self.definition(self.mentions(rest).select("file_path", "line", "col")).select("target", "file_path", "line", "col")
        declared = workspace.symbols(self.parsed).select(F.col("fully_qualified_name").alias("target"), "file_path", F.col("ident_line_start").alias("line"), F.col("ident_char_start").alias("col"))
        return found.unionByName(declared).join(rest.select("target").distinct(), "target", "left_semi").unionByName(local).distinct()

    def _declared_at(self, cursors: DataFrame) -> DataFrame:
        """name, target, origin of declarations whose identifier a cursor touches."""
        s = workspace.symbols(self.parsed).select("file_path", F.col("fully_qualified_name").alias("fqn"), "short_name", F.col("ident_line_start").alias("ident_line"), F.col("ident_char_start").alias("ident_start"), F.col("ident_char_end").alias("ident_end"))
        return requests.declarations_at(cursors, s).select(F.col("short_name").alias("name"), F.col("fqn").alias("target"), F.lit("project").alias("origin"))

    @cached_property
    def components(self) -> DataFrame:
        """fqn, component: project types linked upwards or downwards."""
        own = self.types.select(F.col("fqn").alias("super_fqn")).distinct()
        return hierarchy.component(self.edges.join(own, "super_fqn", "left_semi").select(F.col("symbol_fqn").alias("child"), F.col("super_fqn").alias("parent")))

    def _renamed(self, asked: DataFrame, new_name: str) -> DataFrame:
        """name, target, origin, new_text: what goes with the symbols asked for. A function takes those of its name and
        signature in its hierarchy along, a field its accessors; constructors are mentions of their type."""
        own = self.members.join(asked.select(F.col("target").alias("fqn")).distinct(), "fqn", "left_semi")
        group = requests.hierarchy_functions(own.where("kind = 'Function'").select("parent_name", "short_name", "param_types"), self.components, self.members)
        cap, new = strings.capitalise(F.col("short_name")), strings.capitalise(F.lit(new_name))
        pairs = F.explode(F.array(*(F.struct(F.concat(F.lit(p), cap).alias("name"), F.concat(F.lit(p), new).alias("new_text")) for p in ("get", "set", "is")))).alias("a")
        wanted = own.where("kind = 'Field'").select("parent_name", pairs).select("parent_name", F.col("a.name").alias("short_name"), F.col("a.new_text").alias("new_text")).distinct()
        accessors = self.members.where("kind = 'Function'").join(wanted, ["parent_name", "short_name"])
        cols = [F.col("short_name").alias("name"), F.col("fqn").alias("target"), F.lit("project").alias("origin")]
        same = asked.select("name", "target", "origin").unionByName(group.select(*cols)).withColumn("new_text", F.lit(new_name))
        # an accessor that is asked for itself takes the name it is given
        return stored(same.unionByName(accessors.select(*cols, "new_text").join(asked.select("target"), "target", "left_anti")).distinct(), "renamed")

    def rename(self, cursors: DataFrame, new_name: str) -> DataFrame:
        """file_path, line, col, new_text. A name that some file's language does not allow gives no edits; libraries are left alone."""
        renamed = self._renamed(self._asked(cursors), new_name)
        uses = stored(self._uses(cursors, renamed.select("name", "target", "origin")), "references").join(self.external.select(F.col("fqn").alias("target")).distinct(), "target", "left_anti")
        found = uses.join(renamed.select("target", "new_text").distinct(), "target")
        language = workspace.language_of(F.col("file_path"))
        allowed = found.select(F.min(strings.is_valid_identifier(F.lit(new_name), language)).alias("ok"))
        return requests.edits(found.join(F.broadcast(allowed.where("ok")), how="left_semi"))

    def complete(self, prefixes: DataFrame) -> DataFrame:
        """prefixes(prefix, package_name) -> types to offer, ranked."""
        return requests.complete_prefixes(prefixes, self.types, self.external)

    def complete_members(self, receivers: DataFrame) -> DataFrame:
        """receivers(receiver, jars) -> members to offer."""
        return requests.complete_members(receivers, self.members, self.external)

    def complete_at(self, cursors: DataFrame) -> DataFrame:
        """file_path, line, col, mode, name, fqn, origin, rank: after a dot the members of what stands before it, that of a
        local variable's type or of a type, whose names begin as written; elsewhere types by prefix. Members rank alike."""
        at = ["file_path", "line", "col"]
        text = self.files.select(F.col("path").alias("file_path"), "text").join(self.parsed.select(F.col("path").alias("file_path"), F.col("package").alias("package_name")), "file_path")
        line = F.coalesce(F.get(F.split("text", "\n"), F.col("line")), F.lit(""))
        here = cursors.select(*at).distinct().join(text, "file_path").withColumn("here", line)
        here = here.select(*at, "package_name", strings.after_dot(F.col("here"), F.col("col")).alias("dotted"), strings.receiver_at(F.col("here"), F.col("col")).alias("receiver"), strings.prefix_at(F.col("here"), F.col("col")).alias("prefix"))
        here = stored(here, "cursors")
        # members: the receiver is a variable in sight, else a type
        asked = here.where("dotted and receiver <> ''").select("file_path", "package_name", F.col("receiver").alias("name"), F.lit(False).alias("is_qualified"), F.col("line").alias("n_line"), F.col("col").alias("n_col"), "prefix")
        typed = positions.local_declarations(asked, self.parsed).select("file_path", "n_line", "n_col", F.regexp_replace("type_name", r"<.*|\?$", "").alias("type_name"))
        owned = asked.join(typed, ["file_path", "n_line", "n_col"], "left").withColumn("name", F.coalesce("type_name", "name"))
        fqns = resolve.resolve_fqn(owned.select("file_path", "package_name", "name"), self.imports, self.symbols, self.external).select("file_path", "name", F.col("fqn").alias("receiver"))
        owned = stored(owned.join(fqns, ["file_path", "name"]).select("file_path", F.col("n_line").alias("line"), F.col("n_col").alias("col"), "prefix", "receiver"), "receivers")
        offered = self.complete_members(owned.select("receiver", F.expr("cast(array() as array<string>)").alias("jars")).distinct())
        members = owned.join(offered, "receiver").where(F.col("short_name").startswith(F.col("prefix"))).select(*at, F.lit("member").alias("mode"), F.col("short_name").alias("name"), "fqn", "origin", F.lit(0).alias("rank"))
        plain = here.where("not dotted and prefix <> ''").select(*at, "prefix", "package_name")
        # a prefix is asked for once in each package that asks for it
        keyed = plain.withColumn("own_package", F.coalesce("package_name", F.lit("")))
        found = self.complete(keyed.select("prefix", F.lit(None).cast("string").alias("package_name")).distinct()).select("prefix", "fqn", "origin")
        place = self.types.select("fqn", "package_name").unionByName(self.external.select("fqn", "package_name")).groupBy("fqn").agg(F.min("package_name").alias("of"))
        types = keyed.join(found, "prefix").join(place, "fqn").withColumn("rank", completion_rank(F.col("origin"), F.col("of"), F.col("own_package")))
        return members.unionByName(types.select(*at, F.lit("prefix").alias("mode"), F.regexp_extract("fqn", r"[^.#]*$", 0).alias("name"), "fqn", "origin", "rank"))

    # -- diagnostics --

    def _typed_sites(self) -> DataFrame:
        """Call sites whose receiver is a local variable or a type that resolves: file_path, language, line, col, receiver, method, arg_kinds."""
        calls = workspace.facts(self.parsed, "calls").where("receiver is not null").select(
            F.col("path").alias("file_path"), "language", F.col("package").alias("package_name"), F.col("receiver").alias("name"), F.lit(False).alias("is_qualified"), F.col("line").alias("n_line"), F.col("col").alias("n_col"), "method",
            F.transform("args", lambda a: F.when(a["kind"].isin("int", "string", "char", "null"), F.concat(a["kind"], F.lit("_literal"))).otherwise("identifier")).alias("arg_kinds"),
        )
        variables = positions.local_declarations(calls, self.parsed).select("file_path", "package_name", "language", "n_line", "n_col", "method", "arg_kinds", F.regexp_replace("type_name", r"<.*|\?$", "").alias("name")).where("name is not null")
        named = resolve.resolve_fqn(variables.select("file_path", "package_name", "name"), self.imports, self.symbols, self.external, strict=True).select("file_path", "name", F.col("fqn").alias("receiver"))
        return variables.join(named, ["file_path", "name"]).select("file_path", "language", F.col("n_line").alias("line"), F.col("n_col").alias("col"), "receiver", "method", "arg_kinds")

    def _counted_arguments(self) -> tuple[DataFrame, DataFrame]:
        """usages(file_path, line, col, type_fqn, n_args), declared(type_fqn, n_type_params): of libraries, as sources do
        not state it in the index, and only where no project type has the name."""
        g = workspace.facts(self.parsed, "generic_usages").select(F.col("path").alias("file_path"), F.col("package").alias("package_name"), F.col("type_name").alias("name"), "n_args", "line", "col")
        named = resolve.resolve_fqn(g.select("file_path", "package_name", "name").distinct(), self.imports, self.symbols, self.external, strict=True).select("file_path", "name", F.col("fqn").alias("type_fqn"))
        if "n_type_params" not in self.external.columns:
            return g.join(named, ["file_path", "name"]), self.spark.createDataFrame([], "type_fqn string, n_type_params int")
        known = self.external.where("n_type_params > 0").groupBy(F.col("fqn").alias("type_fqn")).agg(F.max("n_type_params").alias("n_type_params"))
        return g.join(named, ["file_path", "name"]), known.join(self.types.select(F.col("fqn").alias("type_fqn")), "type_fqn", "left_anti")

    def _narrowed(self) -> DataFrame:
        """Numeric variables that are given another variable: file_path, language, line, col, declared_type, rhs_type."""
        n = workspace.facts(self.parsed, "narrowing").select(F.col("path").alias("file_path"), "language", F.col("rhs_name").alias("name"), F.lit(False).alias("is_qualified"), F.col("line").alias("n_line"), F.col("col").alias("n_col"), "declared_type")
        return positions.local_declarations(n, self.parsed).select("file_path", "language", F.col("n_line").alias("line"), F.col("n_col").alias("col"), "declared_type", F.col("type_name").alias("rhs_type"))

    def diagnostics(self) -> DataFrame:
        """file_path, line, col, code, severity, subject: the rules of the parser and those that need the index."""
        sites = stored(self._typed_sites(), "sites")
        place = self.types.select("file_path", F.col("fqn").alias("symbol_fqn"), "line")
        refs = workspace.facts(self.parsed, "type_refs").select(F.col("path").alias("file_path"), F.col("package").alias("package_name"), "name", "line", "col")
        new = workspace.facts(self.parsed, "creations").select(F.col("path").alias("file_path"), "language", F.col("package").alias("package_name"), F.col("type_name").alias("name"), "line", "col")
        made = new.join(resolve.resolve_fqn(new, self.imports, self.symbols, self.external, strict=True).select("file_path", "name", F.col("fqn").alias("type_fqn")), ["file_path", "name"])

        def row(df: DataFrame, code: str, subject: str | Column, severity: str = "error") -> DataFrame:
            line = F.col("line") if "line" in df.columns else F.lit(0)
            col = F.col("col") if "col" in df.columns else F.lit(0)
            return df.select("file_path", line.cast("int").alias("line"), col.cast("int").alias("col"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"))

        library = self.external.where(~F.col("kind").isin("Function", "Field")).select("fqn", "kind")
        parents = self.types.select("fqn", "kind").unionByName(library.join(self.types.select("fqn"), "fqn", "left_anti")).distinct()
        declared = workspace.facts(self.parsed, "declared_types").select(F.col("path").alias("file_path"), "name").distinct()
        own = workspace.facts(self.parsed, "diagnostics").select(F.col("path").alias("file_path"), F.col("line_start").alias("line"), F.col("char_start").alias("col"), "code", "severity", F.col("message").alias("subject"))
        keys = ["file_path", "line", "col"]
        return union_all(
            own,
            row(dia.unresolved_symbol(refs, self.imports, self.symbols, self.external, declared), "unresolved_symbol", "fqn"),
            row(dia.final_class_extended(self.types, self.edges).join(place.drop("file_path"), "symbol_fqn"), "final_class_extended", "super_fqn"),
            row(dia.unimplemented_methods(self.types, self.edges, self.all_members, parents).join(place, "symbol_fqn"), "unimplemented_abstract_methods", F.concat("method", F.lit("("), F.array_join("needed", ", "), F.lit(")"))),
            row(dia.abstract_instantiated(made, self.types), "abstract_class_instantiated", "type_fqn"),
            row(dia.method_not_found(sites, self.reach, self.all_members, self.types), "method_not_found", "method"),
            row(dia.inaccessible_member(sites, self.all_members), "inaccessible_member", "method"),
            row(dia.static_via_instance(sites, self.all_members), "static_member_via_instance", "method", "warning"),
            row(dia.wrong_argument_types(sites, self.all_members.where("param_types is not null"), keys), "wrong_argument_types", "method"),
            row(dia.wrong_type_argument_count(*self._counted_arguments()), "wrong_type_argument_count", "type_fqn"),
            row(dia.narrowing_conversion(self._narrowed()), "narrowing_conversion", F.concat_ws(" ", "rhs_type", F.lit("to"), "declared_type")),
            row(dia.override_incompatible(self.all_members, self.closure).join(place.withColumnRenamed("symbol_fqn", "type_fqn"), "type_fqn"), "override_incompatible_signature", "name"),
        )
