"""Diagnostics as relations: each rule gives the rows it objects to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hierarchy import OBJECT_METHODS, nearest_return, reachable_names, required_methods
from .resolve import resolve_fqn

# Names that are never references to types, return types that constrain nothing, numeric widths,
# and the parameter types that each kind of literal argument can be passed to (besides type variables).
BUILT_IN = ("int", "long", "short", "byte", "char", "float", "double", "boolean", "void", "var", "val", "def", "String", "Object", "Any", "Unit", "Nothing")
UNCONSTRAINED = ("void", "Unit", "Object", "Any", "V", "T", "R", "E")
WIDTH = {"byte": 1, "short": 2, "char": 2, "int": 3, "long": 4, "float": 5, "double": 6}
ACCEPTS = {"int_literal": ("int", "long", "float", "double", "Integer"), "string_literal": ("String", "CharSequence"), "char_literal": ("char", "int", "Character"), "null_literal": ()}
PRIMITIVE = ("int", "long", "short", "byte", "char", "float", "double", "boolean")


def duplicate_import(imports: DataFrame) -> DataFrame:
    """Second and later occurrences of one import text in a file."""
    w = Window.partitionBy("file_path", "import_text").orderBy("ordinal")
    return imports.withColumn("n", F.row_number().over(w)).where("n > 1").select("file_path", "ordinal", "import_text")


def duplicate_method_signature(members: DataFrame, order: list[str]) -> DataFrame:
    """Functions whose name and parameter types an earlier one in the same type has."""
    w = Window.partitionBy("parent_name", "short_name", F.array_join("param_types", ",")).orderBy(*order)
    return members.where("kind = 'Function'").withColumn("n", F.row_number().over(w)).where("n > 1").drop("n")


def is_skippable(name: Column) -> Column:
    return name.isin(*BUILT_IN) | name.rlike("^[A-Z]$")


def unresolved_symbol(refs: DataFrame, imports: DataFrame, symbols: DataFrame, external: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """References that resolve strictly to a name which neither table holds. declared(file_path, name): local types."""
    asked = refs.where(~is_skippable(F.col("name")))
    if declared is not None:
        asked = asked.join(declared, ["file_path", "name"], "left_anti")
    known = symbols.select("fqn").unionByName(external.select("fqn")).distinct()
    gone = resolve_fqn(asked, imports, symbols, external, strict=True).join(known, "fqn", "left_anti").select("file_path", "name", "fqn")
    return asked.join(gone, ["file_path", "name"])


def final_class_extended(types: DataFrame, supers: DataFrame) -> DataFrame:
    own = types.where(~F.array_contains("modifiers", "abstract")).select(F.col("fqn").alias("symbol_fqn"), "file_path")
    closed = types.where(F.array_contains("modifiers", "final")).select(F.col("fqn").alias("super_fqn"))
    return supers.join(closed, "super_fqn").join(own, "symbol_fqn").select("file_path", "symbol_fqn", "super_fqn")


def implements(child: Column, parent: Column) -> Column:
    """Parameter lists of equal length whose types agree, a type-variable look-alike of the parent agreeing with any."""
    return (F.size(child) == F.size(parent)) & F.forall(F.zip_with(child, parent, lambda c, p: (c == p) | p.rlike("^[A-Z][0-9]*$")), lambda ok: ok)


def unimplemented_methods(types: DataFrame, supers: DataFrame, members: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Required signatures of a direct parent that a concrete class does not declare itself. parents(fqn, kind) are the
    types that can be parents, those of the project unless told; with library types among them, members has theirs too."""
    concrete = types.where((F.col("kind") == "Class") & ~F.array_contains("modifiers", "abstract")).select(F.col("fqn").alias("symbol_fqn"))
    needed = required_methods(types if parents is None else parents, members).select(F.col("parent_name").alias("super_fqn"), F.col("short_name").alias("method"), F.col("param_types").alias("needed")).distinct()
    asked = supers.join(concrete, "symbol_fqn").join(needed, "super_fqn")
    own = members.where("kind = 'Function'").select(F.col("parent_name").alias("o_fqn"), F.col("short_name").alias("o_name"), F.col("param_types").alias("o_params")).distinct()
    return asked.join(own, (F.col("symbol_fqn") == F.col("o_fqn")) & (F.col("method") == F.col("o_name")) & implements(F.col("o_params"), F.col("needed")), "left_anti").select("symbol_fqn", "super_fqn", "method", "needed")


def abstract_instantiated(creations: DataFrame, types: DataFrame) -> DataFrame:
    """creations(file_path, language, type_fqn, ...): new on a type whose modifiers hold abstract. Kotlin has no new."""
    closed = types.where(F.array_contains("modifiers", "abstract")).select(F.col("fqn").alias("type_fqn"))
    return creations.where("language <> 'kotlin'").join(closed, "type_fqn")


def method_not_found(sites: DataFrame, reach: DataFrame, members: DataFrame, types: DataFrame) -> DataFrame:
    """Java call sites on a known project type that neither has nor inherits a member of the name, from libraries either
    if reach and members hold them."""
    asked = sites.where((F.col("language") == "java") & ~F.col("method").isin(*OBJECT_METHODS)).join(types.select(F.col("fqn").alias("receiver")), "receiver", "left_semi")
    names = reachable_names(reach, members).select(F.col("type_fqn").alias("receiver"), F.col("name").alias("method"))
    return asked.join(names, ["receiver", "method"], "left_anti")


def _access(sites: DataFrame, members: DataFrame) -> DataFrame:
    own = members.groupBy(F.col("parent_name").alias("receiver"), F.col("short_name").alias("method")).agg(
        F.bool_and(F.array_contains("modifiers", "private")).alias("all_private"), F.bool_or(F.array_contains("modifiers", "static")).alias("any_static")
    )
    return sites.join(own, ["receiver", "method"])


def inaccessible_member(sites: DataFrame, members: DataFrame) -> DataFrame:
    """Every direct overload is private."""
    return _access(sites, members).where("all_private").drop("all_private", "any_static")


def static_via_instance(sites: DataFrame, members: DataFrame) -> DataFrame:
    """Some direct overload is static; sites that inaccessible_member objects to are left to it."""
    return _access(sites, members).where("any_static and not all_private").drop("all_private", "any_static")


def wrong_type_argument_count(usages: DataFrame, declared: DataFrame) -> DataFrame:
    """usages(type_fqn, n_args), declared(type_fqn, n_type_params): counts that differ, where the declaration is generic."""
    return usages.join(declared, "type_fqn").where("n_type_params > 0 and n_args <> n_type_params")


def base_type(col: Column) -> Column:
    """Without type arguments and nullability."""
    return F.trim(F.rtrim(F.substring_index(col, "<", 1), F.lit("?")))


def override_incompatible(members: DataFrame, closed: DataFrame) -> DataFrame:
    """Functions whose return type differs from the nearest ancestor's of that name, where both constrain."""
    own = members.where("kind = 'Function' and return_type is not null").groupBy(F.col("parent_name").alias("type_fqn"), F.col("short_name").alias("name")).agg(F.min("return_type").alias("own_return"))
    above = nearest_return(closed.select("child", "ancestor", "depth", "path"), members)
    return own.join(above, ["type_fqn", "name"]).where((base_type(F.col("own_return")) != base_type(F.col("return_type"))) & ~base_type(F.col("own_return")).isin(*UNCONSTRAINED) & ~base_type(F.col("return_type")).isin(*UNCONSTRAINED))


def width(col: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, w in WIDTH.items():
        out = F.when(col == name, w).otherwise(out)
    return out


def narrowing_conversion(candidates: DataFrame) -> DataFrame:
    """candidates(declared_type, rhs_type, language): a wider number into a narrower variable. Kotlin never converts."""
    return candidates.where((F.col("language") != "kotlin") & (width(F.col("rhs_type")) > width(F.col("declared_type"))))


def accepts(kind: Column, param: Column) -> Column:
    """Whether an argument of a literal kind can be passed to a parameter; null for kinds that say nothing."""
    variable = param.rlike("^[A-Z][0-9]*$") | param.isin("Object", "Any")
    out = F.when(kind == "null_literal", ~param.isin(*PRIMITIVE))
    for k, types in ACCEPTS.items():
        if types:
            out = out.when(kind == k, param.isin(*types) | variable)
    return out


def wrong_argument_types(sites: DataFrame, members: DataFrame, site: list[str]) -> DataFrame:
    """Sites whose argument kinds are all known and which no direct overload accepts."""
    known = F.forall("arg_kinds", lambda k: k.isin(*ACCEPTS))
    asked = sites.where(known)
    own = members.where("kind = 'Function'").select(F.col("parent_name").alias("receiver"), F.col("short_name").alias("method"), "param_types").distinct()
    fits = (F.size("param_types") == F.size("arg_kinds")) & F.forall(F.zip_with("arg_kinds", "param_types", accepts), lambda ok: F.coalesce(ok, F.lit(False)))
    return asked.join(own, ["receiver", "method"]).groupBy("receiver", "method", *site).agg(F.bool_or(fits).alias("any")).where("not any").drop("any")


def unused_import(imports: DataFrame, bodies: DataFrame) -> DataFrame:
    """imports(file_path, import_text, alias?, is_wildcard), bodies(file_path, token): non-wildcard imports whose name no token of the body equals."""
    name = F.coalesce("alias", F.substring_index("import_text", ".", -1)) if "alias" in imports.columns else F.substring_index("import_text", ".", -1)
    return imports.where("not is_wildcard").withColumn("token", name).join(bodies.select("file_path", "token").distinct(), ["file_path", "token"], "left_anti").drop("token")
