"""What stands at a position of a parsed file, for all cursors of a corpus, and references of local names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..sources.workspace import facts
from .rank import first_by, prioritised, union_all
from .resolve import resolve_fqn, resolve_members
from .spans import around


def _names(parsed: DataFrame) -> DataFrame:
    return facts(parsed, "idents").select(F.col("path").alias("file_path"), "package", "name", "is_qualified", "line", "col")


def _hit(cursors: DataFrame, names: DataFrame) -> DataFrame:
    """cursors(file_path, line, col) with the identifier they touch; the line is an equi-key."""
    c = cursors.select(F.col("file_path").alias("c_path"), F.col("line").alias("c_line"), F.col("col").alias("c_col"))
    at = (names["file_path"] == F.col("c_path")) & (names["line"] == F.col("c_line")) & F.col("c_col").between(names["col"], names["col"] + F.length(names["name"]))
    return first_by(c.join(names, at), ["c_path", "c_line", "c_col"], [F.col("col").desc()]).select("file_path", F.col("package").alias("package_name"), "name", "is_qualified", "c_line", "c_col", F.col("line").alias("n_line"), F.col("col").alias("n_col"))


def local_declarations(hits: DataFrame, parsed: DataFrame) -> DataFrame:
    """Of the declarations of the name whose scope holds it and that stand before it, the innermost."""
    scopes = facts(parsed, "scope_decls").select(
        F.col("path").alias("s_path"), F.col("name").alias("s_name"), "type_name", F.col("line").alias("d_line"), F.col("col").alias("d_col"), "scope_line_start", "scope_char_start", "scope_line_end", "scope_char_end"
    )
    hits = hits.where("not is_qualified").select(*hits.columns, F.col("file_path").alias("s_path"), F.col("name").alias("s_name"))
    keys = ["s_path", "s_name"]
    within = around(hits, scopes, keys, ("n_line", "n_col"), ("scope_line_start", "scope_char_start", "scope_line_end", "scope_char_end"))
    # a name's own declaration may stand outside of the scope that it opens
    itself = hits.join(scopes.withColumns({"n_line": F.col("d_line"), "n_col": F.col("d_col")}), [*keys, "n_line", "n_col"])
    both = within.unionByName(itself)
    return first_by(both, ["file_path", "n_line", "n_col"], [F.col("scope_line_start").desc(), F.col("scope_char_start").desc(), F.col("d_line").desc(), F.col("d_col").desc()]).drop("s_path", "s_name")


def symbols_at(cursors: DataFrame, parsed: DataFrame, imports: DataFrame, symbols: DataFrame, external: DataFrame, reach: DataFrame, members: DataFrame) -> DataFrame:
    """file_path, line, col, name, origin, target: a type, else a member of a receiver whose type is known, else a local, else a name of the package.

    imports(file_path, ordinal, import_text, is_wildcard) hold implicit ones first. Receivers are single names of
    local variables or types; longer chains go through the chain resolver.
    """
    keys = ["file_path", "c_line", "c_col"]
    out = [*keys, "name", "origin", "target"]
    # what several branches read is stored, so that no branch plans or does the work of another again
    hits = stored(_hit(cursors, _names(parsed)), "hits")
    types = facts(parsed, "type_refs").select(F.col("path").alias("t_path"), F.col("line").alias("t_line"), F.col("col").alias("t_col"))
    typed = hits.join(types, (F.col("file_path") == F.col("t_path")) & (F.col("n_line") == F.col("t_line")) & (F.col("n_col") == F.col("t_col")), "left_semi")
    calls = facts(parsed, "calls").select("path", "receiver", F.col("method").alias("member"), "line", "col").unionByName(facts(parsed, "accesses").select("path", "receiver", "member", "line", "col")).distinct()
    calls = calls.where("receiver is not null").select(F.col("path").alias("a_path"), "receiver", F.col("line").alias("a_line"), F.col("col").alias("a_col"))
    qualified = hits.join(calls, (F.col("file_path") == F.col("a_path")) & (F.col("n_line") == F.col("a_line")) & (F.col("n_col") == F.col("a_col"))).drop("a_path", "a_line", "a_col")
    owners = qualified.select("file_path", "package_name", F.col("receiver").alias("name"), F.lit(False).alias("is_qualified"), "n_line", "n_col").distinct()
    variables = local_declarations(owners, parsed).select("file_path", F.col("name").alias("receiver"), "n_line", "n_col", F.regexp_replace("type_name", r"<.*|\?$", "").alias("type_name"))
    named = stored(qualified.join(variables, ["file_path", "receiver", "n_line", "n_col"], "left").withColumn("owner", F.coalesce("type_name", "receiver")), "named")
    asked = typed.select("file_path", "package_name", "name").unionByName(named.select("file_path", "package_name", F.col("owner").alias("name"))).unionByName(hits.where("not is_qualified").select("file_path", "package_name", "name")).distinct()
    fqns = stored(resolve_fqn(asked, imports, symbols, external).select("file_path", F.col("name").alias("f_name"), "fqn"), "named-types")
    known = symbols.select("fqn", F.lit("project").alias("origin")).unionByName(external.select("fqn", F.lit("external").alias("origin"))).groupBy("fqn").agg(F.max("origin").alias("origin"))
    of_file = fqns.withColumnRenamed("file_path", "f_path")
    by_type = typed.join(of_file, (F.col("file_path") == F.col("f_path")) & (F.col("name") == F.col("f_name"))).select(*keys, "name", F.col("fqn").alias("target"))
    placed = stored(named.join(of_file, (F.col("file_path") == F.col("f_path")) & (F.col("owner") == F.col("f_name"))).select(*keys, F.col("fqn").alias("receiver"), F.col("name").alias("method")), "placed")
    found = stored(resolve_members(placed, reach, members, external).select("receiver", "method", "target"), "found")
    by_member = placed.join(found, ["receiver", "method"]).select(*keys, F.col("method").alias("name"), "target")
    by_name = hits.where("not is_qualified").join(of_file, (F.col("file_path") == F.col("f_path")) & (F.col("name") == F.col("f_name"))).select(*keys, "name", F.col("fqn").alias("target"))
    by_local = local_declarations(hits, parsed).select(*keys, "name", F.lit("local").alias("origin"), F.concat_ws(":", "file_path", "d_line", "d_col").alias("target"))
    # whether the index knows a target is asked once for all branches
    indexed = stored(union_all(by_type.withColumn("way", F.lit(0)), by_member.withColumn("way", F.lit(1)), by_name.withColumn("way", F.lit(2))).join(known.withColumnRenamed("fqn", "target"), "target"), "indexed")
    by_type, by_member, by_name = (indexed.where(F.col("way") == i) for i in range(3))
    got = prioritised(keys, ["target"], *(x.select(*out) for x in (by_type, by_member, by_local, by_name)))
    return got.select("file_path", F.col("c_line").alias("line"), F.col("c_col").alias("col"), "name", "origin", "target")


def local_references(cursors: DataFrame, parsed: DataFrame) -> DataFrame:
    """cursors(file_path, line, col) on local names -> every mention of the same declaration: file_path, line, col, name.

    A mention belongs to its innermost declaration, so names declared again inside are left alone, and so are members.
    """
    names = _names(parsed)
    asked = stored(local_declarations(_hit(cursors, names), parsed).select("file_path", "name", "d_line", "d_col").distinct(), "declared")
    every = names.join(asked.select("file_path", "name").distinct(), ["file_path", "name"], "left_semi").select("file_path", F.col("package").alias("package_name"), "name", "is_qualified", F.col("line").alias("n_line"), F.col("col").alias("n_col"))
    return local_declarations(every, parsed).join(asked, ["file_path", "name", "d_line", "d_col"], "left_semi").select("file_path", F.col("n_line").alias("line"), F.col("n_col").alias("col"), "name").distinct()
