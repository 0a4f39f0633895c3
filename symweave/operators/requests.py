"""Editor requests answered for whole relations of positions: implementations, completion, references, rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import prefix_search_many
from .rank import completion_rank, first_by
from .spans import outside


def implementations_of_types(types: DataFrame, supers: DataFrame) -> DataFrame:
    """Direct implementers of each type: by resolved name, else, for types without any, by short name."""
    asked = types.select(F.col("fqn").alias("type_fqn"), "short_name")
    direct = asked.join(supers, F.col("type_fqn") == F.col("super_fqn")).select("type_fqn", "symbol_fqn", F.lit("fqn").alias("via"))
    rest = asked.join(direct.select("type_fqn").distinct(), "type_fqn", "left_anti")
    loose = rest.join(supers, F.col("short_name") == F.col("super_short_name")).select("type_fqn", "symbol_fqn", F.lit("short_name").alias("via"))
    return direct.unionByName(loose)


def implementations_of_methods(members: DataFrame, implementers: DataFrame) -> DataFrame:
    """Methods of implementers with the name and the number of parameters of a type's method: type_fqn, method, arity, target."""
    own = members.where("kind = 'Function'").select(F.col("parent_name").alias("type_fqn"), F.col("short_name").alias("method"), F.size("param_types").alias("arity")).distinct()
    there = members.where("kind = 'Function'").select("fqn", F.size("param_types").alias("arity")).distinct()
    asked = implementers.select("type_fqn", "symbol_fqn").join(own, "type_fqn").withColumn("fqn", F.concat("symbol_fqn", F.lit("#"), "method"))
    return asked.join(there, ["fqn", "arity"]).select("type_fqn", "method", "arity", F.col("fqn").alias("target")).distinct()


def complete_members(receivers: DataFrame, members: DataFrame, external: DataFrame) -> DataFrame:
    """receivers(receiver, jars): project children if there are any, else external children on the classpath; no <init>."""
    own = receivers.join(members, receivers["receiver"] == members["parent_name"]).where("short_name <> '<init>'").select("receiver", "short_name", "fqn", F.lit("project").alias("origin")).distinct()
    rest = receivers.join(members.select(F.col("parent_name").alias("receiver")).distinct(), "receiver", "left_anti")
    other = rest.join(external, rest["receiver"] == external["parent_name"]).where("(size(jars) = 0 or array_contains(jars, jar_path)) and short_name <> '<init>'").select("receiver", "short_name", "fqn", F.lit("external").alias("origin")).distinct()
    return own.unionByName(other)


def complete_prefixes(prefixes: DataFrame, symbols: DataFrame, external: DataFrame) -> DataFrame:
    """prefixes(prefix, package_name): types by prefix, ranked own package, other project, external; one row per fqn."""
    cols = ["prefix", "fqn", "short_name", "package_name", "origin"]
    found = prefix_search_many(symbols, prefixes).withColumn("origin", F.lit("project")).select(*cols).unionByName(prefix_search_many(external, prefixes).withColumn("origin", F.lit("external")).select(*cols))
    own = prefixes.select("prefix", F.col("package_name").alias("own_package"))
    ranked = found.join(own, "prefix").withColumn("rank", completion_rank(F.col("origin"), F.col("package_name"), F.col("own_package")))
    return first_by(ranked, ["prefix", "fqn"], ["rank"]).select("prefix", "fqn", "origin", "rank")


def declarations_at(cursors: DataFrame, declared: DataFrame) -> DataFrame:
    """cursors(file_path, line, col, ...) inside identifiers of declared(file_path, fqn, ident_line, ident_start, ident_end).

    The file is an equi-key, and so is the line: an identifier stands on one line.
    """
    return cursors.join(declared, (cursors["file_path"] == declared["file_path"]) & (cursors["line"] == declared["ident_line"]) & cursors["col"].between(declared["ident_start"], declared["ident_end"])).drop(declared["file_path"])


def outside_spans(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits(file_path, line, col) not inside spans(file_path, s_line, s_col, e_line, e_col), such as comments and strings."""
    return outside(hits, spans)


def edits(*parts: DataFrame) -> DataFrame:
    """file_path, line, col, new_text: repeated edits once, in order of place."""
    cols = ["file_path", "line", "col", "new_text"]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out.distinct().orderBy(*cols)


def hierarchy_functions(seeds: DataFrame, components: DataFrame, members: DataFrame) -> DataFrame:
    """seeds(parent_name, short_name, param_types) -> all functions of that name and signature in the seeds' components.
    Trailing dots of a variable number of arguments are an array; functions without known parameters are alike."""
    sig = F.coalesce(F.array_join(F.transform("param_types", lambda p: F.regexp_replace(p, r"\s*\.\.\.$", "[]")), ",", "?"), F.lit("-"))
    of = components.select(F.col("fqn").alias("parent_name"), "component")
    own = members.where("kind = 'Function'").withColumn("signature", sig).join(of, "parent_name", "left").withColumn("component", F.coalesce("component", "parent_name"))
    asked = seeds.withColumn("signature", sig).join(of, "parent_name", "left").select(F.coalesce("component", "parent_name").alias("component"), "short_name", "signature").distinct()
    return own.join(asked, ["component", "short_name", "signature"])
