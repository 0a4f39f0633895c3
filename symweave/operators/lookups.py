"""Index lookups for whole relations of keys at once.

symbols has fqn, short_name, package_name, parent_name, file_path, language, kind, modifiers, param_types,
return_type; external symbols have jar_path and needs_decompilation besides; supers has symbol_fqn,
super_short_name, super_fqn (null where the name was not resolved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import first_by, top_by

#: Rows of each probe of a prefix search, and of its merged result.
PROBE_LIMIT, PREFIX_LIMIT = 100, 200


def symbol_order() -> list[Column | str]:
    """The declared order among symbols of one name."""
    return ["file_path", F.array_join("param_types", ",", "?").asc_nulls_first()]


def by_fqn(symbols: DataFrame, keys: DataFrame) -> DataFrame:
    """All project symbols (every overload) of each key(fqn)."""
    return symbols.join(keys.select("fqn").distinct(), "fqn")


def one_by_fqn(symbols: DataFrame, keys: DataFrame) -> DataFrame:
    return first_by(by_fqn(symbols, keys), ["fqn"], symbol_order())


def children(symbols: DataFrame, parents: DataFrame) -> DataFrame:
    return symbols.join(parents.select("parent_name").distinct(), "parent_name")


def of_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select("file_path").distinct(), "file_path")


def source_files(symbols: DataFrame) -> DataFrame:
    return symbols.select("file_path").distinct().orderBy("file_path")


def prefer_sources(external: DataFrame, keys: DataFrame) -> DataFrame:
    """One external symbol of each fqn: with sources before without, then by jar."""
    return first_by(external.join(keys.select("fqn").distinct(), "fqn"), ["fqn"], ["needs_decompilation", "jar_path"])


def external_children(external: DataFrame, parents: DataFrame) -> DataFrame:
    """parents(parent_name, jars): children in the given jars; an empty list of jars does not restrict."""
    return external.join(parents, "parent_name").where((F.size("jars") == 0) | F.array_contains("jars", F.col("jar_path"))).drop("jars")


def capitalised_prefix(prefix: Column) -> Column:
    """Upper-case first character, the rest lower-case."""
    return F.concat(F.upper(F.left(prefix, F.lit(1))), F.lower(F.substring(prefix, 2, 1 << 30)))


def prefix_search(symbols: DataFrame, prefix: str, jars: list[str] | None = None) -> DataFrame:
    """Types whose fqn begins with the lower-cased prefix or whose short name begins with the capitalised one.

    Each probe gives its first hundred by fqn; names that both give count once, fqn hits first; two hundred
    rows at most. Jars, where given, restrict the merged result and not the probes. Prefixes are literals,
    so both conditions reach the Parquet scan.
    """
    short = prefix[:1].upper() + prefix[1:].lower()
    types = symbols.where(~F.col("kind").isin("Function", "Field"))
    key = ["fqn", *[c for c in ("jar_path", "file_path") if c in symbols.columns]]
    probes = []
    for i, cond in enumerate((F.col("fqn").startswith(prefix.lower()), F.col("short_name").startswith(short))):
        probes.append(types.where(cond).orderBy(*key).limit(PROBE_LIMIT).withColumn("probe", F.lit(i)))
    merged = first_by(probes[0].unionByName(probes[1]), ["fqn"], ["probe", *key[1:]]).orderBy("probe", "fqn").limit(PREFIX_LIMIT)
    if jars:
        merged = merged.where(F.col("jar_path").isin(jars))
    return merged


def prefix_search_many(symbols: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The same for prefixes(prefix) as data. The probes are equi-joins: each name gives its beginnings of the lengths that
    some prefix has (one number a length reaches the driver), so no character that all names share becomes a hot key."""
    types = symbols.where(~F.col("kind").isin("Function", "Field"))
    keyed = prefixes.select("prefix", F.lower("prefix").alias("low"), capitalised_prefix(F.col("prefix")).alias("cap"))
    lengths = F.array(*(F.lit(r["n"]) for r in keyed.select(F.length("low").alias("n")).distinct().orderBy("n").collect()))

    def probe(name: str, beginning: str, n: int) -> DataFrame:
        begins = F.transform(F.filter(lengths, lambda x: x <= F.length(name)), lambda x: F.left(F.col(name), x))
        keys = types.select("*", F.explode(begins).alias("__key"))
        return keys.join(keyed.withColumnRenamed(beginning, "__key").select("prefix", "__key"), "__key").drop("__key").withColumn("probe", F.lit(n))

    if keyed.isEmpty():
        return types.withColumn("probe", F.lit(0)).withColumn("prefix", F.lit("")).limit(0)
    each = top_by(probe("fqn", "low", 0).unionByName(probe("short_name", "cap", 1)), ["prefix", "probe"], ["fqn"], PROBE_LIMIT)
    return top_by(first_by(each, ["prefix", "fqn"], ["probe"]), ["prefix"], ["probe", "fqn"], PREFIX_LIMIT)


def with_external(members: DataFrame, external: DataFrame) -> DataFrame:
    """Project members and library ones in one relation under the columns of the former: one row of libraries for each
    name and signature, with sources before without; what libraries do not tell is null."""
    own = external.where(F.col("kind").isin("Function", "Field"))
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in members.schema.fields if f.name not in own.columns}
    params = F.array_join("param_types", ",") if "param_types" in own.columns else F.lit("")
    first = first_by(own.withColumn("__params", params), ["fqn", "__params"], ["needs_decompilation", "jar_path"])
    return members.unionByName(first.withColumns(lacking).select(*members.columns) if lacking else first.select(*members.columns))


def implementers_by_fqn(symbols: DataFrame, supers: DataFrame) -> DataFrame:
    return supers.where("super_fqn is not null").join(symbols, supers["symbol_fqn"] == symbols["fqn"])


def implementers_by_short_name(symbols: DataFrame, supers: DataFrame, names: DataFrame) -> DataFrame:
    return supers.join(names.select("super_short_name").distinct(), "super_short_name").join(symbols, supers["symbol_fqn"] == symbols["fqn"])


def supertypes(symbols: DataFrame, supers: DataFrame) -> DataFrame:
    """Project supertypes of every symbol; unresolved and external ones do not appear."""
    return supers.join(symbols, supers["super_fqn"] == symbols["fqn"])


def fqn_to_symbol(symbols: DataFrame, external: DataFrame, keys: DataFrame) -> DataFrame:
    """key(fqn) -> fqn, origin, kind, place: the project symbol, else the external one with sources first."""
    project = one_by_fqn(symbols, keys).select("fqn", F.lit("project").alias("origin"), "kind", F.col("file_path").alias("place"))
    other = prefer_sources(external, keys).select("fqn", F.lit("external").alias("origin"), "kind", F.col("jar_path").alias("place"))
    return project.unionByName(other.join(project.select("fqn"), "fqn", "left_anti"))
