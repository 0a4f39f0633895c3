"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capitalise(col: Column) -> Column:
    """Upper-case first character; the rest stays."""
    return F.concat(F.upper(F.left(col, F.lit(1))), F.substring(col, 2, 1 << 30))


def receiver_at(line: Column, col: Column) -> Column:
    """Identifier left of the last dot before the cursor."""
    return F.regexp_extract(F.left(line, col), r"(\w*)\.[^.]*$", 1)


def prefix_at(line: Column, col: Column) -> Column:
    """Identifier that ends at the cursor."""
    return F.regexp_extract(F.left(line, col), r"(\w*)$", 1)


def after_dot(line: Column, col: Column) -> Column:
    """Whether what stands before the cursor asks for a member: a dot and no more than the beginning of its name."""
    return F.left(line, col).rlike(r"\.\s*\w*$")


def quoted(needle: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in needle)


def word_pattern(needle: str, dollar: bool) -> str:
    """The needle as a whole word; dollar: whether $ belongs to identifiers (rename) or not (references)."""
    edge = r"[A-Za-z0-9_$]" if dollar else r"[A-Za-z0-9_]"
    return f"(?<!{edge}){quoted(needle)}(?!{edge})"


def occurrences(contents: DataFrame, needle: str, dollar: bool = False) -> DataFrame:
    """contents(id, text) -> id, line, n: lines with whole-word occurrences. Texts without the needle are left out first."""
    held = contents.where(F.contains("text", F.lit(needle)))
    lines = held.select("id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.select("id", "line", F.regexp_count("content", F.lit(word_pattern(needle, dollar))).alias("n")).where("n > 0")


def strip_comment(doc: Column) -> Column:
    """Comment text without its markers: each line trimmed of /** /* */ * and //, blank lines at either end dropped."""
    lines = F.transform(F.split(doc, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(/\*\*?|\*(?!/)|//+)\s?", ""), r"\s*\*/$", "")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"^\n+", ""), r"\n+$", "")


def normalise_qualifier(col: Column) -> Column:
    """Delete balanced parentheses at any depth, drop 'new ', write # for dots. A parenthesis without a partner stays."""
    # a stack of texts: ( opens one, ) drops the one that its partner opened
    rest = lambda stack: F.slice(stack, F.lit(1), F.size(stack) - 1)
    step = lambda stack, c: (
        F.when(c == "(", F.concat(stack, F.array(F.lit(""))))
        .when((c == ")") & (F.size(stack) > 1), rest(stack))
        .otherwise(F.concat(rest(stack), F.array(F.concat(F.element_at(stack, -1), c))))
    )
    kept = F.aggregate(F.split(col, ""), F.expr("cast(array('') as array<string>)"), step, lambda stack: F.array_join(stack, "("))
    return F.replace(F.regexp_replace(kept, r"^new\s+", ""), F.lit("."), F.lit("#"))


def import_edit(content: Column, fqn: Column, package: Column, parent_is_type: Column, language: Column) -> Column:
    """struct(line, text): where an import of fqn goes and what is written, null where none is needed.

    After the last import line, else after the package line, else at the top. Java ends the line with a
    semicolon; a nested type's # becomes a dot; symbols of the own package need no import.
    """
    lines = F.split(content, "\n")
    last = lambda head: F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(x.startswith(head), i)), lambda i: i.isNotNull()))
    line = F.coalesce(last("import ") + 1, last("package ") + 1, F.lit(0))
    name = F.when(parent_is_type, F.replace(fqn, F.lit("#"), F.lit("."))).otherwise(fqn)
    owner = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(~owner.eqNullSafe(package), F.struct(line.cast("int").alias("line"), F.concat(F.lit("import "), name, F.when(language == "java", ";").otherwise(""), F.lit("\n")).alias("text")))


def keyword(kind: Column, language: Column) -> Column:
    """Keyword of a declaration."""
    return (
        F.when(kind == "Class", "class")
        .when(kind == "Interface", "interface")
        .when((kind == "Enum") & (language == "kotlin"), "enum class")
        .when(kind == "Enum", "enum")
        .when((kind == "Annotation") & (language == "kotlin"), "annotation class")
        .when(kind == "Annotation", "@interface")
        .when((kind == "Function") & (language == "kotlin"), "fun")
        .otherwise("")
    )


def hover(language: Column, package: Column, name: Column, kind: Column, modifiers: Column, params: Column, return_type: Column, documentation: Column | None = None) -> Column:
    """Markdown of a symbol: a fenced block with its package and its signature; more than three parameters go one a line."""
    word = keyword(kind, language)
    listed = F.when(F.size(params) > 3, F.concat(F.lit("(\n  "), F.array_join(params, ",\n  "), F.lit("\n)"))).otherwise(F.concat(F.lit("("), F.array_join(params, ", "), F.lit(")")))
    kotlin = language == "kotlin"
    function = F.concat(F.when(kotlin, F.lit("")).otherwise(F.coalesce(F.concat(return_type, F.lit(" ")), F.lit(""))), name, F.coalesce(listed, F.lit("()")), F.when(kotlin, F.coalesce(F.concat(F.lit(": "), return_type), F.lit(""))).otherwise(F.lit("")))
    field = F.when(kotlin, F.concat(name, F.coalesce(F.concat(F.lit(": "), return_type), F.lit("")))).otherwise(F.concat(F.coalesce(F.concat(return_type, F.lit(" ")), F.lit("")), name))
    body = F.when(kind == "Function", function).when(kind == "Field", field).otherwise(name)
    signature = F.array_join(F.filter(F.concat(F.coalesce(modifiers, F.expr("cast(array() as array<string>)")), F.array(word, body)), lambda x: x != ""), " ")
    block = F.concat(F.lit("```"), language, F.lit("\npackage "), package, F.lit("\n\n"), signature, F.lit("\n```"))
    return block if documentation is None else F.concat(block, F.coalesce(F.concat(F.lit("\n\n---\n"), documentation), F.lit("")))


# Reserved words that cannot be names.
RESERVED = {
    "java": tuple("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()),
    "groovy": tuple("abstract as assert boolean break byte case catch char class const continue def default do double else enum extends final finally float for goto if implements import in instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws trait transient try void volatile while true false null".split()),
    "kotlin": tuple("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split()),
}


def is_valid_identifier(name: Column, language: Column) -> Column:
    """An ASCII identifier that is no reserved word of its language."""
    reserved = F.lit(False)
    for g, words in RESERVED.items():
        reserved = reserved | ((language == g) & name.isin(*words))
    return F.coalesce(name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z") & ~reserved, F.lit(False))


def byte_offset(text: Column, line: Column, col: Column) -> Column:
    """UTF-8 offset of a (line, character) position; a position beyond its line counts as the line's end."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), line), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 1)
    return before + F.octet_length(F.left(F.get(lines, line), col))
