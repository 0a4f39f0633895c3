"""Relations of the index and of the syntax facts."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of symbols, languages by file extension, folders that a scan leaves out.
KINDS = ("Class", "Interface", "Function", "Field", "Enum", "Annotation")
TYPE_KINDS = ("Class", "Interface", "Enum", "Annotation")
#: Kinds whose members are named Owner#member; members of anything else are named Owner.member.
OWNER_KINDS = ("Class", "Interface", "Enum")
LANGUAGES = {"java": "java", "groovy": "groovy", "kt": "kotlin"}
EXCLUDED_FOLDERS = ("build", "target", ".gradle", ".git", "out", "bin")

PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("type_name", T.StringType()), T.StructField("default_value", T.StringType())])

METADATA = T.StructType(
    [
        T.StructField("parameters", T.ArrayType(PARAMETER)),  # null: not callable; empty: callable without parameters
        T.StructField("return_type", T.StringType()),
        T.StructField("generic_return_type", T.StringType()),
        T.StructField("documentation", T.StringType()),
        T.StructField("annotations", T.ArrayType(T.StringType())),
        T.StructField("type_params", T.ArrayType(T.StringType())),
        T.StructField("generic_param_types", T.ArrayType(T.StringType())),
        T.StructField("method_type_params", T.ArrayType(T.StringType())),
    ]
)

_POSITIONS = ["line_start", "line_end", "char_start", "char_end", "ident_line_start", "ident_line_end", "ident_char_start", "ident_char_end"]

_SYMBOL_HEAD = [T.StructField(n, T.StringType()) for n in ("short_name", "package_name", "fully_qualified_name", "parent_name")]
_SYMBOL_TAIL = [
    T.StructField("file_type", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
    T.StructField("modifiers", T.ArrayType(T.StringType())),
    *(T.StructField(n, T.IntegerType()) for n in _POSITIONS),
    T.StructField("metadata", METADATA),
    T.StructField("last_modified", T.LongType()),
]

SYMBOLS = T.StructType([*_SYMBOL_HEAD, T.StructField("file_path", T.StringType()), *_SYMBOL_TAIL])
EXTERNAL_SYMBOLS = T.StructType(
    [*_SYMBOL_HEAD, T.StructField("jar_path", T.StringType()), T.StructField("source_file_path", T.StringType()), T.StructField("alt_jar_path", T.StringType()), T.StructField("needs_decompilation", T.BooleanType()), *_SYMBOL_TAIL]
)
SUPERS = T.StructType([T.StructField(n, T.StringType()) for n in ("symbol_fqn", "super_short_name", "super_fqn")])


def _records(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_AT = {"line": _I, "col": _I}
_SPAN = {"line_start": _I, "char_start": _I, "line_end": _I, "char_end": _I}

#: One row per source file, facts nested; explode what a query needs.
FACTS = T.StructType(
    [
        T.StructField("path", _S),
        T.StructField("language", _S),
        T.StructField("package", _S),
        T.StructField("symbols", T.ArrayType(SYMBOLS)),
        T.StructField("supers", T.ArrayType(SUPERS)),
        T.StructField("imports", _records(ordinal=_I, import_text=_S, raw=_S, is_wildcard=_B, is_implicit=_B, is_static=_B, alias=_S, line=_I)),
        T.StructField("type_refs", _records(name=_S, **_AT)),
        T.StructField("declared_types", _records(name=_S)),
        T.StructField("class_decls", _records(name=_S, **_AT, is_abstract=_B, parents=T.ArrayType(_S), methods=_records(name=_S, param_types=T.ArrayType(_S), has_body=_B))),
        T.StructField("creations", _records(type_name=_S, **_AT)),
        T.StructField("accesses", _records(receiver=_S, member=_S, **_AT)),
        T.StructField("generic_usages", _records(type_name=_S, n_args=_I, **_AT)),
        T.StructField("overrides", _records(containing=_S, method=_S, return_type=_S, **_AT)),
        T.StructField("narrowing", _records(declared_type=_S, rhs_name=_S, **_AT)),
        T.StructField("idents", _records(name=_S, is_qualified=_B, **_AT)),
        T.StructField("calls", _records(receiver=_S, method=_S, **_AT, args=_records(kind=_S, text=_S))),
        T.StructField("scope_decls", _records(name=_S, type_name=_S, **_AT, scope_line_start=_I, scope_char_start=_I, scope_line_end=_I, scope_char_end=_I)),
        T.StructField("diagnostics", _records(code=_S, severity=_S, message=_S, **_SPAN)),
        T.StructField("spans", _records(kind=_S, **_SPAN)),
        T.StructField("error", _S),
    ]
)
