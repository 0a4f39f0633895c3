"""Type names, descriptors and generic signatures: plain functions, and Arrow UDFs over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Descriptor letters, access bits, and the canonical names of the parameter types of three languages.
DESCRIPTORS = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
CLASS_BITS = ((0x0001, "public"), (0x0010, "final"), (0x0400, "abstract"))
METHOD_BITS = ((0x0001, "public"), (0x0002, "private"), (0x0004, "protected"), (0x0008, "static"), (0x0010, "final"), (0x0020, "synchronized"), (0x0100, "native"), (0x0400, "abstract"))
FIELD_BITS = ((0x0001, "public"), (0x0002, "private"), (0x0004, "protected"), (0x0008, "static"), (0x0010, "final"), (0x0040, "volatile"), (0x0080, "transient"))
CANONICAL = {"Int": "int", "Integer": "int", "Long": "long", "Short": "short", "Byte": "byte", "Char": "char", "Character": "char", "Float": "float", "Double": "double", "Boolean": "boolean", "Any": "Object"}


def modifiers_of(flags: int, bits: tuple[tuple[int, str], ...]) -> list[str]:
    return [name for bit, name in bits if flags & bit]


def field_type(descriptor: str) -> tuple[str, int]:
    """Type name that a descriptor begins with, and how many characters it takes."""
    dims = len(descriptor) - len(descriptor.lstrip("["))
    rest = descriptor[dims:]
    if rest[:1] == "L":
        end = rest.index(";")
        return rest[1:end].replace("/", ".") + "[]" * dims, dims + end + 1
    return DESCRIPTORS[rest[0]] + "[]" * dims, dims + 1


def method_types(descriptor: str) -> tuple[list[str], str]:
    """Parameter types and return type of a method descriptor; arrays do not end the list."""
    inside, _, result = descriptor[1:].rpartition(")")
    params = []
    while inside:
        name, n = field_type(inside)
        params.append(name)
        inside = inside[n:]
    return params, field_type(result)[0]


class Signature:
    """Reader of generic signatures: bounds are dropped, wildcards are '?', packages and outer classes too."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def formals(self) -> list[str]:
        names: list[str] = []
        if self.text[self.at : self.at + 1] != "<":
            return names
        self.at += 1
        while self.text[self.at] != ">":
            end = self.text.index(":", self.at)
            names.append(self.text[self.at : end])
            self.at = end
            while self.text[self.at] == ":":
                self.at += 1
                if self.text[self.at] not in ":>" and (self.text[self.at] in "LT["):
                    self.type()
        self.at += 1
        return names

    def type(self) -> str:
        ch = self.text[self.at]
        self.at += 1
        if ch == "[":
            return self.type() + "[]"
        if ch == "T":
            end = self.text.index(";", self.at)
            name, self.at = self.text[self.at : end], end + 1
            return name
        if ch != "L":
            return DESCRIPTORS[ch]
        name, args = "", ""
        while True:
            ch = self.text[self.at]
            self.at += 1
            if ch == ";":
                return re.split(r"[/$.]", name)[-1] + args
            if ch == "<":
                args = "<" + ", ".join(self.args()) + ">"
            elif ch == ".":
                name, args = "", ""
            else:
                name += ch

    def args(self) -> list[str]:
        out = []
        while self.text[self.at] != ">":
            if self.text[self.at] == "*":
                self.at += 1
                out.append("?")
            else:
                if self.text[self.at] in "+-":
                    self.at += 1
                out.append(self.type())
        self.at += 1
        return out


def class_type_params(signature: str | None) -> list[str]:
    return Signature(signature).formals() if signature else []


def method_signature(signature: str) -> tuple[list[str], list[str], str]:
    """Type parameters, parameter types and return type of a generic method signature."""
    s = Signature(signature)
    formals, params = s.formals(), []
    s.at += 1
    while s.text[s.at] != ")":
        params.append(s.type())
    s.at += 1
    return formals, params, s.type()


def split_args(text: str) -> list[str]:
    """Cut at commas outside angle brackets."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts if p.strip()]


def parse_type(text: str) -> tuple[str, list[str]]:
    """'Map<K, List<V>>' -> ('Map', ['K', 'List<V>']); text after the closing bracket is left out."""
    base, sep, rest = text.strip().partition("<")
    if not sep:
        return base.strip(), []
    depth = 1
    for i, ch in enumerate(rest):
        depth += (ch == "<") - (ch == ">")
        if not depth:
            return base.strip(), split_args(rest[:i])
    return base.strip(), []


def bindings(params: list[str], args: list[str]) -> dict[str, str]:
    """Type variables to arguments; the shorter list ends it, the first of repeated variables stands."""
    out: dict[str, str] = {}
    for p, a in zip(params, args):
        out.setdefault(p, a)
    return out


def substitute(text: str, bound: dict[str, str]) -> str:
    """Replace type variables at any depth."""
    base, args = parse_type(text)
    if not args:
        return bound.get(text.strip(), text)
    return f"{bound.get(base, base)}<{', '.join(substitute(a, bound) for a in args)}>"


def normalise_param(text: str) -> str:
    """Without annotations, type arguments, qualifiers and nullability; varargs as arrays; one name for each of the
    primitive and boxed types of the languages."""
    text = re.sub(r"@\w+(\([^)]*\))?\s*", "", text).replace("...", "[]").replace(" ", "")
    while (new := re.sub(r"<[^<>]*>", "", text)) != text:
        text = new
    base, dims = re.match(r"([^\[?]*)\??((?:\[\])*)", text).groups()
    base = base.rpartition(".")[2]
    return CANONICAL.get(base, base) + dims


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.pandas_udf(_record(base=_TEXT, args=_TEXTS))
def parse_type_udf(text: pd.Series) -> pd.DataFrame:
    got = [parse_type(x) if x is not None else (None, None) for x in text]
    return pd.DataFrame({"base": [b for b, _ in got], "args": [a for _, a in got]})


@F.pandas_udf(_TEXT)
def substitute_udf(text: pd.Series, params: pd.Series, args: pd.Series) -> pd.Series:
    return pd.Series([substitute(t, bindings(list(p), list(a))) if t is not None else None for t, p, a in zip(text, params, args)])


@F.pandas_udf(_TEXT)
def normalise_param_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: normalise_param(x) if x is not None else None)


@F.pandas_udf(_record(params=_TEXTS, result=_TEXT))
def method_types_udf(descriptor: pd.Series) -> pd.DataFrame:
    got = [method_types(x) for x in descriptor]
    return pd.DataFrame({"params": [p for p, _ in got], "result": [r for _, r in got]})


@F.pandas_udf(_record(formals=_TEXTS, params=_TEXTS, result=_TEXT))
def method_signature_udf(signature: pd.Series) -> pd.DataFrame:
    got = [method_signature(x) for x in signature]
    return pd.DataFrame({"formals": [g[0] for g in got], "params": [g[1] for g in got], "result": [g[2] for g in got]})
