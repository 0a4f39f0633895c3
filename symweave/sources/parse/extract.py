"""Declarations and facts of one file, by a tolerant descent over its brackets.

What a file declares is read from modifiers, keywords and bracket pairs; bodies are scanned for calls, member
accesses, creations, casts and local variables. A file that cannot be read to the end still gives what was found.
"""

from __future__ import annotations

import re
from typing import Any

from .lexer import Source, Tok, brackets

# Modifiers and keywords of the languages, implicit imports, literal kinds and what they fit.
MODIFIERS = {
    "java": frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split()),
    "groovy": frozenset("public private protected static final abstract native synchronized transient volatile strictfp default def".split()),
    "kotlin": frozenset("public private protected internal abstract final open override lateinit const suspend inline infix operator tailrec external data sealed inner annotation enum companion vararg noinline crossinline reified value expect actual".split()),
}
NOT_NAMES = frozenset("if else for while do switch when case try catch finally return throw new super this instanceof in is as synchronized assert break continue yield null true false import package class interface enum extends implements throws typeof goto".split())
PRIMITIVES = frozenset("int long short byte char float double boolean void".split())
IMPLICIT = {
    "java": ("java.lang.*",),
    "groovy": ("java.lang.*", "java.util.*", "java.io.*", "java.net.*", "groovy.lang.*", "groovy.util.*", "java.math.BigDecimal", "java.math.BigInteger"),
    "kotlin": ("kotlin.*", "kotlin.annotation.*", "kotlin.collections.*", "kotlin.comparisons.*", "kotlin.io.*", "kotlin.ranges.*", "kotlin.sequences.*", "kotlin.text.*", "java.lang.*", "kotlin.jvm.*"),
}
FITS = {
    "int": frozenset("int long short byte char float double Integer Int Long Short Byte Number Object Any Comparable".split()),
    "long": frozenset("long float double Long Number Object Any Comparable".split()),
    "float": frozenset("float double Float Number Object Any Comparable".split()),
    "double": frozenset("double Double Number Object Any Comparable".split()),
    "boolean": frozenset("boolean Boolean Object Any Comparable".split()),
    "char": frozenset("char int long float double Character Char Object Any Comparable".split()),
    "string": frozenset("String CharSequence Object Any Comparable GString".split()),
}
KNOWN_TYPES = frozenset("int long short byte char float double boolean Integer Int Long Short Byte Float Double Boolean Character Char String".split())
BOXED = {"int": "Integer", "long": "Long", "float": "Float", "double": "Double", "boolean": "Boolean", "char": "Character", "string": "String", "null": "null"}


def literal_kind(tokens: list[Tok]) -> str | None:
    """Kind of a literal expression, or None."""
    if len(tokens) == 2 and tokens[0].text in "+-" and tokens[1].kind == "num":
        tokens = tokens[1:]
    if len(tokens) != 1:
        return None
    t = tokens[0]
    if t.kind == "str":
        return "string"
    if t.kind == "char":
        return "char"
    if t.kind == "num":
        low = t.text.lower()
        if low.startswith("0x"):
            return "long" if low.endswith("l") else "int"
        return "long" if low[-1] == "l" else "float" if low[-1] == "f" else "double" if low[-1] == "d" or "." in low or "e" in low else "int"
    return {"true": "boolean", "false": "boolean", "null": "null"}.get(t.text)


def split_top(tokens: list[Tok], mark: str = ",") -> list[list[Tok]]:
    """Cut at a mark outside brackets and type arguments."""
    parts: list[list[Tok]] = [[]]
    depth = angle = 0
    for i, t in enumerate(tokens):
        if t.text in ("(", "[", "{"):
            depth += 1
        elif t.text in (")", "]", "}"):
            depth -= 1
        elif t.text == "<" and i and tokens[i - 1].kind == "id" and tokens[i - 1].text[:1].isupper():
            angle += 1
        elif t.text == ">" and angle:
            angle -= 1
        if t.text == mark and not depth and not angle:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def written(tokens: list[Tok], text: str) -> str:
    return text[tokens[0].at : tokens[-1].at + len(tokens[-1].text)] if tokens else ""


def strip_comment(doc: str) -> str:
    lines = [re.sub(r"\s*\*/$", "", re.sub(r"^(/\*\*?|\*(?!/)|//+)\s?", "", x.strip())).strip() for x in doc.split("\n")]
    return "\n".join(lines).strip("\n")


class Parser:
    def __init__(self, path: str, text: str, language: str) -> None:
        self.path, self.text, self.language = path, text, language
        self.src = Source(text, language)
        self.t = self.src.tokens
        self.pair, self.lost = brackets(self.t)
        self.back = {b: a for a, b in self.pair.items()}
        self.index = {x.at: k for k, x in enumerate(self.t)}
        self.kotlin = language == "kotlin"
        self.package: str | None = None
        self.out: dict[str, list[dict[str, Any]]] = {k: [] for k in ("symbols", "supers", "imports", "type_refs", "declared_types", "class_decls", "creations", "accesses", "generic_usages", "overrides", "narrowing", "calls", "scope_decls", "diagnostics")}

    # -- small tools --

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].text in texts

    def skip_type_args(self, i: int) -> int:
        """Index after <...> that begins at i, or i if none does."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.t):
            x = self.t[j]
            if x.text == "<":
                depth += 1
            elif x.text == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif not (x.kind == "id" or x.text in (".", ",", "?", "[", "]", "&", "*", "@", ":", "(", ")", "->")):
                return i
            j += 1
        return i

    def type_end(self, i: int) -> int:
        """Index after a type that begins at i, or i if none does."""
        if self.kotlin and self.is_(i, "(") and i in self.pair and self.is_(self.pair[i] + 1, "->"):
            return self.type_end(self.pair[i] + 2)
        if i >= len(self.t) or self.t[i].kind != "id" or self.t[i].text in NOT_NAMES:
            return i
        j = i + 1
        while self.is_(j, ".") and j + 1 < len(self.t) and self.t[j + 1].kind == "id":
            j += 2
        j = self.skip_type_args(j)
        while self.is_(j, "[") and self.pair.get(j) == j + 1:
            j += 2
        while self.is_(j, "?") and self.kotlin:
            j += 1
        if self.is_(j, "...") and not self.kotlin:
            j += 1
        return j

    def report(self, code: str, t: Tok, message: str, severity: str = "error", end: Tok | None = None) -> None:
        e = end or t
        self.out["diagnostics"].append({"code": code, "severity": severity, "message": message, "line_start": t.line, "char_start": t.col, "line_end": e.end_line, "char_end": e.end_col})

    # -- file --

    def run(self) -> dict[str, Any]:
        for t in self.lost:
            self.report("syntax_error", t, f"unbalanced {t.text}")
        for t, what in self.src.errors:
            self.report("syntax_error", t, what)
        i = self.header()
        if self.package is not None or self.language == "groovy":
            self.members(i, len(self.t), self.package or "", False, None, None)
        self.import_rules()
        if self.package is None:  # a file without a recognised package has no symbols
            self.out["symbols"], self.out["supers"] = [], []
        spans = [{"kind": k, "line_start": t.line, "char_start": t.col, "line_end": t.end_line, "char_end": t.end_col} for k, ts in (("comment", self.src.comments), ("string", [x for x in self.t if x.kind in ("str", "char")])) for t in ts]
        for n, text in enumerate(IMPLICIT[self.language]):
            self.out["imports"].append({"ordinal": n - 1000, "import_text": text, "raw": text, "is_wildcard": text.endswith(".*"), "is_implicit": True, "is_static": False, "alias": None, "line": -1})
        self.find_type_refs()
        self.out["idents"] = [
            {"name": t.text, "is_qualified": bool(i) and self.t[i - 1].text in (".", "?.", "::"), "line": t.line, "col": t.col} for i, t in enumerate(self.t) if t.kind == "id" and t.text not in NOT_NAMES and t.text not in PRIMITIVES
        ]
        return {"path": self.path, "language": self.language, "package": self.package, **self.out, "spans": spans}

    def header(self) -> int:
        """Package and imports; index of the first token after them."""
        i, n, last = 0, 0, 0
        while i < len(self.t):
            t = self.t[i]
            if t.text == "@" and not self.is_(i + 1, "interface"):
                j = self.annotation(i)[1]
                if self.kotlin and self.is_(i + 1, "file"):
                    i = last = j
                    continue
                if not self.is_(j, "package"):
                    break
                i = j
            elif t.text == "package" and self.package is None:
                j = self.dotted(i + 1)
                name = "".join(x.text for x in self.t[i + 1 : j])
                # one-segment packages are only recognised in Kotlin
                if "." in name or self.kotlin:
                    self.package = name.replace("`", "")
                i = last = j + self.is_(j, ";")
            elif t.text == "import":
                j = i + 1
                static = self.is_(j, "static")
                j += static
                k = self.dotted(j)
                if self.is_(k, ".") and self.is_(k + 1, "*"):
                    k += 2
                path = "".join(x.text for x in self.t[j:k])
                alias = None
                if self.is_(k, "as"):
                    alias = self.t[k + 1].text if k + 1 < len(self.t) else None
                    k += 2
                raw = ("static " if static else "") + path + (f" as {alias}" if alias else "")
                if path:
                    self.out["imports"].append({"ordinal": n, "import_text": path, "raw": raw, "is_wildcard": path.endswith(".*"), "is_implicit": False, "is_static": static, "alias": alias, "line": t.line})
                    n += 1
                i = last = max(k + self.is_(k, ";"), i + 1)
            else:
                break
        return last if i >= len(self.t) else i

    def dotted(self, i: int) -> int:
        if i >= len(self.t) or self.t[i].kind != "id":
            return i
        i += 1
        while self.is_(i, ".") and i + 1 < len(self.t) and self.t[i + 1].kind == "id":
            i += 2
        return i

    def import_rules(self) -> None:
        seen: set[str] = set()
        own = [x for x in self.out["imports"] if not x["is_implicit"]]
        body = {t.text.strip("`") for t in self.t if t.kind == "id" and t.line > max((x["line"] for x in own), default=-1)}
        body |= {w for t in self.t if t.kind == "str" for w in re.findall(r"[\w$]+", t.text)}
        for x in own:
            where = Tok("id", x["raw"], x["line"], 0, x["line"], 7 + len(x["raw"]), 0)
            if x["raw"] in seen:
                self.report("duplicate_import", where, f"{x['import_text']} is imported twice", "warning")
            seen.add(x["raw"])
            name = x["alias"] or x["import_text"].rpartition(".")[2]
            if not x["is_wildcard"] and name not in body:
                self.report("unused_import", where, f"{x['import_text']} is not used", "warning")

    # -- declarations --

    def annotation(self, i: int) -> tuple[str, int]:
        """Simple name of the annotation at i, and the index after it."""
        j = i + 1
        if self.kotlin and self.is_(j + 1, ":"):
            j += 2
        k = self.dotted(j)
        name = self.t[k - 1].text if k > j else ""
        k = self.skip_type_args(k)
        if self.is_(k, "(") and k in self.pair:
            k = self.pair[k] + 1
        return name, max(k, i + 1)

    def doc_before(self, at: int, since: int) -> Tok | None:
        """The doc comment that ends last before a place and begins after another."""
        found = None
        for c in self.src.comments:
            if since <= c.at and c.at + len(c.text) <= at and c.text.startswith("/**"):
                found = c
        return found

    def members(self, i: int, end: int, owner: str, owned: bool, owner_name: str | None, signatures: list | None) -> None:
        """Declarations between two token indices. owned: names follow the owner with # and not with a dot."""
        while i < end:
            if self.t[i].text in (";", ","):
                i += 1
                continue
            i = max(self.member(i, end, owner, owned, owner_name, signatures), i + 1)

    def member(self, i: int, end: int, owner: str, owned: bool, owner_name: str | None, signatures: list | None) -> int:
        first, annotations, modifiers = i, [], []
        since = self.t[i - 1].at + len(self.t[i - 1].text) if i else 0
        words = MODIFIERS[self.language]
        while i < end:
            t = self.t[i]
            if t.text == "@" and not self.is_(i + 1, "interface"):
                name, i = self.annotation(i)
                annotations.append(name)
            elif t.text in words and t.kind == "id" and not (t.text == "enum" and not self.kotlin) and not self.is_(i + 1, "(", "=", ".", ":"):
                if t.text != "def":
                    modifiers.append(t.text)
                i += 1
            else:
                break
        if i >= end:
            return end
        info = {"first": first, "since": since, "annotations": annotations, "modifiers": modifiers, "owner": owner, "owned": owned, "owner_name": owner_name, "signatures": signatures}
        t = self.t[i]
        if t.text in ("class", "interface", "enum", "record", "object", "trait") and i + 1 < end and (self.t[i + 1].kind == "id" or t.text == "object"):
            if t.text not in ("record", "object", "trait") or (t.text == "record" and self.is_(i + 2, "(", "<")) or (t.text == "object" and self.kotlin) or (t.text == "trait" and self.language == "groovy"):
                return self.type_decl(i, end, info)
        if t.text == "@" and self.is_(i + 1, "interface"):
            return self.type_decl(i + 1, end, info, annotation=True)
        if t.text == "{" and i in self.pair:  # initialiser block
            self.body(i + 1, self.pair[i], None, info)
            return self.pair[i] + 1
        if self.kotlin:
            return self.kotlin_member(i, end, info)
        return self.java_member(i, end, info)

    def symbol(self, info: dict, name: Tok, kind: str, last: Tok, short: str | None = None, **meta: Any) -> str:
        short = short or name.text.strip("`")
        fqn = info["owner"] + ("#" if info["owned"] else ".") + short if info["owner"] else short
        doc = self.doc_before(self.t[info["first"]].at, info["since"])
        start = doc or self.t[info["first"]]
        metadata = {k: None for k in ("parameters", "return_type", "generic_return_type", "type_params", "generic_param_types", "method_type_params")} | {"documentation": strip_comment(doc.text) if doc else None, "annotations": info["annotations"]} | meta
        self.out["symbols"].append(
            {
                "short_name": short, "package_name": self.package or "", "fully_qualified_name": fqn, "parent_name": info["owner"], "file_path": self.path, "file_type": self.language, "symbol_type": kind, "modifiers": info["modifiers"],
                "line_start": start.line, "line_end": last.end_line, "char_start": start.col, "char_end": last.end_col,
                "ident_line_start": name.line, "ident_line_end": name.end_line, "ident_char_start": name.col, "ident_char_end": name.end_col, "metadata": metadata, "last_modified": 0,
            }
        )
        return fqn

    def type_decl(self, i: int, end: int, info: dict, annotation: bool = False) -> int:
        word = self.t[i].text
        kind = "Annotation" if annotation or "annotation" in info["modifiers"] else "Interface" if word in ("interface", "trait") else "Enum" if word == "enum" or "enum" in info["modifiers"] else "Class"
        j = i + 1
        if word == "enum" and self.is_(j, "class"):
            j += 1
        named = j < end and self.t[j].kind == "id"
        name = self.t[j] if named else self.t[i]
        j = self.skip_type_args(j + named)
        params: list[Tok] | None = None
        while self.kotlin and self.is_(j, "@", "private", "internal", "protected", "public", "constructor"):
            j = self.annotation(j)[1] if self.is_(j, "@") else j + 1
        if (self.kotlin or word == "record") and self.is_(j, "(") and j in self.pair:
            params = self.t[j + 1 : self.pair[j]]
            j = self.pair[j] + 1
        head = j
        while j < end and not self.is_(j, "{", ";") and not (self.kotlin and self.stops(j)):
            j = self.pair[j] + 1 if j in self.pair and self.t[j].text == "(" else j + 1
        parents = self.parents(head, j)
        body = j if self.is_(j, "{") and j in self.pair else None
        last_at = self.pair[body] if body is not None else max(j - 1, i)
        last = self.t[min(last_at, len(self.t) - 1)]
        is_object = word == "object"
        fqn = info["owner"] + ("#" if info["owned"] else ".") + name.text if info["owner"] else name.text
        listed = self.parameters(params) if params is not None else None
        if not is_object:
            fqn = self.symbol(info, name, kind, last, parameters=listed)
            for p in parents:
                self.out["supers"].append({"symbol_fqn": fqn, "super_short_name": p.rpartition(".")[2], "super_fqn": self.by_import(p)})
            self.out["declared_types"].append({"name": name.text})
        signatures: list = []
        if params is not None and not is_object:
            self.constructor_fields(params, fqn, kind != "Annotation")
        if body is not None:
            k = body + 1
            if kind == "Enum":
                k = self.enum_entries(k, self.pair[body])
            self.members(k, self.pair[body], fqn, kind != "Annotation", name.text, signatures)
        if not is_object:
            self.signature_rules(signatures)
            self.out["class_decls"].append({"name": name.text, "line": name.line, "col": name.col, "is_abstract": "abstract" in info["modifiers"] or kind == "Interface", "parents": parents, "methods": [s for s, _ in signatures]})
        return last_at + 1

    def stops(self, j: int) -> bool:
        """Kotlin: a new line that does not go on with the head of the declaration."""
        t, before = self.t[j], self.t[j - 1]
        return t.line > before.end_line and t.text not in (":", ",", "{", "where", "by", "(", ".") and before.text not in (":", ",", "by", "where")

    def parents(self, i: int, end: int) -> list[str]:
        out, taking = [], False
        while i < end:
            t = self.t[i]
            if t.text in ("extends", "implements") or (self.kotlin and t.text == ":"):
                taking = True
            elif t.text in ("permits", "where", "by"):
                taking = False
            elif taking and t.kind == "id":
                j = self.dotted(i)
                out.append("".join(x.text for x in self.t[i:j]))
                j = self.skip_type_args(j)
                i = self.pair[j] + 1 if self.is_(j, "(") and j in self.pair else j
                continue
            i += 1
        return out

    def by_import(self, name: str) -> str | None:
        if "." in name:
            return name
        for x in self.out["imports"]:
            if not x["is_wildcard"] and (x["alias"] or x["import_text"].rpartition(".")[2]) == name:
                return x["import_text"]
        return None

    def enum_entries(self, i: int, end: int) -> int:
        while i < end and not self.is_(i, ";"):
            t = self.t[i]
            if self.kotlin and t.text in ("fun", "val", "var", "override", "companion", "abstract"):
                return i
            i = self.pair[i] + 1 if i in self.pair else i + 1
        return min(i + 1, end)

    def parameters(self, tokens: list[Tok]) -> list[dict[str, str | None]]:
        out = []
        for p in split_top(tokens):
            while p and p[0].text == "@":  # annotations say nothing of the parameter
                at = self.index[p[0].at]
                after = self.annotation(at)[1]
                p = p[after - at :]
            if not p:
                continue
            cut = next((k for k, x in enumerate(p) if x.text == "="), len(p))
            default = written(p[cut + 1 :], self.text) or None
            p = p[:cut]
            if self.kotlin:
                colon = next((k for k, x in enumerate(p) if x.text == ":"), len(p))
                name, kind = " ".join(x.text for x in p[:colon]), written(p[colon + 1 :], self.text) or None
            else:
                p = [x for x in p if x.text not in ("final", "def")]
                if not p:
                    continue
                dims = 0
                while len(p) > 2 and p[-1].text == "]":
                    p, dims = p[:-2], dims + 1
                name, kind = p[-1].text, (written(p[:-1], self.text) or None) if len(p) > 1 else None
                kind = kind + "[]" * dims if kind else None
            out.append({"name": name, "type_name": kind, "default_value": default})
        return out

    def constructor_fields(self, params: list[Tok], owner: str, owned: bool) -> None:
        """val and var parameters of a Kotlin constructor, and components of a Java record, are fields."""
        for p in split_top(params):
            at = self.index[p[0].at]
            cut = next((k for k, x in enumerate(p) if x.text == "="), len(p))
            names = [x for x in p[:cut] if x.kind == "id"]
            word = next((x for x in p if x.text in ("val", "var")), None)
            if self.kotlin:
                if word is None:
                    continue
                k = p.index(word) + 1
                name, kind = p[k], written(p[k + 2 : cut], self.text)
                info = {"first": at, "since": p[0].at, "annotations": [], "modifiers": [word.text], "owner": owner, "owned": owned}
            else:
                name, kind = names[-1], written(p[:-1], self.text)
                info = {"first": at, "since": p[0].at, "annotations": [], "modifiers": ["private", "final"], "owner": owner, "owned": owned}
            self.symbol(info, name, "Field", p[-1], return_type=kind or None)

    def kotlin_member(self, i: int, end: int, info: dict) -> int:
        t = self.t[i]
        if t.text == "init" and self.is_(i + 1, "{") and i + 1 in self.pair:
            self.body(i + 2, self.pair[i + 1], None, info)
            return self.pair[i + 1] + 1
        if t.text == "constructor" and self.is_(i + 1, "(") and i + 1 in self.pair:
            j = self.pair[i + 1] + 1
            while j < end and not self.is_(j, "{") and not self.stops(j):
                j += 1
            return self.pair[j] + 1 if j in self.pair else j
        if t.text == "fun":
            j = self.skip_type_args(i + 1)
            while j < end and not self.is_(j, "("):
                k = self.skip_type_args(j)
                j = k if k > j else j + 1
            if j not in self.pair or self.t[j - 1].kind != "id":
                return i + 1
            name, close = self.t[j - 1], self.pair[j]
            k, result = close + 1, None
            if self.is_(k, ":"):
                e = self.type_end(k + 1)
                result = written(self.t[k + 1 : e], self.text)
                k = e
            return self.function(name, self.t[j + 1 : close], result, k, end, info)
        if t.text in ("val", "var"):
            j = self.skip_type_args(i + 1)
            e = self.type_end(j)
            while e > j + 1 and not self.is_(e, ":", "=") and self.t[e - 2].text == ".":
                break
            name_at = e - 1 if e > j and self.t[e - 1].kind == "id" else j
            if name_at >= end or self.t[name_at].kind != "id":
                return i + 1
            name, k, kind = self.t[name_at], name_at + 1, None
            if self.is_(k, ":"):
                e = self.type_end(k + 1)
                kind = written(self.t[k + 1 : e], self.text) or None
                k = e
            info["modifiers"] = [*info["modifiers"], t.text]
            k = self.initialiser(k, end, name, kind, info)
            while self.is_(k, "get", "set", "private", "protected", "internal", "by") and k < end:
                if self.t[k].text == "by":
                    k = self.expression_end(k + 1, end)
                    break
                if self.is_(k, "private", "protected", "internal") and not self.is_(k + 1, "set", "get"):
                    break
                k += 1 if self.is_(k, "get", "set") else 2
                if self.is_(k, "(") and k in self.pair:
                    k = self.pair[k] + 1
                if self.is_(k, ":"):
                    k = self.type_end(k + 1)
                if self.is_(k, "{") and k in self.pair:
                    self.body(k + 1, self.pair[k], None, info)
                    k = self.pair[k] + 1
                elif self.is_(k, "="):
                    k = self.expression_end(k + 1, end)
            self.symbol(info, name, "Field", self.t[max(k - 1, name_at)], return_type=kind)
            return k
        if t.text == "typealias":
            return self.expression_end(i + 1, end)
        return self.pair[i] + 1 if i in self.pair else i + 1

    def java_member(self, i: int, end: int, info: dict) -> int:
        start = i
        i = self.skip_type_args(i)
        # a constructor or, in Groovy, a method without a type
        if i + 1 < end and self.t[i].kind in ("id", "str") and self.is_(i + 1, "(") and i + 1 in self.pair:
            close = self.pair[i + 1]
            name = self.t[i]
            if name.text == info["owner_name"]:
                return self.function(name, self.t[i + 2 : close], None, close + 1, end, info, constructor=True)
            if i > info["first"] and (self.is_(close + 1, "{", "throws")) and name.text not in NOT_NAMES:
                short = name.text.strip("'\"") if name.kind == "str" else None
                return self.function(name, self.t[i + 2 : close], None, close + 1, end, info, short=short)
            return self.statement(i, end, info)
        e = self.type_end(i)
        if e > i and e < end and self.t[e].kind in ("id", "str") and self.t[e].text not in NOT_NAMES:
            name, kind = self.t[e], written(self.t[i:e], self.text)
            if self.is_(e + 1, "(") and e + 1 in self.pair:
                close = self.pair[e + 1]
                k = close + 1
                if info["owner_name"] is not None or self.is_(k, "{", "throws"):
                    return self.function(name, self.t[e + 2 : close], kind, k, end, info, short=name.text.strip("'\"") if name.kind == "str" else None)
            elif name.kind == "id":
                k = self.initialiser(e + 1, end, name, kind, info)
                self.field(name, kind, k, info)
                while self.is_(k, ",") and k + 1 < end and self.t[k + 1].kind == "id":
                    nxt = self.t[k + 1]
                    k = self.initialiser(k + 2, end, nxt, kind, info)
                    self.field(nxt, kind, k, info)
                return k + self.is_(k, ";")
        if i > start or i > info["first"]:  # def x = ... and modifiers before a bare name
            if self.t[i].kind == "id" and self.is_(i + 1, "=", ";") and self.t[i].text not in NOT_NAMES:
                name = self.t[i]
                k = self.initialiser(i + 1, end, name, None, info)
                self.field(name, None, k, info)
                return k + self.is_(k, ";")
        return self.statement(i, end, info)

    def field(self, name: Tok, kind: str | None, k: int, info: dict) -> None:
        if info["owner_name"] is not None:
            last = self.t[k] if self.is_(k, ";") else self.t[max(k - 1, 0)]
            self.symbol(info, name, "Field", last, return_type=kind)

    def statement(self, i: int, end: int, info: dict) -> int:
        """Something that declares nothing: a script's statement or what could not be read."""
        e = self.expression_end(i, end)
        self.body(i, e, None, info)
        return e + self.is_(e, ";")

    def expression_end(self, i: int, end: int) -> int:
        """Index after an expression: up to ; or , outside brackets, or a line end where the language lets one end it."""
        lines = self.language != "java"
        j = i
        while j < end:
            t = self.t[j]
            if t.text in (";", ",", ")", "]", "}"):
                return j
            if lines and j > i:
                before = self.t[j - 1]
                if t.line > before.end_line and t.text not in (".", "?.", "?:", "&&", "||", "+", "-", "*", "/", "::", "as", "else", "?", ":", "==", "!=") and before.text not in ("=", "+", "-", "*", "/", "&&", "||", ".", "?.", "?:", "(", ",", "->", "return", "in", "==", "!=", "else"):
                    return j
            j = self.pair[j] + 1 if j in self.pair else j + 1
        return end

    def initialiser(self, k: int, end: int, name: Tok, kind: str | None, info: dict) -> int:
        """After a variable's name and type: its value, if one follows. Checks the value against the type."""
        while self.is_(k, "[") and self.pair.get(k) == k + 1:
            k += 2
        if not self.is_(k, "="):
            return k
        e = self.expression_end(k + 1, end)
        self.check_value("type_mismatch_assignment", kind, self.t[k + 1 : e])
        self.body(k + 1, e, None, info)
        return e

    def check_value(self, code: str, kind: str | None, value: list[Tok]) -> None:
        got = literal_kind(value)
        if got is None or kind is None:
            return
        base = kind.partition("<")[0].rpartition(".")[2]
        if got == "null":
            if self.kotlin and not kind.endswith("?") and base not in ("Nothing",):
                self.report("null_safety_violation", value[0], f"null for a value of type {kind}")
            elif base in PRIMITIVES - {"void"} and not self.kotlin and self.language == "java":
                self.report(code, value[0], f"null for a value of type {kind}")
            return
        if self.language == "groovy" or base.rstrip("?") not in KNOWN_TYPES or "[" in kind:
            return
        if base.rstrip("?") not in FITS[got]:
            self.report(code, value[0], f"{got} literal for a value of type {kind}")

    def function(self, name: Tok, params: list[Tok], result: str | None, k: int, end: int, info: dict, short: str | None = None, constructor: bool = False) -> int:
        listed = self.parameters(params)
        if self.is_(k, "throws"):
            while k < end and not self.is_(k, "{", ";"):
                k += 1
        if self.is_(k, "default") and not self.kotlin:
            k = self.expression_end(k + 1, end)
        if self.kotlin and self.is_(k, "where"):
            while k < end and not self.is_(k, "{", "="):
                k += 1
        kind = "Function"
        body_at = None
        last_at = k - 1
        if self.is_(k, "{") and k in self.pair:
            body_at, last_at = k, self.pair[k]
        elif self.kotlin and self.is_(k, "="):
            e = self.expression_end(k + 1, end)
            last_at = e - 1
        elif self.is_(k, ";"):
            last_at = k
        fqn = None
        if not constructor:
            fqn = self.symbol(info, name, kind, self.t[last_at], short=short, parameters=listed, return_type=result)
        if info["signatures"] is not None and not constructor:
            types = [normal_type(p["type_name"]) for p in listed]
            info["signatures"].append(({"name": short or name.text, "param_types": types, "has_body": body_at is not None}, name))
        if "override" in info["modifiers"] or "Override" in info["annotations"]:
            self.out["overrides"].append({"containing": info["owner"], "method": name.text, "return_type": result, "line": name.line, "col": name.col})
        inner = {**info, "owner": fqn or info["owner"], "owned": False, "owner_name": None, "signatures": None, "params": listed, "result": result}
        scope = (self.t[body_at], self.t[last_at]) if body_at is not None else None
        for p in listed:
            if scope:  # from the function's name on: the list itself mentions the parameter, and later defaults may
                self.out["scope_decls"].append({"name": p["name"].split()[-1] if p["name"] else "", "type_name": p["type_name"], "line": name.line, "col": name.col, "scope_line_start": name.line, "scope_char_start": name.col, "scope_line_end": scope[1].end_line, "scope_char_end": scope[1].end_col})
        if body_at is not None:
            self.body(body_at + 1, last_at, result, inner)
            if not constructor:
                self.return_rule(name, result, body_at + 1, last_at)
            if self.language != "groovy":
                self.assignment_rule(body_at + 1, last_at)
        elif self.kotlin and self.is_(k, "="):
            self.check_value("incompatible_return_type", result, self.t[k + 1 : last_at + 1])
            self.body(k + 1, last_at + 1, None, inner)
        return last_at + 1

    # -- rules --

    def signature_rules(self, signatures: list) -> None:
        seen: set = set()
        for s, name in signatures:
            key = (s["name"], tuple(s["param_types"]))
            if key in seen:
                self.report("duplicate_method_signature", name, f"{s['name']}({', '.join(t or '' for t in s['param_types'])}) is declared twice")
            seen.add(key)

    def skip_nested(self, i: int) -> int:
        """If a nested class or lambda begins at i, the index after it; else i."""
        t = self.t[i]
        if t.text in ("class", "interface", "object") and (i + 1 < len(self.t)):
            j = i
            while j < len(self.t) and not self.is_(j, "{", ";", "}"):
                j += 1
            return self.pair[j] + 1 if j in self.pair and self.is_(j, "{") else i
        if t.text == "{" and i in self.pair:
            before = self.t[i - 1].text if i else ""
            arrow = before == "->" and self.language == "java"
            anonymous = before == ")" and self.language == "java" and self.creation_before(i - 1)
            closure = self.language != "java" and before not in (")", "else", "try", "finally", "do", "->", "{", "}", ";") and self.t[i - 1].text not in NOT_NAMES
            call = self.kotlin and before == ")" and not self.control_before(i - 1)
            if arrow or anonymous or closure or call:
                return self.pair[i] + 1
        return i

    def open_of(self, close: int) -> int | None:
        return self.back.get(close)

    def creation_before(self, close: int) -> bool:
        a = self.open_of(close)
        while a is not None and a > 0 and (self.t[a - 1].kind == "id" or self.t[a - 1].text in (".", "<", ">", ",", "?")):
            a -= 1
            if self.t[a].text == "new":
                return True
        return False

    def control_before(self, close: int) -> bool:
        a = self.open_of(close)
        return a is not None and a > 0 and self.t[a - 1].text in ("if", "for", "while", "when", "catch", "switch", "synchronized", "try")

    def return_rule(self, name: Tok, result: str | None, i: int, end: int) -> None:
        if self.language == "groovy" or result in (None, "void", "Unit", "Nothing", "Void"):
            return
        ends = ("return", "throw") if self.kotlin else ("return",)
        while i < end:
            j = self.skip_nested(i)
            if j > i:
                i = j
                continue
            if self.t[i].text in ends:
                return
            i += 1
        self.report("missing_return_statement", name, f"{name.text} never returns a {result}")

    def assignment_rule(self, i: int, end: int) -> None:
        """Linear scan of one block: declared without a value and read before a plain assignment."""
        waiting: dict[str, bool] = {}
        start = True
        while i < end:
            t = self.t[i]
            j = self.skip_nested(i)
            if j > i:
                i, start = j, True
                continue
            if t.text == "{" and i in self.pair:
                for x in self.t[i : self.pair[i]]:
                    waiting.pop(x.text, None)  # what happens in nested blocks is not followed
                i, start = self.pair[i] + 1, True
                continue
            if start:
                word = i + 1 if self.kotlin and t.text in ("val", "var") else i
                if self.kotlin and word > i and self.is_(word + 1, ":"):
                    e = self.type_end(word + 2)
                    if not self.is_(e, "=", "by"):
                        waiting[self.t[word].text] = True
                        i = e
                        continue
                elif not self.kotlin:
                    e = self.type_end(i)
                    if e > i and e < end and self.t[e].kind == "id" and self.is_(e + 1, ";") and t.text not in NOT_NAMES:
                        waiting[self.t[e].text] = True
                        i = e + 2
                        continue
            if t.kind == "id" and t.text in waiting and not (i and self.t[i - 1].text in (".", "?.", "::")):
                if self.is_(i + 1, "="):
                    e = self.expression_end(i + 2, end)
                    for x in self.t[i + 2 : e]:
                        if x.text == t.text and x.kind == "id":
                            self.report("variable_used_before_assignment", x, f"{x.text} has no value yet")
                    del waiting[t.text]
                    i, start = e, False
                    continue
                self.report("variable_used_before_assignment", t, f"{t.text} has no value yet")
                del waiting[t.text]
            start = t.text in (";", "{", "}") or (self.kotlin and i + 1 < end and self.t[i + 1].line > t.end_line)
            i += 1

    # -- bodies --

    def body(self, i: int, end: int, result: str | None, info: dict) -> None:
        """Calls, accesses, creations, casts, local variables and nested declarations."""
        nullable = {p["name"].split()[-1] for p in info.get("params") or [] if (p["type_name"] or "").endswith("?")}
        scope_end = self.t[end] if end < len(self.t) else self.t[-1]
        while i < end:
            t = self.t[i]
            before = self.t[i - 1].text if i else ""
            if t.text in ("class", "interface", "enum") and before not in (".", "::") and i + 1 < end and self.t[i + 1].kind == "id" and not self.is_(i + 1, "("):
                first = i
                while first > 0 and self.t[first - 1].text in MODIFIERS[self.language]:
                    first -= 1
                i = max(self.member(first, end, info["owner"], False, None, None), i + 1)
                continue
            if self.kotlin and t.text == "fun" and i + 1 < end and self.t[i + 1].kind == "id":
                i = max(self.member(i, end, info["owner"], False, None, None), i + 1)
                continue
            if t.text == "return":
                e = self.expression_end(i + 1, end)
                value = self.t[i + 1 : e]
                self.check_value("incompatible_return_type", result, value)
                if self.kotlin and result and not result.endswith("?") and len(value) == 1 and value[0].text in nullable:
                    self.report("null_safety_violation", value[0], f"{value[0].text} may be null, {result} may not")
            elif t.text == "new" and not self.kotlin:
                j = self.dotted(i + 1)
                if j > i + 1:
                    name = "".join(x.text for x in self.t[i + 1 : j])
                    self.out["creations"].append({"type_name": name, "line": self.t[i + 1].line, "col": self.t[i + 1].col})
            elif t.text in ("as", "as?") and self.language != "java":
                e = self.type_end(i + 1 + self.is_(i + 1, "?"))
                if e > i + 1 and any(x.text == "<" for x in self.t[i + 1 : e]):
                    self.report("unchecked_cast", self.t[i + 1], f"cast to {written(self.t[i + 1 : e], self.text)}", "warning", self.t[e - 1])
            elif t.text == "(" and not self.kotlin and i in self.pair:
                e = self.type_end(i + 1)
                if e == self.pair[i] and any(x.text == "<" for x in self.t[i + 1 : e]) and e + 1 < end and (self.t[e + 1].kind in ("id", "str", "num") or self.is_(e + 1, "(")):
                    self.report("unchecked_cast", self.t[i + 1], f"cast to {written(self.t[i + 1 : e], self.text)}", "warning", self.t[e - 1])
            elif t.kind == "id" and t.text not in NOT_NAMES:
                i = self.name_in_body(i, end, info, scope_end)
                continue
            i += 1

    def name_in_body(self, i: int, end: int, info: dict, scope_end: Tok) -> int:
        t = self.t[i]
        before = self.t[i - 1].text if i else ""
        if self.kotlin and t.text in ("val", "var") and i + 1 < end and self.t[i + 1].kind == "id":
            name, k, kind = self.t[i + 1], i + 2, None
            if self.is_(k, ":"):
                e = self.type_end(k + 1)
                kind, k = written(self.t[k + 1 : e], self.text), e
            if self.is_(k, "="):
                e = self.expression_end(k + 1, end)
                self.check_value("type_mismatch_assignment", kind, self.t[k + 1 : e])
                kind = kind or self.value_type(self.t[k + 1 : e])
            self.local(name, kind, scope_end)
            # a local property is indexed like a field
            self.symbol({**info, "first": i, "since": t.at, "annotations": [], "modifiers": [t.text], "owned": False}, name, "Field", self.t[max(k - 1, i + 1)], return_type=kind)
            return k
        if not self.kotlin and before not in (".", "?.", "::", "new", "@"):
            untyped = t.text in ("def", "var", "final")
            e = i + 1 if untyped else self.type_end(i)
            if untyped and t.text == "final":
                e = self.type_end(i + 1)
            if e > i and e < end and self.t[e].kind == "id" and self.t[e].text not in NOT_NAMES and (self.is_(e + 1, "=", ";", ":", ",", "in") or (self.language == "groovy" and e + 1 < len(self.t) and self.t[e + 1].line > self.t[e].end_line)):
                kind = None if untyped and t.text != "final" else written(self.t[i + (t.text == "final") : e], self.text)
                if self.is_(e + 1, "="):
                    v = self.expression_end(e + 2, end)
                    value = self.t[e + 2 : v]
                    self.check_value("type_mismatch_assignment", kind, value)
                    if kind in PRIMITIVES and len(value) == 1 and value[0].kind == "id" and literal_kind(value) is None:
                        self.out["narrowing"].append({"declared_type": kind, "rhs_name": value[0].text, "line": self.t[e].line, "col": self.t[e].col})
                    if kind is None:
                        kind = self.value_type(self.t[e + 2 : v])
                self.local(self.t[e], kind, scope_end)
                return e + 1
        j = self.skip_type_args(i + 1)
        receiver = None
        if before in (".", "?.", "!!"):
            receiver = self.receiver_before(i - 1)
        after = j if j > i + 1 and self.is_(j, "(") else i + 1
        lambda_call = self.language != "java" and self.is_(i + 1, "{") and i + 1 in self.pair and before in (".", "?.")
        if self.is_(after, "(") and after in self.pair:
            args = [{"kind": literal_kind(a) or ("identifier" if len(a) == 1 and a[0].kind == "id" else "expression"), "text": written(a, self.text)} for a in split_top(self.t[after + 1 : self.pair[after]])]
            if self.language != "java" and self.is_(self.pair[after] + 1, "{"):
                args.append({"kind": "lambda", "text": ""})
            if before != "new" and not (before == "." and receiver is None):
                self.out["calls"].append({"receiver": receiver, "method": t.text, "line": t.line, "col": t.col, "args": args})
            elif before == ".":
                self.out["calls"].append({"receiver": None, "method": t.text, "line": t.line, "col": t.col, "args": args})
        elif lambda_call:
            self.out["calls"].append({"receiver": receiver, "method": t.text, "line": t.line, "col": t.col, "args": [{"kind": "lambda", "text": ""}]})
        if receiver is not None:
            self.out["accesses"].append({"receiver": receiver, "member": t.text, "line": t.line, "col": t.col})
        return max(i + 1, j if j > i + 1 and self.t[i].text[:1].isupper() else i + 1)

    def receiver_before(self, dot: int) -> str | None:
        """The chain left of a dot, normalised: calls lose their arguments, dots become #, new is dropped."""
        a = dot
        parts: list[str] = []
        while a > 0:
            k = a - 1
            if self.t[k].text == "!!":
                k -= 1
            while k > 0 and self.t[k].text in (")", "]", "}") and (o := self.open_of(k)) is not None:
                k = o - 1
            if k < 0 or self.t[k].kind not in ("id", "str") or (self.t[k].text in NOT_NAMES and self.t[k].text not in ("this", "super")):
                break
            parts.append("String" if self.t[k].kind == "str" else self.t[k].text)
            a = k
            if not (k > 0 and self.t[k - 1].text in (".", "?.")):
                break
            a = k - 1
        return "#".join(reversed(parts)) or None

    def value_type(self, value: list[Tok]) -> str | None:
        """Type of an initialiser: a literal's, a created type, or a chain a#b for a call that must be resolved."""
        got = literal_kind(value)
        if got is not None:
            if self.kotlin:
                return {"int": "Int", "char": "Char", "null": None}.get(got, got.capitalize())
            return None if got == "null" else "BigDecimal" if got == "double" and self.language == "groovy" and value[-1].text[-1] not in "dD" else BOXED[got]
        if value and value[0].text == "new" and len(value) > 1:
            return value[1].text
        if self.kotlin and len(value) > 1 and value[0].kind == "id" and value[0].text[:1].isupper() and value[1].text == "(":
            return value[0].text
        chain = re.sub(r"\([^()]*\)|\{[^{}]*\}", "", "".join(t.text for t in value)).replace("?.", ".").replace(".", "#")
        return chain if re.fullmatch(r"[\w$#]+", chain) and value[0].kind == "id" else None

    def local(self, name: Tok, kind: str | None, scope_end: Tok) -> None:
        self.out["scope_decls"].append({"name": name.text, "type_name": kind, "line": name.line, "col": name.col, "scope_line_start": name.line, "scope_char_start": name.col, "scope_line_end": scope_end.end_line, "scope_char_end": scope_end.end_col})

    def find_type_refs(self) -> None:
        """Capitalised names that stand where a type can: not after a dot, not declared here, not in an import. And, wherever
        they stand, names with type arguments."""
        last = max((x["line"] for x in self.out["imports"]), default=-1)
        declared = {x["name"] for x in self.out["declared_types"]}
        for i, t in enumerate(self.t):
            if t.kind == "id" and t.text[:1].isupper() and t.line > last and not (i and self.t[i - 1].text in (".", "?.", "::", "@", "package", "import")) and t.text not in declared and not t.text.isupper():
                self.out["type_refs"].append({"name": t.text, "line": t.line, "col": t.col})
            if t.kind == "id" and t.text[:1].isupper() and self.is_(i + 1, "<") and not (i and self.t[i - 1].text in ("class", "interface", "record", "enum", "trait", "import")):
                end = self.skip_type_args(i + 1)
                if end > i + 3:  # <> leaves its arguments to inference
                    self.out["generic_usages"].append({"type_name": t.text, "n_args": len(split_top(self.t[i + 2 : end - 1])), "line": t.line, "col": t.col})


def normal_type(name: str | None) -> str:
    """Parameter type for signatures: without annotations, type arguments, qualifiers and nullability; varargs are arrays."""
    if name is None:
        return "Object"
    name = re.sub(r"@\w+\s*", "", name).replace("...", "[]").replace(" ", "")
    while (new := re.sub(r"<[^<>]*>", "", name)) != name:
        name = new
    base, dims = re.match(r"([^\[?]*)\??((?:\[\])*)", name).groups()
    return {"Int": "int", "Long": "long", "Short": "short", "Byte": "byte", "Char": "char", "Float": "float", "Double": "double", "Boolean": "boolean", "Integer": "int", "Any": "Object", "Character": "char"}.get(base.rpartition(".")[2], base.rpartition(".")[2]) + dims


def facts_of(path: str, text: str, language: str) -> dict[str, Any]:
    """All facts of one file; error is set where reading it failed."""
    try:
        return {**Parser(path, text, language).run(), "error": None}
    except Exception as e:  # one file must not stop the others
        return {"path": path, "language": language, "package": None, "error": f"{type(e).__name__}: {e}"}
