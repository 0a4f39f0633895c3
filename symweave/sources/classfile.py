"""Reader of JVM class files (the public format): public classes with their non-private methods and fields."""

from __future__ import annotations

import struct
from typing import Any

from ..functions.types import CLASS_BITS, FIELD_BITS, METHOD_BITS, class_type_params, field_type, method_signature, method_types, modifiers_of

_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        got = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return got

    def one(self, form: str) -> int:
        return self.take(form)[0]


def _pool(r: _Reader) -> dict[int, Any]:
    pool: dict[int, Any] = {}
    n, i = r.one("H"), 1
    while i < n:
        tag = r.one("B")
        if tag == 1:
            size = r.one("H")
            pool[i] = r.data[r.at : r.at + size].decode("utf-8", "replace")
            r.at += size
        elif tag == 7:
            pool[i] = ("class", r.one("H"))
        else:
            r.at += _SIZES[tag]
        i += 2 if tag in (5, 6) else 1
    return pool


def _attributes(r: _Reader, pool: dict[int, Any]) -> dict[str, bytes]:
    out = {}
    for _ in range(r.one("H")):
        name, size = r.take("HI")
        out[pool.get(name, "")] = r.data[r.at : r.at + size]
        r.at += size
    return out


def _signature(attributes: dict[str, bytes], pool: dict[int, Any]) -> str | None:
    raw = attributes.get("Signature")
    return pool.get(struct.unpack(">H", raw)[0]) if raw else None


def read_class(data: bytes) -> dict[str, Any] | None:
    """name, kind, modifiers, parents, type_params and members of a public class; None for others.

    Nested classes keep the $ of their binary names.
    """
    r = _Reader(data)
    if r.one("I") != 0xCAFEBABE:
        raise ValueError("not a class file")
    r.take("HH")
    pool = _pool(r)
    flags, this, above = r.take("HHH")
    name = lambda i: pool[pool[i][1]].replace("/", ".")
    faces = [name(r.one("H")) for _ in range(r.one("H"))]
    members = []
    for kind in ("Field", "Function"):
        for _ in range(r.one("H")):
            access, label, descriptor = r.take("HHH")
            attributes = _attributes(r, pool)
            if access & 0x0002 or access & 0x1000:  # private and synthetic ones
                continue
            generic = _signature(attributes, pool)
            row: dict[str, Any] = {"short_name": pool[label], "kind": kind}
            if kind == "Field":
                row |= {"modifiers": modifiers_of(access, FIELD_BITS), "return_type": field_type(pool[descriptor])[0], "parameters": None, "generic": None}
            else:
                params, result = method_types(pool[descriptor])
                row |= {"modifiers": modifiers_of(access, METHOD_BITS), "return_type": result, "parameters": [{"name": f"arg{i}", "type_name": p, "default_value": None} for i, p in enumerate(params)], "generic": method_signature(generic) if generic else None}
            members.append(row)
    own = _attributes(r, pool)
    if not flags & 0x0001:
        return None
    kind = "Annotation" if flags & 0x2000 else "Enum" if flags & 0x4000 else "Interface" if flags & 0x0200 else "Class"
    parents = [*([name(above)] if above else []), *faces]
    return {"name": name(this), "kind": kind, "modifiers": modifiers_of(flags, CLASS_BITS), "parents": [p for p in parents if p != "java.lang.Object"], "type_params": class_type_params(_signature(own, pool)) or None, "members": members}
