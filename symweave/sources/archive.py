"""Archives: external symbols from the classes and sources inside jar files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import EXTERNAL_SYMBOLS, LANGUAGES, SUPERS
from .classfile import read_class
from .parse import facts_of
from .workspace import MAX_LINES

#: One row per archive entry: what it declares, or why it could not be read.
ENTRIES = T.StructType([T.StructField("jar_path", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("symbols", T.ArrayType(EXTERNAL_SYMBOLS)), T.StructField("supers", T.ArrayType(SUPERS)), T.StructField("error", T.StringType())])

_POSITIONS = ("line_start", "line_end", "char_start", "char_end", "ident_line_start", "ident_line_end", "ident_char_start", "ident_char_end")


# The packages of a JDK's src.zip that are read.
JDK_PACKAGES = ("java.lang", "java.util", "java.util.concurrent", "java.util.stream", "java.util.function", "java.io", "java.nio", "java.nio.file", "java.math", "java.time", "java.text", "java.net", "javax.net", "java.sql", "javax.sql")


def wanted(jar: str, entry: str) -> bool:
    """Entries that are read: classes but module-info, and sources; of a JDK's src.zip only the packages listed, in any module."""
    if entry.endswith("module-info.class") or entry.rpartition(".")[2] not in ("class", *LANGUAGES):
        return False
    if jar.rpartition("/")[2] == "src.zip":
        return any(p.replace(".", "/") + "/" in entry for p in JDK_PACKAGES)
    return True


def _from_class(jar: str, entry: str, alt: str | None, data: bytes) -> tuple[list[dict], list[dict]]:
    c = read_class(data)
    if c is None:
        return [], []
    package, _, short = c["name"].rpartition(".")
    place = {"jar_path": jar, "source_file_path": entry, "alt_jar_path": alt, "needs_decompilation": True, "file_type": "java", "package_name": package, "last_modified": 0, **dict.fromkeys(_POSITIONS, 0)}
    none = dict.fromkeys(("parameters", "return_type", "generic_return_type", "documentation", "type_params", "generic_param_types", "method_type_params")) | {"annotations": []}
    rows = [place | {"short_name": short, "fully_qualified_name": c["name"], "parent_name": package, "symbol_type": c["kind"], "modifiers": c["modifiers"], "metadata": none | {"type_params": c["type_params"]}}]
    for m in c["members"]:
        g = m["generic"]
        meta = none | {"parameters": m["parameters"], "return_type": m["return_type"], **({"method_type_params": g[0] or None, "generic_param_types": g[1], "generic_return_type": g[2]} if g else {})}
        rows.append(place | {"short_name": m["short_name"], "fully_qualified_name": f"{c['name']}#{m['short_name']}", "parent_name": c["name"], "symbol_type": m["kind"], "modifiers": m["modifiers"], "metadata": meta})
    return rows, [{"symbol_fqn": c["name"], "super_short_name": re.split(r"[.$]", p)[-1], "super_fqn": p} for p in c["parents"]]


def _from_source(jar: str, entry: str, data: bytes, private_types: bool) -> tuple[list[dict], list[dict]]:
    got = facts_of(entry, data.decode("utf-8", "replace"), LANGUAGES[entry.rpartition(".")[2]])
    if got["error"]:
        raise ValueError(got["error"])
    rows = [{k: v for k, v in s.items() if k != "file_path"} | {"jar_path": jar, "source_file_path": entry, "alt_jar_path": None, "needs_decompilation": False} for s in got["symbols"] if "private" not in s["modifiers"] or private_types and s["symbol_type"] not in ("Function", "Field")]
    return rows, got["supers"]


def read_entries(jar: str, alt: str | None, content: bytes, private_types: bool = False) -> Iterator[dict[str, Any]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if not wanted(jar, name):
                continue
            try:
                data = z.read(name)
                if data.count(b"\n") > MAX_LINES:
                    continue
                rows, edges = _from_class(jar, name, alt, data) if name.endswith(".class") else _from_source(jar, name, data, private_types)
                if rows:
                    yield {"jar_path": jar, "entry": name, "symbols": rows, "supers": edges, "error": None}
            except Exception as e:  # one entry must not stop the others
                yield {"jar_path": jar, "entry": name, "symbols": [], "supers": [], "error": f"{type(e).__name__}: {e}"}


def scan_jars(jars: DataFrame, private_types: bool = False) -> DataFrame:
    """jars(jar_path, alt_jar_path, content binary) -> one row per entry read. Private symbols are left out; private types of
    source entries can stay for hierarchy.without_private, which gives what stands in them to the types around."""
    arrow = to_arrow_schema(ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for jar, alt, content in zip(*batch.columns):
                rows = []
                try:
                    for row in read_entries(jar.as_py(), alt.as_py(), content.as_py(), private_types):
                        rows.append(row)
                        if len(rows) == 64:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                except zipfile.BadZipFile as e:
                    rows.append({"jar_path": jar.as_py(), "entry": None, "symbols": [], "supers": [], "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return jars.select("jar_path", "alt_jar_path", "content").mapInArrow(run, ENTRIES)


def load_jars(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    """chosen(jar_path, alt_jar_path) with their bytes; the paths are read through Spark's own file sources."""
    paths = [r["jar_path"] for r in chosen.select("jar_path").distinct().collect()]  # one short string per dependency
    if not paths:
        return chosen.select("jar_path", "alt_jar_path", F.lit(None).cast("binary").alias("content")).limit(0)
    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.join(chosen, F.regexp_replace("path", "^file:(//)?", "") == F.regexp_replace("jar_path", "^file:(//)?", "")).select("jar_path", "alt_jar_path", "content")
