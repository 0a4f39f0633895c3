"""The same queries as SQL for DuckDB, over the raw tables. The projection is stated here a second time, by itself."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "types": """SELECT p_partkey AS k, 'com.r' || (p_size % 5) || '.n' || (p_size % 25) AS package_name, s.short AS short_name,
        'com.r' || (p_size % 5) || '.n' || (p_size % 25) || '.' || s.short AS fqn,
        CASE p_partkey % 10 WHEN 0 THEN 'Interface' WHEN 5 THEN 'Enum' WHEN 6 THEN 'Annotation' ELSE 'Class' END AS kind,
        CASE WHEN p_partkey % 4 = 0 THEN 'abstract' WHEN p_partkey % 9 = 0 THEN 'final' ELSE '' END AS mods,
        ['java', 'groovy', 'kotlin'][CAST(p_partkey % 3 + 1 AS INT)] AS language,
        '/ws/m' || (p_partkey % 7) || '/src/' || s.short || '.' || ['java', 'groovy', 'kt'][CAST(p_partkey % 3 + 1 AS INT)] AS file_path
      FROM part, LATERAL (SELECT upper(left(replace(p_name, ' ', ''), 1)) || substr(replace(p_name, ' ', ''), 2) || p_partkey AS short) s""",
    "members": """SELECT DISTINCT *, parent_name || '#' || short_name AS fqn FROM (
        SELECT CASE WHEN l_linenumber <= 4 AND l_orderkey % 20 = 19 THEN 'getM' || (l_partkey % 5) WHEN l_linenumber <= 4 AND l_orderkey % 20 = 18 THEN 'isM' || (l_partkey % 5) ELSE 'm' || (l_orderkey % 20) END AS short_name,
          t.fqn AS parent_name, t.package_name, t.file_path, t.language, CASE WHEN l_linenumber <= 4 THEN 'Function' ELSE 'Field' END AS kind,
          CASE WHEN l_linenumber % 3 = 0 THEN 'private' WHEN l_linenumber % 5 = 0 THEN 'static' ELSE '' END AS mods,
          CASE WHEN l_linenumber <= 4 THEN array_to_string([['int', 'String', 'List<String>', 'T'][CAST((l_orderkey + i) % 4 + 1 AS INT)] FOR i IN range(l_linenumber % 4)], ',') END AS params,
          CASE WHEN l_linenumber <= 4 THEN l_linenumber % 4 END AS arity,
          CASE l_orderkey % 3 WHEN 0 THEN r.short_name WHEN 1 THEN 'int' ELSE 'void' END AS return_type,
          CAST(100 + (l_orderkey % 20) * 10 + l_linenumber % 4 AS INT) AS line
        FROM lineitem JOIN types t ON l_partkey = t.k JOIN types r ON l_partkey // 2 = r.k)""",
    "symbols": """SELECT fqn, short_name, package_name, package_name AS parent_name, file_path, language, kind, mods, CAST(NULL AS VARCHAR) AS params, CAST(NULL AS VARCHAR) AS return_type FROM types
      UNION ALL SELECT fqn, short_name, package_name, parent_name, file_path, language, kind, mods, params, return_type FROM members""",
    "supers": """SELECT c.fqn AS symbol_fqn, p.short_name AS super_short_name, CASE WHEN c.k % 11 <> 0 THEN p.fqn END AS super_fqn FROM types c JOIN types p ON c.k // 3 = p.k WHERE c.k > 0""",
    "closure": """SELECT symbol_fqn AS child, super_fqn AS ancestor, 1 AS depth FROM supers WHERE super_fqn IS NOT NULL
      UNION ALL SELECT c.child, s.super_fqn, c.depth + 1 FROM closure c JOIN supers s ON c.ancestor = s.symbol_fqn WHERE s.super_fqn IS NOT NULL""",
    "reach": """SELECT child, ancestor, depth FROM closure UNION ALL SELECT fqn, fqn, 0 FROM types""",
    "ext_types": """SELECT s_suppkey AS s, 'ext.n' || s_nationkey || '.Lib' || s_suppkey AS fqn, 'Lib' || s_suppkey AS short_name, 'ext.n' || s_nationkey AS package_name,
        'lib' || j || '.jar' AS jar_path, j = 1 AS needs_decompilation, 'Class' AS kind, CAST(s_suppkey % 3 AS INT) AS n_type_params FROM supplier, (VALUES (0), (1)) v(j)""",
    "libs": "SELECT * FROM ext_types WHERE NOT needs_decompilation",
    "ext_members": """SELECT DISTINCT e.fqn || '#x' || l_linenumber AS fqn, 'x' || l_linenumber AS short_name, e.package_name, e.fqn AS parent_name, e.jar_path, false AS needs_decompilation, 'Function' AS kind FROM lineitem JOIN libs e ON l_suppkey = e.s""",
    "ext_symbols": """SELECT fqn, short_name, package_name, package_name AS parent_name, jar_path, needs_decompilation, kind FROM ext_types
      UNION ALL SELECT fqn, short_name, package_name, parent_name, jar_path, needs_decompilation, kind FROM ext_members""",
    "import_lines": """SELECT t.file_path, row_number() OVER (PARTITION BY t.file_path ORDER BY l_orderkey, l_linenumber, l_suppkey) AS ordinal, e.fqn AS import_text FROM lineitem JOIN libs e ON l_suppkey = e.s JOIN types t ON l_partkey = t.k""",
    "imports": """SELECT DISTINCT t.file_path, l_suppkey AS ordinal, e.fqn AS import_text, false AS is_wildcard FROM lineitem JOIN libs e ON l_suppkey = e.s JOIN types t ON l_partkey = t.k
      UNION ALL SELECT DISTINCT t.file_path, l_suppkey + 1000000, 'gone.pkg.Missing' || l_suppkey, false FROM lineitem JOIN types t ON l_partkey = t.k WHERE l_linenumber = 7 AND l_suppkey % 2 = 0
      UNION ALL SELECT t.file_path, 2000000, o.package_name || '.*', true FROM types t JOIN types o ON t.k // 2 = o.k""",
    "type_refs": """SELECT DISTINCT t.file_path, t.package_name, CASE l_linenumber WHEN 7 THEN 'Missing' || l_suppkey WHEN 6 THEN 'Lib' || l_suppkey ELSE n.short_name END AS name,
        CAST(l_orderkey % 1000 AS INT) AS line, CAST(l_linenumber * 4 AS INT) AS col FROM lineitem JOIN types t ON l_partkey = t.k JOIN types n ON l_suppkey = n.k""",
    "sites": """SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, t.file_path, t.language,
        CASE WHEN l_linenumber = 6 THEN e.fqn ELSE p.fqn END AS receiver, CASE WHEN l_linenumber = 6 THEN 'x' || (l_orderkey % 8) ELSE 'm' || (l_orderkey % 25) END AS method,
        CAST(l_linenumber % 4 AS INT) AS argc FROM lineitem JOIN types t ON l_partkey = t.k JOIN types p ON l_suppkey = p.k JOIN libs e ON l_suppkey = e.s""",
    "changes": """SELECT user_id AS uri, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'change' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'watched' ELSE 'delete' END AS kind, event_id AS version, ts FROM events""",
    # resolution
    "asked": "SELECT DISTINCT receiver, method FROM sites",
    "candidates": """SELECT a.receiver, a.method, m.fqn AS target, r.depth, o.source, 0 AS ext FROM asked a, LATERAL (VALUES (0, a.method), (1, 'get' || upper(left(a.method, 1)) || substr(a.method, 2)), (2, 'is' || upper(left(a.method, 1)) || substr(a.method, 2))) o(source, offer)
        JOIN reach r ON r.child = a.receiver JOIN (SELECT DISTINCT parent_name, short_name, fqn FROM members) m ON m.parent_name = r.ancestor AND m.short_name = o.offer
      UNION ALL SELECT a.receiver, a.method, x.fqn, 0, 9, 1 FROM asked a JOIN ext_symbols x ON x.parent_name = a.receiver AND x.short_name = a.method""",
    "resolved": """SELECT receiver, method, target, depth FROM (SELECT *, row_number() OVER (PARTITION BY receiver, method ORDER BY ext, depth, source, target) AS n FROM candidates) WHERE n = 1""",
    "indexed": "SELECT fqn FROM symbols UNION SELECT fqn FROM ext_symbols",
    "names": "SELECT DISTINCT file_path, package_name, name FROM type_refs",
    "guesses": """SELECT n.file_path, n.name, n.name AS fqn, 1 AS priority, 0 AS ordinal FROM names n WHERE contains(n.name, '.')
      UNION ALL SELECT n.file_path, n.name, i.import_text, 2, i.ordinal FROM names n JOIN imports i ON i.file_path = n.file_path AND NOT i.is_wildcard AND split_part(i.import_text, '.', -1) = n.name
      UNION ALL SELECT n.file_path, n.name, replace(i.import_text, '*', n.name), 3, i.ordinal FROM names n JOIN imports i ON i.file_path = n.file_path AND i.is_wildcard WHERE replace(i.import_text, '*', n.name) IN (SELECT fqn FROM indexed)
      UNION ALL SELECT n.file_path, n.name, n.package_name || '.' || n.name, 4, 0 FROM names n WHERE NOT contains(n.name, n.package_name)""",
    "lenient": "SELECT file_path, name, fqn, priority FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY priority, ordinal, fqn) AS n FROM guesses) WHERE n = 1",
    "strictly": "SELECT file_path, name, fqn, priority FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY priority, ordinal, fqn) AS n FROM guesses WHERE priority < 4 OR fqn IN (SELECT fqn FROM symbols)) WHERE n = 1",
    "own_returns": "SELECT parent_name, short_name, min(return_type) AS return_type FROM members WHERE kind = 'Function' GROUP BY ALL",
    # the graph is a forest, so the component of a type is that of its topmost ancestor
    "tops": """SELECT t.fqn, coalesce((SELECT max_by(ancestor, depth) FROM closure c WHERE c.child = t.fqn), t.fqn) AS top FROM types t""",
    "components": "SELECT fqn, min(fqn) OVER (PARTITION BY top) AS component, count(*) OVER (PARTITION BY top) AS n FROM tops",
    "impls": """SELECT t.fqn AS type_fqn, s.symbol_fqn, 'fqn' AS via FROM types t JOIN supers s ON s.super_fqn = t.fqn
      UNION ALL SELECT t.fqn, s.symbol_fqn, 'short_name' FROM types t JOIN supers s ON s.super_short_name = t.short_name WHERE t.fqn NOT IN (SELECT super_fqn FROM supers WHERE super_fqn IS NOT NULL)""",
    "access": "SELECT parent_name AS receiver, short_name AS method, bool_and(mods = 'private') AS all_private, bool_or(mods = 'static') AS any_static FROM members GROUP BY ALL",
    "keys": "SELECT fqn FROM types UNION SELECT fqn FROM members",
    # types of a number that leaves three by seven extend a library class besides
    "library_reach": """SELECT child, ancestor FROM reach UNION SELECT r.child, e.fqn FROM reach r JOIN types t ON t.fqn = r.ancestor JOIN libs e ON e.s = t.k // 7 WHERE t.k % 7 = 3""",
    "library_names": """SELECT DISTINCT l.child AS type_fqn, m.short_name AS name FROM library_reach l JOIN (SELECT parent_name, short_name FROM members UNION SELECT parent_name, short_name FROM ext_members) m ON m.parent_name = l.ancestor""",
    "flat": "SELECT DISTINCT file_path, fqn, kind, mods, coalesce(params, '-') AS params, return_type, line, package_name FROM members",
    "required": """SELECT DISTINCT m.parent_name, m.short_name, m.params, m.arity FROM members m JOIN types t ON t.fqn = m.parent_name WHERE m.kind = 'Function' AND t.kind = 'Interface' AND m.mods <> 'static'""",
    # parents by the one type of a short name in the own package, in that of a wildcard import, or in one of an ancestor (a type without a parent has none)
    "loose": """SELECT s.symbol_fqn AS child, coalesce(s.super_fqn, g.fqn) AS parent FROM supers s LEFT JOIN (
      SELECT x.symbol_fqn, min(p.fqn) AS fqn FROM supers x JOIN types t ON t.fqn = x.symbol_fqn JOIN types w ON w.k = t.k // 2 JOIN types p ON p.short_name = x.super_short_name AND p.package_name IN (t.package_name, w.package_name)
      WHERE x.super_fqn IS NULL GROUP BY x.symbol_fqn HAVING count(*) = 1) g ON g.symbol_fqn = s.symbol_fqn""",
    "loose_closure": """SELECT child, parent AS ancestor, 1 AS depth FROM loose WHERE parent IS NOT NULL
      UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM loose_closure c JOIN loose e ON c.ancestor = e.child WHERE e.parent IS NOT NULL""",
    "loose_tops": "SELECT t.fqn, coalesce((SELECT max_by(ancestor, depth) FROM loose_closure c WHERE c.child = t.fqn), t.fqn) AS top FROM types t",
    # the edges after two batches, and their closure
    "later_edges": """SELECT s.symbol_fqn AS child, CASE WHEN t.k % 19 = 2 THEN s.super_fqn WHEN t.k % 13 = 4 THEN a.fqn WHEN t.k % 17 = 3 THEN NULL ELSE s.super_fqn END AS parent FROM supers s JOIN types t ON t.fqn = s.symbol_fqn JOIN types a ON a.k = t.k // 5""",
    "later_closure": """SELECT child, parent AS ancestor, 1 AS depth FROM later_edges WHERE parent IS NOT NULL
      UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM later_closure c JOIN later_edges e ON c.ancestor = e.child WHERE e.parent IS NOT NULL""",
    # a hierarchy of project, library and inner types; parents left open are settled by the file or by inheritance
    "inner_types": "SELECT k, fqn AS owner, 'Inner' || (k % 3) AS name, fqn || '#Inner' || (k % 3) AS fqn FROM types WHERE k % 5 = 2",
    "settled": """SELECT symbol_fqn, name, fqn FROM (SELECT *, row_number() OVER (PARTITION BY symbol_fqn ORDER BY priority, ordinal, fqn) AS n FROM (
      SELECT s.symbol_fqn, s.super_short_name AS name, i.import_text AS fqn, 2 AS priority, i.ordinal FROM supers s JOIN types t ON t.fqn = s.symbol_fqn JOIN imports i ON i.file_path = t.file_path AND NOT i.is_wildcard AND split_part(i.import_text, '.', -1) = s.super_short_name WHERE s.super_fqn IS NULL
      UNION ALL SELECT s.symbol_fqn, s.super_short_name, replace(i.import_text, '*', s.super_short_name), 3, i.ordinal FROM supers s JOIN types t ON t.fqn = s.symbol_fqn JOIN imports i ON i.file_path = t.file_path AND i.is_wildcard WHERE s.super_fqn IS NULL AND replace(i.import_text, '*', s.super_short_name) IN (SELECT fqn FROM indexed)
      UNION ALL SELECT s.symbol_fqn, s.super_short_name, t.package_name || '.' || s.super_short_name, 4, 0 FROM supers s JOIN types t ON t.fqn = s.symbol_fqn WHERE s.super_fqn IS NULL AND t.package_name || '.' || s.super_short_name IN (SELECT fqn FROM types))) WHERE n = 1""",
    "edges0": """SELECT s.symbol_fqn AS child, s.super_short_name AS name, coalesce(s.super_fqn, x.fqn) AS parent, 0 AS ordinal FROM supers s LEFT JOIN settled x ON x.symbol_fqn = s.symbol_fqn
      UNION ALL SELECT t.fqn, e.short_name, e.fqn, 1 FROM types t JOIN libs e ON e.s = t.k // 7 WHERE t.k % 7 = 3
      UNION ALL SELECT t.fqn, i.name, i.fqn, 2 FROM types t JOIN inner_types i ON i.k = t.k // 10 * 5 + 2 WHERE t.k % 4 = 1 AND t.k > 4
      UNION ALL SELECT i.fqn, t.short_name, t.fqn, 0 FROM inner_types i JOIN types t ON t.k = i.k // 4
      UNION ALL SELECT fqn, 'Inner' || ((k + 1) % 3), NULL, 1 FROM inner_types""",
    # each round: all ways, then open names that the type around the child, or the first ancestor on its ways, offers; this many rounds settle all (one more changes nothing)
    "ways0": """SELECT child, parent AS ancestor, [ordinal] AS path FROM edges0 WHERE parent IS NOT NULL
      UNION ALL SELECT w.child, e.parent, list_append(w.path, e.ordinal) FROM ways0 w JOIN edges0 e ON e.child = w.ancestor WHERE e.parent IS NOT NULL""",
    "edges1": """SELECT e.child, e.name, coalesce(e.parent, o.fqn) AS parent, e.ordinal FROM edges0 e LEFT JOIN (
      SELECT child, name, fqn FROM (SELECT x.child, x.name, n.fqn, row_number() OVER (PARTITION BY x.child, x.name ORDER BY w.path, n.fqn) AS r FROM edges0 x JOIN inner_types i ON i.fqn = x.child JOIN (SELECT child, ancestor, path FROM ways0 UNION ALL SELECT fqn, fqn, [] FROM types) w ON w.child = i.owner JOIN inner_types n ON n.owner = w.ancestor AND n.name = x.name AND n.fqn <> x.child WHERE x.parent IS NULL) WHERE r = 1) o
      ON o.child = e.child AND o.name = e.name AND e.parent IS NULL""",
    "ways1": """SELECT child, parent AS ancestor, [ordinal] AS path FROM edges1 WHERE parent IS NOT NULL
      UNION ALL SELECT w.child, e.parent, list_append(w.path, e.ordinal) FROM ways1 w JOIN edges1 e ON e.child = w.ancestor WHERE e.parent IS NOT NULL""",
    "edges2": """SELECT e.child, e.name, coalesce(e.parent, o.fqn) AS parent, e.ordinal FROM edges1 e LEFT JOIN (
      SELECT child, name, fqn FROM (SELECT x.child, x.name, n.fqn, row_number() OVER (PARTITION BY x.child, x.name ORDER BY w.path, n.fqn) AS r FROM edges1 x JOIN inner_types i ON i.fqn = x.child JOIN (SELECT child, ancestor, path FROM ways1 UNION ALL SELECT fqn, fqn, [] FROM types) w ON w.child = i.owner JOIN inner_types n ON n.owner = w.ancestor AND n.name = x.name AND n.fqn <> x.child WHERE x.parent IS NULL) WHERE r = 1) o
      ON o.child = e.child AND o.name = e.name AND e.parent IS NULL""",
    "ways2": """SELECT child, parent AS ancestor, [ordinal] AS path FROM edges2 WHERE parent IS NOT NULL
      UNION ALL SELECT w.child, e.parent, list_append(w.path, e.ordinal) FROM ways2 w JOIN edges2 e ON e.child = w.ancestor WHERE e.parent IS NOT NULL""",
    "edges3": """SELECT e.child, e.name, coalesce(e.parent, o.fqn) AS parent, e.ordinal FROM edges2 e LEFT JOIN (
      SELECT child, name, fqn FROM (SELECT x.child, x.name, n.fqn, row_number() OVER (PARTITION BY x.child, x.name ORDER BY w.path, n.fqn) AS r FROM edges2 x JOIN inner_types i ON i.fqn = x.child JOIN (SELECT child, ancestor, path FROM ways2 UNION ALL SELECT fqn, fqn, [] FROM types) w ON w.child = i.owner JOIN inner_types n ON n.owner = w.ancestor AND n.name = x.name AND n.fqn <> x.child WHERE x.parent IS NULL) WHERE r = 1) o
      ON o.child = e.child AND o.name = e.name AND e.parent IS NULL""",
    "ways3": """SELECT child, parent AS ancestor, [ordinal] AS path FROM edges3 WHERE parent IS NOT NULL
      UNION ALL SELECT w.child, e.parent, list_append(w.path, e.ordinal) FROM ways3 w JOIN edges3 e ON e.child = w.ancestor WHERE e.parent IS NOT NULL""",
    "edges4": """SELECT e.child, e.name, coalesce(e.parent, o.fqn) AS parent, e.ordinal FROM edges3 e LEFT JOIN (
      SELECT child, name, fqn FROM (SELECT x.child, x.name, n.fqn, row_number() OVER (PARTITION BY x.child, x.name ORDER BY w.path, n.fqn) AS r FROM edges3 x JOIN inner_types i ON i.fqn = x.child JOIN (SELECT child, ancestor, path FROM ways3 UNION ALL SELECT fqn, fqn, [] FROM types) w ON w.child = i.owner JOIN inner_types n ON n.owner = w.ancestor AND n.name = x.name AND n.fqn <> x.child WHERE x.parent IS NULL) WHERE r = 1) o
      ON o.child = e.child AND o.name = e.name AND e.parent IS NULL""",
    "ways4": """SELECT child, parent AS ancestor, [ordinal] AS path FROM edges4 WHERE parent IS NOT NULL
      UNION ALL SELECT w.child, e.parent, list_append(w.path, e.ordinal) FROM ways4 w JOIN edges4 e ON e.child = w.ancestor WHERE e.parent IS NOT NULL""",
    "first_ways": "SELECT child, ancestor, min(path) AS path FROM ways4 GROUP BY ALL",
    "mixed_calls": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, receiver, CASE l_orderkey % 3 WHEN 0 THEN method WHEN 1 THEN 'x' || (l_orderkey % 9) ELSE 'z' || (l_orderkey % 3) END AS method FROM sites""",
    "mixed_members": """SELECT DISTINCT parent_name, short_name, fqn FROM members UNION ALL SELECT fqn, 'z' || (k % 3), fqn || '#z' || (k % 3) FROM inner_types""",
    "mixed_found": """SELECT receiver, method, target, depth FROM (SELECT *, row_number() OVER (PARTITION BY receiver, method ORDER BY last, path, source, target) AS n FROM (
      SELECT a.receiver, a.method, m.fqn AS target, len(r.path) AS depth, r.path, o.source, 0 AS last FROM (SELECT DISTINCT receiver, method FROM mixed_calls) a,
        LATERAL (VALUES (0, a.method), (1, 'get' || upper(left(a.method, 1)) || substr(a.method, 2)), (2, 'is' || upper(left(a.method, 1)) || substr(a.method, 2))) o(source, offer)
        JOIN (SELECT child, ancestor, path FROM first_ways UNION ALL SELECT fqn, fqn, [] FROM types) r ON r.child = a.receiver JOIN mixed_members m ON m.parent_name = r.ancestor AND m.short_name = o.offer
      UNION ALL SELECT a.receiver, a.method, x.fqn, len(r.path), r.path, 9, 0 FROM (SELECT DISTINCT receiver, method FROM mixed_calls) a JOIN first_ways r ON r.child = a.receiver JOIN ext_members x ON x.parent_name = r.ancestor AND x.short_name = a.method
      UNION ALL SELECT a.receiver, a.method, x.fqn, 0, [], 9, 1 FROM (SELECT DISTINCT receiver, method FROM mixed_calls) a JOIN ext_members x ON x.parent_name = a.receiver AND x.short_name = a.method)) WHERE n = 1""",
}


def with_ctes(body: str) -> str:
    """The body with the relations that it, or they, name."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s+\w)", sql):
                need.append(name)
                visit(CTES[name])

    visit(body)
    order = [n for n in CTES if n in need]
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" if order else "") + body


SITE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

BODIES: dict[str, str] = {
    "definition_by_call_site": f"SELECT {SITE}, s.receiver, s.method, r.target, CAST(r.depth AS INT) AS depth FROM sites s JOIN resolved r ON r.receiver = s.receiver AND r.method = s.method",
    "parents_by_context_and_inheritance": "SELECT child, name, parent, CAST(ordinal AS INT) AS ordinal FROM edges4",
    "closure_of_resolved_parents": "SELECT child, ancestor, CAST(len(path) AS INT) AS depth, array_to_string(path, '.') AS way FROM first_ways",
    "definition_below_libraries": f"SELECT {SITE}, c.receiver, c.method, f.target, CAST(f.depth AS INT) AS depth FROM mixed_calls c JOIN mixed_found f ON f.receiver = c.receiver AND f.method = c.method",
    "resolve_fqn_lenient": "SELECT file_path, name, fqn, CAST(priority AS INT) AS priority FROM lenient",
    "resolve_fqn_strict": "SELECT file_path, name, fqn, CAST(priority AS INT) AS priority FROM strictly",
    "resolve_index_time": "SELECT DISTINCT r.file_path, r.name, (SELECT arg_min(i.import_text, i.ordinal) FROM imports i WHERE i.file_path = r.file_path AND NOT i.is_wildcard AND split_part(i.import_text, '.', -1) = r.name) AS fqn FROM type_refs r",
    "fqn_to_symbol": """SELECT q.fqn, CASE WHEN t.fqn IS NOT NULL THEN 'project' ELSE 'external' END AS origin, coalesce(t.kind, e.kind) AS kind, coalesce(t.file_path, e.jar_path) AS place
      FROM (SELECT fqn FROM types UNION SELECT fqn FROM ext_types UNION SELECT fqn || 'Gone' FROM types) q LEFT JOIN types t ON t.fqn = q.fqn
      LEFT JOIN ext_types e ON e.fqn = q.fqn AND NOT e.needs_decompilation WHERE t.fqn IS NOT NULL OR e.fqn IS NOT NULL""",
    "property_accessor_lookup": """SELECT type_fqn, field, accessor, target FROM (SELECT t.fqn AS type_fqn, f.field, m.short_name AS accessor, m.fqn AS target, row_number() OVER (PARTITION BY t.fqn, f.field ORDER BY m.short_name LIKE 'is%') AS n
      FROM types t, (VALUES ('m0'), ('m1'), ('m2'), ('m3'), ('m4')) f(field) JOIN (SELECT DISTINCT parent_name, short_name, fqn FROM members WHERE kind = 'Function') m ON m.parent_name = t.fqn AND m.short_name IN ('getM' || substr(f.field, 2), 'isM' || substr(f.field, 2))) WHERE n = 1""",
    "overload_by_arity": f"SELECT DISTINCT {SITE}, s.receiver, s.method, m.params FROM sites s JOIN members m ON m.parent_name = s.receiver AND m.short_name = s.method AND m.arity = s.argc",
    "overload_by_types": f"""SELECT {SITE}, count(*) AS n, CASE WHEN count(*) = 1 THEN min(params) ELSE min(params) FILTER (params = args) END AS chosen FROM (
      SELECT DISTINCT {SITE}, m.params, array_to_string([['int', 'String', 'List<String>', 'T'][CAST((l_orderkey + i) % 4 + 1 AS INT)] FOR i IN range(l_linenumber % 4)], ',') AS args
      FROM sites s JOIN members m ON m.parent_name = s.receiver AND m.short_name = s.method AND m.arity = s.argc) GROUP BY {SITE}""",
    "symbol_by_fqn": "SELECT fqn, min(file_path) AS file_path, CASE WHEN bool_or(params IS NULL) THEN NULL ELSE min(params) END AS params FROM symbols WHERE fqn IN (SELECT fqn FROM keys) GROUP BY fqn",
    "symbols_by_fqn_all_overloads": "SELECT s.fqn, kind, mods, params, return_type FROM symbols s WHERE s.fqn IN (SELECT fqn FROM keys)",
    "children_of_type": "SELECT m.parent_name, m.fqn, m.kind, m.mods, m.params, m.return_type FROM members m WHERE m.parent_name IN (SELECT fqn FROM types)",
    "symbols_of_file": "SELECT file_path, fqn, kind, mods, params, return_type FROM symbols WHERE file_path IN (SELECT file_path FROM types)",
    "external_prefer_sources": "SELECT fqn, arg_min(jar_path, needs_decompilation) AS jar_path, min(needs_decompilation) AS needs_decompilation FROM ext_types GROUP BY fqn",
    "external_children_on_classpath": "SELECT e.fqn AS parent_name, m.fqn, m.jar_path FROM libs e JOIN ext_symbols m ON m.parent_name = e.fqn WHERE e.s % 3 = 0 OR (e.s % 3 = 1 AND m.jar_path = 'lib0.jar') OR (e.s % 3 = 2 AND m.jar_path = 'lib9.jar')",
    "prefix_search_types": """SELECT fqn, CAST(probe AS INT) AS probe FROM (SELECT fqn, min(probe) AS probe FROM (
      (SELECT fqn, 0 AS probe FROM types WHERE starts_with(fqn, 'red') ORDER BY fqn LIMIT 100) UNION ALL (SELECT fqn, 1 FROM types WHERE starts_with(short_name, 'Red') ORDER BY fqn LIMIT 100)) GROUP BY fqn) ORDER BY probe, fqn LIMIT 200""",
    "prefix_search_external": """SELECT fqn, jar_path, CAST(probe AS INT) AS probe FROM (SELECT * FROM (SELECT fqn, jar_path, probe, row_number() OVER (PARTITION BY fqn ORDER BY probe, jar_path) AS n FROM (
      (SELECT fqn, jar_path, 0 AS probe FROM ext_types WHERE starts_with(fqn, 'ext.n1') ORDER BY fqn, jar_path LIMIT 100) UNION ALL (SELECT fqn, jar_path, 1 FROM ext_types WHERE starts_with(short_name, 'Ext.n1') ORDER BY fqn, jar_path LIMIT 100)))
      WHERE n = 1 ORDER BY probe, fqn LIMIT 200) WHERE jar_path = 'lib0.jar'""",
    "implementers_by_fqn": "SELECT s.super_fqn, t.fqn, t.kind FROM supers s JOIN types t ON t.fqn = s.symbol_fqn WHERE s.super_fqn IS NOT NULL",
    "implementers_by_short_name": "SELECT s.super_short_name, t.fqn FROM supers s JOIN types t ON t.fqn = s.symbol_fqn WHERE s.super_short_name IN (SELECT short_name FROM types)",
    "supertypes_of_symbol": "SELECT s.symbol_fqn, t.fqn, t.kind, t.file_path FROM supers s JOIN types t ON t.fqn = s.super_fqn",
    "distinct_source_files": "SELECT DISTINCT file_path FROM symbols ORDER BY file_path",
    "supertype_closure": "SELECT child, ancestor, CAST(min(depth) AS INT) AS depth FROM closure GROUP BY child, ancestor",
    "closure_after_edge_batches": "SELECT child, ancestor, CAST(depth AS INT) AS depth FROM later_closure",
    "external_children_of_private_types": """SELECT jar_path, CASE WHEN p = lib THEN lib ELSE p END || '#' || tail AS fqn, p AS parent_name, kind FROM (
        SELECT e.jar_path, e.fqn AS lib, array_to_string(list_concat([e.fqn], list_transform(list_filter(range(1, v.upto + 1), lambda i: (e.s + i) % 3 <> 0), lambda i: 'N' || i)), '#') AS p, v.tail, v.kind
        FROM libs e, LATERAL (SELECT d - 1 AS upto, 'N' || d AS tail, 'Class' AS kind FROM range(1, 6) r(d) WHERE (e.s + d) % 3 <> 0 UNION ALL SELECT d, 'run' || d, 'Function' FROM range(1, 6) r(d)) v)
      UNION ALL SELECT jar_path, fqn, package_name, 'Class' FROM libs""",
    "hierarchy_component_by_short_names": "SELECT fqn, component FROM (SELECT fqn, min(fqn) OVER (PARTITION BY top) AS component, count(*) OVER (PARTITION BY top) AS n FROM loose_tops) WHERE n > 1",
    "unimplemented_below_libraries": """SELECT t.fqn AS symbol_fqn, e.fqn AS super_fqn, q.method, q.params FROM types t JOIN libs e ON e.s = t.k // 7, LATERAL (SELECT 'm' || ((e.s + i) % 20) AS method, CASE WHEN i % 2 = 0 THEN '' ELSE 'int' END AS params FROM range(0, 5) r(i)) q
      WHERE t.k % 7 = 3 AND t.kind = 'Class' AND t.mods <> 'abstract' AND NOT EXISTS (SELECT 1 FROM members m WHERE m.parent_name = t.fqn AND m.kind = 'Function' AND m.short_name = q.method AND m.params = q.params)""",
    "reachable_member_names": "SELECT DISTINCT r.child AS type_fqn, m.short_name AS name FROM reach r JOIN members m ON m.parent_name = r.ancestor",
    "reachable_names_below_libraries": "SELECT type_fqn, name FROM library_names",
    "nearest_inherited_return": """SELECT type_fqn, name, from_fqn, return_type FROM (SELECT r.child AS type_fqn, o.short_name AS name, r.ancestor AS from_fqn, o.return_type, r.depth, row_number() OVER (PARTITION BY r.child, o.short_name ORDER BY r.depth) AS n
      FROM reach r JOIN own_returns o ON o.parent_name = r.ancestor) WHERE n = 1""",
    "required_methods": "SELECT parent_name, short_name, params FROM required",
    "hierarchy_component": "SELECT fqn, component FROM components WHERE n > 1",
    "implementation_of_type": "SELECT type_fqn, symbol_fqn, via FROM impls",
    "implementation_of_method": """SELECT DISTINCT i.type_fqn, a.short_name AS method, CAST(a.arity AS INT) AS arity, b.fqn AS target FROM impls i JOIN members a ON a.parent_name = i.type_fqn AND a.kind = 'Function'
      JOIN members b ON b.parent_name = i.symbol_fqn AND b.kind = 'Function' AND b.short_name = a.short_name AND b.arity = a.arity""",
    "completion_members": """SELECT DISTINCT m.parent_name AS receiver, m.short_name, m.fqn, 'project' AS origin FROM members m JOIN types t ON t.fqn = m.parent_name
      UNION ALL SELECT DISTINCT e.fqn, x.short_name, x.fqn, 'external' FROM libs e JOIN ext_symbols x ON x.parent_name = e.fqn WHERE e.s % 2 <> 0 OR x.jar_path = 'lib0.jar'""",
    "completion_prefix": """SELECT prefix, fqn, origin, CAST(rnk AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix, fqn ORDER BY rnk) AS f FROM (
      SELECT *, CASE WHEN origin = 'project' AND package_name = 'com.r1.n1' THEN 1 WHEN origin = 'project' THEN 2 ELSE 3 END AS rnk FROM (
        SELECT *, row_number() OVER (PARTITION BY prefix, origin ORDER BY probe, fqn) AS g FROM (
          SELECT *, row_number() OVER (PARTITION BY prefix, origin, fqn ORDER BY probe) AS d FROM (
            SELECT *, row_number() OVER (PARTITION BY prefix, origin, probe ORDER BY fqn) AS n FROM (
              SELECT p.prefix, x.fqn, x.package_name, x.origin, v.probe FROM (SELECT DISTINCT lower(left(short_name, 3)) AS prefix FROM types UNION ALL SELECT DISTINCT left(fqn, 6) FROM types) p,
                (SELECT fqn, short_name, package_name, 'project' AS origin FROM types UNION ALL SELECT fqn, short_name, package_name, 'external' FROM ext_types) x, (VALUES (0), (1)) v(probe)
              WHERE CASE v.probe WHEN 0 THEN starts_with(x.fqn, lower(p.prefix)) ELSE starts_with(x.short_name, upper(left(p.prefix, 1)) || lower(substr(p.prefix, 2))) END)) WHERE n <= 100) WHERE d = 1) WHERE g <= 200)) WHERE f = 1""",
    "references_text": """SELECT id, line, n FROM (SELECT doc_id AS id, CAST(i - 1 AS INT) AS line, CAST(len(list_filter(regexp_split_to_array(lines[i], '[^A-Za-z0-9_]'), lambda w: w = 'the')) AS BIGINT) AS n
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)) WHERE n > 0""",
    "references_resolved": f"SELECT {SITE}, s.file_path, r.target FROM sites s JOIN resolved r ON r.receiver = s.receiver AND r.method = s.method WHERE r.target IN (SELECT fqn FROM members)",
    "rename_type_edits": """SELECT file_path, CAST(k % 50 AS INT) AS line, 6 AS col, short_name || 'Renamed' AS new_text FROM types
      UNION SELECT r.file_path, r.line, r.col, t.short_name || 'Renamed' FROM type_refs r JOIN lenient l ON l.file_path = r.file_path AND l.name = r.name JOIN types t ON t.fqn = l.fqn""",
    "rename_function_edits": """SELECT DISTINCT m.file_path, m.line, 8 AS col, 'renamed' || upper(left(m.short_name, 1)) || substr(m.short_name, 2) AS new_text FROM members m JOIN components c ON c.fqn = m.parent_name WHERE m.kind = 'Function'
      AND EXISTS (SELECT 1 FROM members a JOIN components b ON b.fqn = a.parent_name JOIN types t ON t.fqn = a.parent_name AND t.kind = 'Interface' WHERE a.kind = 'Function' AND a.short_name = m.short_name AND b.component = c.component AND a.params = m.params)""",
    "rename_field_edits": """SELECT file_path, line, 8 AS col, short_name || 'Next' AS new_text FROM members WHERE kind = 'Field'
      UNION SELECT f.file_path, f.line, 8, f.short_name || 'Next' FROM members f JOIN members d ON d.parent_name = f.parent_name AND d.kind = 'Field'
        AND f.short_name IN ('getM' || substr(d.short_name, 2), 'setM' || substr(d.short_name, 2), 'isM' || substr(d.short_name, 2)) WHERE f.kind = 'Function'""",
    "declaration_at_cursor": """SELECT DISTINCT l_orderkey, l_linenumber, t.file_path, CAST(100 + (l_orderkey % 20) * 10 + l_linenumber % 4 AS INT) AS line, CAST(CAST(l_quantity AS INT) % 20 AS INT) AS col, m.fqn
      FROM lineitem JOIN types t ON l_partkey = t.k JOIN members m ON m.file_path = t.file_path AND m.line = 100 + (l_orderkey % 20) * 10 + l_linenumber % 4 AND CAST(l_quantity AS INT) % 20 BETWEEN 8 AND 8 + length(m.short_name)""",
    "hover_text": """SELECT DISTINCT fqn, '```' || language || chr(10) || 'package ' || package_name || chr(10) || chr(10) || trim(mods || CASE WHEN mods <> '' THEN ' ' ELSE '' END
      || CASE WHEN word <> '' THEN word || ' ' ELSE '' END || body) || chr(10) || '```' AS markdown FROM (SELECT *,
        CASE kind WHEN 'Class' THEN 'class' WHEN 'Interface' THEN 'interface' WHEN 'Enum' THEN CASE language WHEN 'kotlin' THEN 'enum class' ELSE 'enum' END WHEN 'Annotation' THEN CASE language WHEN 'kotlin' THEN 'annotation class' ELSE '@interface' END
          WHEN 'Function' THEN CASE language WHEN 'kotlin' THEN 'fun' ELSE '' END ELSE '' END AS word,
        CASE kind WHEN 'Function' THEN CASE language WHEN 'kotlin' THEN short_name || '(' || replace(params, ',', ', ') || '): ' || return_type ELSE return_type || ' ' || short_name || '(' || replace(params, ',', ', ') || ')' END
          WHEN 'Field' THEN CASE language WHEN 'kotlin' THEN short_name || ': ' || return_type ELSE return_type || ' ' || short_name END ELSE short_name END AS body FROM symbols)""",
    "import_insertion_edit": """SELECT fqn, CAST(CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END AS INT) AS line,
      'import ' || CASE WHEN k % 6 = 1 THEN 'p.q.Outer.Inner' ELSE 'p.q.Other' END || CASE language WHEN 'java' THEN ';' ELSE '' END || chr(10) AS text FROM types WHERE k % 6 <> 0""",
    "duplicate_import": "SELECT file_path, CAST(ordinal AS INT) AS ordinal, import_text FROM (SELECT *, row_number() OVER (PARTITION BY file_path, import_text ORDER BY ordinal) AS n FROM import_lines) WHERE n > 1",
    "duplicate_method_signature": "SELECT parent_name, short_name, params, mods, return_type FROM (SELECT *, row_number() OVER (PARTITION BY parent_name, short_name, params ORDER BY mods, return_type) AS n FROM members WHERE kind = 'Function') WHERE n > 1",
    "unresolved_symbol": "SELECT r.file_path, r.name, s.fqn, r.line, r.col FROM type_refs r JOIN strictly s ON s.file_path = r.file_path AND s.name = r.name WHERE s.fqn NOT IN (SELECT fqn FROM indexed)",
    "final_class_extended": "SELECT c.file_path, s.symbol_fqn, s.super_fqn FROM supers s JOIN types c ON c.fqn = s.symbol_fqn AND c.mods <> 'abstract' JOIN types p ON p.fqn = s.super_fqn AND p.mods = 'final'",
    "unimplemented_abstract_methods": """SELECT s.symbol_fqn, s.super_fqn, q.short_name AS method, q.params FROM supers s JOIN types c ON c.fqn = s.symbol_fqn AND c.kind = 'Class' AND c.mods <> 'abstract' JOIN required q ON q.parent_name = s.super_fqn
      WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.parent_name = s.symbol_fqn AND m.kind = 'Function' AND m.short_name = q.short_name AND m.arity = q.arity
        AND (q.arity = 0 OR len(list_filter(range(1, q.arity + 1), lambda i: NOT (string_split(m.params, ',')[i] = string_split(q.params, ',')[i] OR string_split(q.params, ',')[i] = 'T'))) = 0))""",
    "abstract_class_instantiated": f"SELECT {SITE}, s.file_path, s.receiver AS type_fqn FROM sites s JOIN types t ON t.fqn = s.receiver AND t.mods = 'abstract' WHERE s.language <> 'kotlin'",
    "method_not_found": f"""SELECT {SITE}, s.receiver, s.method FROM sites s WHERE s.language = 'java' AND s.receiver IN (SELECT fqn FROM types)
      AND NOT EXISTS (SELECT 1 FROM reach r JOIN members m ON m.parent_name = r.ancestor WHERE r.child = s.receiver AND m.short_name = s.method)""",
    "method_not_found_below_libraries": f"""SELECT {SITE}, s.receiver, 'x' || (l_orderkey % 9 + 1) AS method FROM sites s JOIN types t ON t.fqn = s.receiver LEFT JOIN library_names n ON n.type_fqn = s.receiver AND n.name = 'x' || (l_orderkey % 9 + 1)
      WHERE s.language = 'java' AND n.name IS NULL""",
    "inaccessible_member": f"SELECT {SITE}, s.receiver, s.method FROM sites s JOIN access a ON a.receiver = s.receiver AND a.method = s.method WHERE a.all_private",
    "static_member_via_instance": f"SELECT {SITE}, s.receiver, s.method FROM sites s JOIN access a ON a.receiver = s.receiver AND a.method = s.method WHERE a.any_static AND NOT a.all_private",
    "wrong_type_argument_count": "SELECT DISTINCT l_orderkey, l_linenumber, e.fqn AS type_fqn, CAST(l_linenumber % 4 AS INT) AS n_args, e.n_type_params FROM lineitem JOIN libs e ON l_suppkey = e.s WHERE e.n_type_params > 0 AND l_linenumber % 4 <> e.n_type_params",
    "override_incompatible_signature": """SELECT type_fqn, name, own_return, from_fqn, inherited_return FROM (SELECT o.parent_name AS type_fqn, o.short_name AS name, o.return_type AS own_return, c.ancestor AS from_fqn, p.return_type AS inherited_return,
        row_number() OVER (PARTITION BY o.parent_name, o.short_name ORDER BY c.depth) AS n FROM own_returns o JOIN closure c ON c.child = o.parent_name JOIN own_returns p ON p.parent_name = c.ancestor AND p.short_name = o.short_name)
      WHERE n = 1 AND own_return <> inherited_return AND own_return <> 'void' AND inherited_return <> 'void'""",
    "narrowing_conversion": f"""SELECT {SITE}, declared_type, rhs_type FROM (SELECT {SITE}, ['byte', 'short', 'int', 'long', 'float', 'double'][CAST(l_linenumber % 6 + 1 AS INT)] AS declared_type, ['byte', 'short', 'int', 'long', 'float', 'double'][CAST(l_orderkey % 6 + 1 AS INT)] AS rhs_type
      FROM sites WHERE language <> 'kotlin') WHERE list_position(['byte', 'short', 'int', 'long', 'float', 'double'], rhs_type) > list_position(['byte', 'short', 'int', 'long', 'float', 'double'], declared_type)""",
    "wrong_argument_types": f"""SELECT {SITE}, receiver, method FROM (SELECT {SITE}, s.receiver, s.method, bool_or(m.arity = s.argc AND len(list_filter(range(s.argc), lambda i: NOT CASE (l_orderkey + i) % 5
        WHEN 0 THEN string_split(m.params, ',')[i + 1] IN ('int', 'T') WHEN 1 THEN string_split(m.params, ',')[i + 1] IN ('String', 'T') WHEN 2 THEN string_split(m.params, ',')[i + 1] <> 'int' ELSE string_split(m.params, ',')[i + 1] IN ('int', 'T') END)) = 0) AS fits
      FROM sites s JOIN (SELECT DISTINCT parent_name, short_name, params, arity FROM members WHERE kind = 'Function') m ON m.parent_name = s.receiver AND m.short_name = s.method
      WHERE len(list_filter(range(s.argc), lambda i: (l_orderkey + i) % 5 = 4)) = 0 GROUP BY ALL) WHERE NOT fits""",
    "replace_by_file": """SELECT file_path, fqn, kind, mods, params, return_type FROM (SELECT file_path, fqn, kind, mods, params, return_type FROM members_flat WHERE file_path NOT IN (SELECT file_path FROM types JOIN members USING (file_path) WHERE k % 7 = 0 AND members.kind = 'Function'))
      UNION ALL SELECT DISTINCT file_path, fqn, kind, 'updated', params, return_type FROM members_flat WHERE kind = 'Function' AND file_path IN (SELECT file_path FROM types WHERE k % 7 = 0)""".replace("members_flat", "(SELECT file_path, fqn, kind, mods, coalesce(params, '-') AS params, return_type FROM members)"),
    "replace_edges_by_symbol": "SELECT symbol_fqn, super_short_name, CASE WHEN length(symbol_fqn) % 3 = 0 THEN 'new.Parent' ELSE super_fqn END AS super_fqn FROM supers",
    "delete_file": """SELECT 'symbols' AS what, file_path AS name, count(*) AS n FROM symbols WHERE file_path NOT IN (SELECT file_path FROM types WHERE k % 7 = 0) GROUP BY ALL
      UNION ALL SELECT 'edge', symbol_fqn, 1 FROM supers WHERE symbol_fqn NOT IN (SELECT fqn FROM types WHERE k % 7 = 0)""",
    "delete_jar": "SELECT fqn, jar_path FROM ext_symbols WHERE jar_path <> 'lib1.jar'",
    "upsert_external": """SELECT jar_path, fqn, kind, CASE WHEN length(fqn) % 2 = 0 THEN NOT needs_decompilation ELSE needs_decompilation END AS needs_decompilation FROM ext_symbols
      UNION ALL SELECT jar_path, fqn || 'New', kind, needs_decompilation FROM ext_types""",
    "manifest_diff": "SELECT '/repo/lib' || s_suppkey || '.jar' AS jar_path, CASE WHEN s_suppkey % 2 = 0 THEN 'removed' ELSE 'added' END AS change FROM supplier WHERE (s_suppkey % 2 = 0) <> (s_suppkey % 3 = 0)",
    "latest_buffer_per_uri": "SELECT uri, max(version) AS version, arg_max(kind, version) AS kind FROM changes WHERE kind IN ('open', 'change') GROUP BY uri",
    "debounced_changes": """SELECT uri, CAST(burst AS BIGINT) AS burst, count(*) AS n, max(version) AS version, max(ts) AS flushed_after FROM (SELECT *, sum(fresh) OVER (PARTITION BY uri ORDER BY ts, version) AS burst FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY uri ORDER BY ts, version) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM changes)) GROUP BY uri, burst""",
    "ttl_eviction": "SELECT uri, max(ts) AS last FROM changes GROUP BY uri HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE",
    "change_router": """SELECT uri, version, CASE kind WHEN 'delete' THEN 'delete' WHEN 'save' THEN 'reindex_now' ELSE CASE WHEN state = 'open' THEN 'skip_open' ELSE 'debounce' END END AS route FROM (
      SELECT c.*, (SELECT arg_max(p.kind, p.version) FROM changes p WHERE p.uri = c.uri AND p.version < c.version AND p.kind IN ('open', 'delete')) AS state FROM changes c) WHERE kind IN ('watched', 'delete', 'save')""",
    "completion_ranked": """SELECT DISTINCT fqn, 'project' AS origin, CASE WHEN package_name = 'com.r1.n1' THEN 1 ELSE 2 END AS rank FROM members UNION ALL SELECT fqn, 'external', 3 FROM ext_members""",
    "chain_resolution_two_steps": f"""SELECT {SITE}, a.target AS one_target, b.target AS two_target, coalesce(y.fqn, 'java.lang.Object') AS result FROM starts s
      LEFT JOIN first_hits a ON a.receiver = s.receiver AND a.method = s.one LEFT JOIN gives x ON x.target = a.target LEFT JOIN first_hits b ON b.receiver = coalesce(x.fqn, 'java.lang.Object') AND b.method = s.two LEFT JOIN gives y ON y.target = b.target""",
}

# two-step chains: project members from every type upwards, and library members on the receiver itself
CTES["starts"] = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, receiver, method AS one, 'm' || ((l_orderkey + 7) % 20) AS two FROM sites"
CTES["first_hits"] = """SELECT receiver, method, target FROM (SELECT r.child AS receiver, q.method, m.fqn AS target, row_number() OVER (PARTITION BY r.child, q.method ORDER BY r.depth, o.source, m.fqn) AS n
      FROM (SELECT DISTINCT one AS method FROM starts UNION SELECT two FROM starts) q, LATERAL (VALUES (0, q.method), (1, 'get' || upper(left(q.method, 1)) || substr(q.method, 2)), (2, 'is' || upper(left(q.method, 1)) || substr(q.method, 2))) o(source, offer)
      JOIN (SELECT DISTINCT parent_name, short_name, fqn FROM members) m ON m.short_name = o.offer JOIN reach r ON r.ancestor = m.parent_name) WHERE n = 1
      UNION ALL SELECT parent_name, short_name, fqn FROM ext_members"""
CTES["gives"] = "SELECT m.fqn AS target, min(t.fqn) AS fqn FROM members m JOIN types t ON t.short_name = m.return_type GROUP BY m.fqn"

ORACLES: dict[str, str] = {name: with_ctes(body) for name, body in BODIES.items()}

ORACLES |= {
    name: with_ctes(body)
    for name, body in {
        "parse_corpus_symbols": """SELECT fqn AS fully_qualified_name, kind AS symbol_type, package_name AS parent_name, file_path,
            array_to_string(list_filter([nullif(mods, ''), CASE WHEN language = 'kotlin' AND kind = 'Enum' THEN 'enum' WHEN language = 'kotlin' AND kind = 'Annotation' THEN 'annotation' END], lambda x: x IS NOT NULL), ',') AS mods, CAST(NULL AS VARCHAR) AS params, CAST(NULL AS VARCHAR) AS return_type FROM types
          UNION ALL SELECT DISTINCT fqn, kind, parent_name, file_path, CASE WHEN language <> 'kotlin' THEN mods WHEN kind = 'Field' THEN CASE mods WHEN 'private' THEN 'private,val' ELSE 'val' END ELSE replace(mods, 'static', '') END, params, return_type
            FROM (SELECT * FROM members WHERE parent_name NOT IN (SELECT fqn FROM types WHERE kind = 'Annotation')) UNION ALL
          SELECT DISTINCT parent_name || '.' || short_name, kind, parent_name, file_path, CASE WHEN language <> 'kotlin' THEN mods WHEN kind = 'Field' THEN CASE mods WHEN 'private' THEN 'private,val' ELSE 'val' END ELSE replace(mods, 'static', '') END, params, return_type
            FROM (SELECT * FROM members WHERE parent_name IN (SELECT fqn FROM types WHERE kind = 'Annotation'))""",
        "parse_corpus_supers": "SELECT symbol_fqn, super_short_name, super_fqn FROM supers WHERE super_fqn IS NOT NULL",
        "dia_parser_rules": """SELECT '/ws/faults/F' || k || CASE WHEN k % 10 = 9 THEN '.kt' ELSE '.java' END AS path,
            ['duplicate_import', 'unused_import', 'missing_return_statement', 'type_mismatch_assignment', 'unchecked_cast', 'incompatible_return_type', 'variable_used_before_assignment', 'syntax_error', 'duplicate_method_signature', 'null_safety_violation'][CAST(k % 10 + 1 AS INT)] AS code,
            CASE WHEN k % 10 IN (0, 1, 4) THEN 'warning' ELSE 'error' END AS severity FROM types""",
        "jar_pairing": """SELECT b.p AS byte_jar, s.p AS src_jar FROM (SELECT s_suppkey AS k, '/repo/lib-' || s_suppkey || '.jar' AS p FROM supplier WHERE s_suppkey % 2 = 0) b
          FULL JOIN (SELECT s_suppkey AS k, '/repo/lib-' || s_suppkey || '-sources.jar' AS p FROM supplier WHERE s_suppkey % 3 = 0) s ON b.k = s.k""",
        "jar_name_filter": """SELECT CASE WHEN s_suppkey % 7 <> 6 THEN '/repo/lib-' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.jar' ELSE '-sources.jar' END END AS path, s_suppkey AS s FROM supplier WHERE s_suppkey % 7 = 6 OR s_suppkey % 5 IN (0, 4)""",
        "line_entry_guard": "SELECT doc_id FROM documents WHERE length(text) - length(replace(text, chr(10), '')) <= 5",
        "type_ref_parse": "SELECT fqn, CASE k % 3 WHEN 0 THEN short_name WHEN 1 THEN 'Map' ELSE 'Set' END AS base, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN short_name || '|List<T' || (k % 4) || '>' ELSE short_name END AS args FROM types",
        "type_substitution": "SELECT fqn, CASE WHEN k % 2 = 0 THEN 'Map<' || short_name || ', List<int>>' ELSE 'int' END AS resolved FROM types",
        "param_type_normalise": "SELECT fqn, CASE k % 5 WHEN 0 THEN 'List' WHEN 1 THEN short_name || '[]' WHEN 3 THEN short_name || '[][]' ELSE 'int' END AS name FROM types",
        "descriptor_parse": "SELECT fqn, ['', 'int', 'byte[],int,int', 'java.lang.String,long[][]'][CAST(k % 4 + 1 AS INT)] AS params, ['void', 'boolean', 'java.util.List[]'][CAST(k % 3 + 1 AS INT)] AS result FROM types",
        "signature_parse": "SELECT fqn, ['', 'T', 'K,V'][CAST(k % 3 + 1 AS INT)] AS formals, ['T', 'Map<K, List<?>>'][CAST(k % 2 + 1 AS INT)] AS params, 'Entry<K, V>' AS result FROM types",
        "stream_ttl_eviction": "SELECT user_id AS uri, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE",
        "stream_diagnostics": """SELECT '/ws/open/U' || user_id || '.java' AS path, ['duplicate_import', 'unused_import', 'missing_return_statement', 'type_mismatch_assignment'][CAST(v % 5 + 1 AS INT)] AS code,
            CASE WHEN v % 5 < 2 THEN 'warning' ELSE 'error' END AS severity FROM (SELECT user_id, max(event_id) AS v, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id) WHERE kind <> 'error' AND v % 5 < 4""",
        "stream_debounce_upsert": "SELECT uri, max(version) AS version, arg_max(kind, version) AS kind FROM changes WHERE kind IN ('open', 'change') GROUP BY uri",
    }.items()
}

ORACLES |= {
    name: with_ctes(body)
    for name, body in {
        "valid_identifier": "SELECT fqn, CASE k % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 5 THEN language <> 'kotlin' WHEN 6 THEN language <> 'groovy' ELSE false END AS ok FROM types",
        "cursor_words": """SELECT fqn, CASE WHEN k % 5 = 4 THEN '' ELSE short_name END AS receiver, left(word, length(word) - k % 3) AS prefix
          FROM types, LATERAL (SELECT CASE WHEN k % 5 = 4 THEN 'x' || short_name ELSE 'call' || k END AS word)""",
        "strip_comment_markers": "SELECT fqn, CASE k % 3 WHEN 0 THEN 'About ' || short_name || '.' || chr(10) || chr(10) || 'More ' || k || '.' WHEN 1 THEN short_name ELSE short_name || chr(10) || k END AS doc FROM types",
        "occurrences_with_dollar": "SELECT k AS id, 1 AS line, 1 AS n FROM types UNION ALL SELECT k, 2, 2 FROM types UNION ALL SELECT k, 3, CAST(k % 4 AS INT) FROM types WHERE k % 4 > 0",
        "byte_offset_of_position": "SELECT fqn, 3 + length(short_name) + 5 + CASE WHEN k % 7 = 0 THEN length(fqn) ELSE k % 5 END AS offset FROM types",
        "qualifier_normalised": "SELECT fqn, short_name || '#next#last' || CASE WHEN k % 5 = 0 THEN '(open' ELSE '' END AS qualifier FROM types",
        "hits_outside_spans": """SELECT r.file_path, r.line, r.col, r.name FROM type_refs r JOIN types t ON t.file_path = r.file_path
          WHERE NOT (r.line * 1000 + r.col BETWEEN (t.k % 100) * 10000 + 8 AND ((t.k % 100) * 10 + 99) * 1000 + 20)""",
        "workspace_files_with_buffers": """SELECT '/build/ws/m' || (k % 3) || '/' || CASE k % 5 WHEN 0 THEN 'src' ELSE 'outer' END || '/' || short_name || '.' || ['java', 'groovy', 'kt'][CAST(k % 4 + 1 AS INT)] AS path,
            ['java', 'groovy', 'kotlin'][CAST(k % 4 + 1 AS INT)] AS language, CASE WHEN k % 7 = 0 OR k % 3 = 0 THEN 'open' ELSE 'disk' END AS text FROM types WHERE k % 4 <> 3 AND k % 5 IN (0, 3)""",
        "jar_choice": """SELECT coalesce(b.p, s.p) AS jar_path, CASE WHEN b.p IS NOT NULL THEN s.p END AS alt_jar_path FROM (SELECT s_suppkey AS k, '/repo/lib-' || s_suppkey || '.jar' AS p FROM supplier WHERE s_suppkey % 2 = 0) b
          FULL JOIN (SELECT s_suppkey AS k, '/repo/lib-' || s_suppkey || '-sources.jar' AS p FROM supplier WHERE s_suppkey % 3 = 0) s ON b.k = s.k""",
        "classpath_of_files": "SELECT file_path, CASE WHEN k % 7 < 5 THEN '/repo/a' || (k % 7) || '.jar,/repo/b.jar' ELSE '' END AS jars FROM types",
        "build_file_predicate": "SELECT fqn, k % 7 < 4 AS ok FROM types",
        "changed_files_between_revisions": "SELECT '/ws/src/' || short_name || '.' || ['java', 'groovy', 'kt'][CAST(k % 4 + 1 AS INT)] AS path FROM types WHERE k % 10 BETWEEN 3 AND 6 AND k % 4 <> 3",
        "source_positions_of_classes": """SELECT fqn, jar_path, 'lib-sources.jar' AS alt_jar_path, place AS ident_line_start, place AS ident_line_end, CASE WHEN found THEN 13 ELSE 0 END AS ident_char_start,
            CASE WHEN found THEN CAST(length(short_name) AS INT) + 13 ELSE 0 END AS ident_char_end FROM ext_types, LATERAL (SELECT s % 3 <> 0 AS found, CASE WHEN s % 3 <> 0 THEN CAST(s AS INT) ELSE 0 END AS place) WHERE needs_decompilation""",
        "jar_scan_symbols": """SELECT '/repo/lib-' || s || '.jar' AS jar_path, CASE WHEN bytes AND s % 2 = 0 THEN '/repo/lib-' || s || '-sources.jar' END AS alt_jar_path, v.fqn, v.parent_name, v.kind, v.mods, bytes AS needs_decompilation, v.params, v.return_type, v.formals, v.generic_return
          FROM (SELECT s, fqn AS lib, package_name AS pkg, package_name || '.Src' || s AS src FROM libs), LATERAL (VALUES
            (true, lib, pkg, CASE WHEN s % 3 = 2 THEN 'Interface' ELSE 'Class' END, CASE s % 3 WHEN 0 THEN 'public,final' WHEN 1 THEN 'public,abstract' ELSE 'public' END, NULL, NULL, NULL, NULL),
            (true, lib || '#NAME', lib, 'Field', 'public,static', NULL, 'java.lang.String', NULL, NULL),
            (true, lib || '#m' || (s % 5), lib, 'Function', 'public', 'java.lang.String,long[]', 'int', NULL, NULL),
            (true, lib || '#same', lib, 'Function', 'protected,abstract', 'java.lang.Object', 'java.lang.Object', 'T', 'T'),
            (false, src, pkg, 'Class', '', NULL, NULL, NULL, NULL),
            (false, src || '#label', src, 'Function', '', 'int', 'String', NULL, NULL)) v(bytes, fqn, parent_name, kind, mods, params, return_type, formals, generic_return)
          WHERE NOT bytes OR s % 4 <> 3""",
        "jar_scan_edges": "SELECT '/repo/lib-' || s || '.jar' AS jar_path, fqn AS symbol_fqn, 'Face' || (s % 3) AS super_short_name, 'ext.Face' || (s % 3) AS super_fqn FROM libs WHERE s % 4 <> 3",
        "jar_scan_errors": "SELECT '/repo/lib-' || s || '.jar' AS jar_path, 'Broken.class' AS entry, 'ValueError: not a class file' AS error, 0 AS n FROM libs WHERE s % 6 = 0",
        "parse_documented_symbols": """SELECT '/ws/small/' || short_name || '.java' AS file_path, fqn || v.tail AS fqn, CASE v.doc WHEN 'type' THEN 'About ' || short_name || '.' ELSE v.doc END AS doc, v.annotations, v.line AS ident_line_start, v.col AS ident_char_start,
            CAST(v.col + CASE v.tail WHEN '' THEN length(short_name) ELSE length(v.tail) - 1 END AS INT) AS ident_char_end
          FROM types, (VALUES ('', 'type', 'Deprecated', 4, 6), ('#size', 'Counts.', 'Override', 7, 15), ('#size', NULL, '', 8, 8), ('#run', NULL, '', 9, 8)) v(tail, doc, annotations, line, col)""",
        "references_by_index": """SELECT v.name, '/ws/refs/' || t.short_name || '.java' AS file_path, CAST(v.line AS INT) AS line, CAST(v.col AS INT) AS col, v.kind FROM types t JOIN types o ON o.k = t.k // 2,
          LATERAL (VALUES (t.short_name, 2, 6, 'code'), (o.short_name, 2, 15 + length(t.short_name), 'code'), (o.short_name, 3, 16, 'string'), (o.short_name, 4, 6 + length(o.short_name), 'code')) v(name, line, col, kind)""",
        "symbol_at_position": """SELECT p AS file_path, v.line, v.col, CASE v.name WHEN '' THEN short_name ELSE v.name END AS name, v.origin, CASE v.origin WHEN 'local' THEN p || v.tail ELSE fqn || v.tail END AS target
          FROM (SELECT *, '/ws/small/' || short_name || '.java' AS p FROM types), LATERAL (VALUES
            (12, 15, 'other', 'local', ':9:8'), (12, 21, 'size', 'project', '#size'), (12, 26, 'n', 'local', ':10:12'), (11, 8, '', 'project', '')) v(line, col, name, origin, tail)""",
    }.items()
}
