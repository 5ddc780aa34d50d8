"""Graph queries: neighbours, paths, closures, lookups over the call and import graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import graph as g
from ..plans import lookup
from .registry import query

_START = "start AS (SELECT src AS id FROM {thin_calls} GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_ISTART = "start AS (SELECT src AS id FROM {imports} GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"

_PSTART = _ISTART.replace("{imports}", "{thin_imports}")


def _walk(edges: str, start: str, depth: int, a: str = "src", b: str = "dst") -> str:
    return f"""WITH RECURSIVE {start}, e AS (SELECT {a} AS a, {b} AS b FROM {{{edges}}}),
        p AS (SELECT 1 AS depth, [a, b] AS nodes, [a || '>' || b] AS rels, b AS last FROM e WHERE a = (SELECT id FROM start)
        UNION ALL SELECT depth + 1, list_append(nodes, b), list_append(rels, a || '>' || b), b FROM p JOIN e ON a = last
        WHERE depth < {depth} AND NOT list_contains(rels, a || '>' || b))"""


def _text(found):
    return found.select("depth", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), "back_edge")


_PATH = "SELECT depth, array_to_string(nodes, '>') AS path, list_contains(nodes[1:len(nodes)-1], last) AS back_edge FROM p"


@query("call_paths_down", f"{_walk('thin_calls', _START, 6)} {_PATH}")
def call_paths_down(t):
    return _text(g.paths(t.thin_calls, g.busiest(t.thin_calls), 6))


@query("call_paths_up", f"{_walk('thin_calls', _START, 5, 'dst', 'src')} {_PATH}")
def call_paths_up(t):
    return _text(g.paths(t.thin_calls, g.busiest(t.thin_calls), 5, up=True))


@query("import_paths", f"{_walk('thin_imports', _PSTART, 3)} SELECT * FROM ({_PATH}) ORDER BY depth, path LIMIT 50")
def import_paths(t):
    return _text(g.paths(t.thin_imports, g.busiest(t.thin_imports), 3)).orderBy("depth", "path").limit(50)


@query("call_paths", f"""{_walk('thin_calls', _START, 3)}, n AS (SELECT depth, nodes, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS i FROM p)
    SELECT depth, string_agg(f.name || '@' || f.file, ' > ' ORDER BY i) AS path FROM n JOIN {{functions}} f USING (id) GROUP BY depth, nodes""")
def call_paths(t):
    """Paths as lists of named nodes: the names are joined once to the exploded nodes and gathered in order."""
    found = g.paths(t.thin_calls, g.busiest(t.thin_calls), 3).withColumn("p", F.monotonically_increasing_id())
    steps = found.select("p", "depth", F.posexplode("nodes").alias("i", "id"))
    named = steps.join(t.functions, "id").groupBy("p", "depth").agg(F.array_sort(F.collect_list(F.struct("i", F.concat("name", F.lit("@"), "file").alias("n")))).alias("s"))
    return named.select("depth", F.array_join(F.transform("s", lambda x: x["n"]), " > ").alias("path"))


@query("call_tree_edges", f"""{_walk('thin_calls', _START, 6)} SELECT nodes[-2] AS src, nodes[-1] AS dst, CAST(min(depth) AS INTEGER) AS depth FROM p GROUP BY ALL""")
def call_tree_edges(t):
    return g.tree(t.thin_calls, g.busiest(t.thin_calls), 6)


@query("call_tree_stats", f"""{_walk('thin_calls', _START, 6)}, tree AS (SELECT nodes[-2] AS src, nodes[-1] AS dst, min(depth) AS depth FROM p GROUP BY ALL),
    nodes AS (SELECT id FROM start UNION SELECT dst FROM tree)
    SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM tree)) AS n_leaves, count(*) AS n_edges,
    count(*) FILTER (WHERE a.file <> b.file) AS n_cross_file, CAST(max(depth) AS INTEGER) AS max_depth
    FROM tree JOIN {{functions}} a ON a.id = src JOIN {{functions}} b ON b.id = dst""")
def call_tree_stats(t):
    start = g.busiest(t.thin_calls)
    return g.tree_stats(g.tree(t.thin_calls, start, 6), start, t.functions)


def _reach(a: str, b: str, name: str) -> str:
    return f"{name} AS (SELECT id FROM start UNION SELECT {b} FROM {name} JOIN {{imports}} ON {a} = id)"


@query("graph_totals", f"""WITH RECURSIVE {_ISTART}, {_reach('src', 'dst', 'down')}
    SELECT count(*) AS n_nodes, CAST((SELECT count(*) FROM {{imports}} WHERE src IN (SELECT id FROM down)) AS BIGINT) AS n_edges FROM down""")
def graph_totals(t):
    return g.totals(t.imports, g.busiest(t.imports))


_CLOSURE = f"""WITH RECURSIVE {_ISTART}, {_reach('src', 'dst', 'down')}, {_reach('dst', 'src', 'up')},
    sides AS (SELECT id, CASE WHEN id = (SELECT id FROM start) THEN 'self' WHEN id IN (SELECT id FROM up) AND id IN (SELECT id FROM down) THEN 'both'
    WHEN id IN (SELECT id FROM up) THEN 'up' ELSE 'down' END AS side FROM (SELECT id FROM down UNION SELECT id FROM up))"""


@query("closure", f"{_CLOSURE} SELECT id, side FROM sides")
def closure(t):
    return g.closure(t.imports, g.busiest(t.imports))


@query("induced_subgraph", f"{_CLOSURE} SELECT src, dst FROM {{imports}} WHERE src IN (SELECT id FROM sides WHERE side <> 'down') AND dst IN (SELECT id FROM sides WHERE side <> 'down')")
def induced_subgraph(t):
    return g.induced(t.imports, g.closure(t.imports, g.busiest(t.imports)).filter("side <> 'down'"))


@query("neighbors", """WITH a AS (SELECT src AS node, dst AS neighbour FROM {imports} UNION SELECT dst, src FROM {imports}) SELECT node, neighbour, count(*) OVER (PARTITION BY node) AS n FROM a""")
def neighbors(t):
    return lookup.dependencies(g.adjacency(t.imports, 2 * t.parts), "node", "neighbour", 2 * t.parts)


@query("deps_out", "SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM {imports}")
def deps_out(t):
    return lookup.dependencies(t.imports, "src", "dst", t.parts)


@query("deps_in", "SELECT dst, src, count(*) OVER (PARTITION BY dst) AS n FROM {imports}")
def deps_in(t):
    return lookup.dependencies(t.imports, "dst", "src", t.parts)


@query("direct_importers", """SELECT s.file_path, s.name, count(DISTINCT i.src) AS importers FROM {symbols} s JOIN {imports} i ON i.dst = s.file_id GROUP BY s.file_path, s.name""")
def direct_importers(t):
    return lookup.direct_importers(t.symbols, t.imports)


@query("direct_imports", """SELECT 'up' AS direction, i.src AS file_id, s.sym_id FROM {imports} i JOIN {symbols} s ON s.file_id = i.dst AND s.kind = 'function'
    UNION ALL SELECT DISTINCT 'down', s.file_id, i.src FROM {symbols} s JOIN {imports} i ON i.dst = s.file_id WHERE s.kind = 'function'""")
def direct_imports(t):
    return lookup.direct_imports(t.symbols.filter("kind = 'function'"), t.imports)


_CALLS = "SELECT a.file AS from_file, b.file AS to_file, c.src, c.dst FROM {calls} c JOIN {functions} a ON a.id = c.src JOIN {functions} b ON b.id = c.dst WHERE a.file <> b.file"


@query("file_calls_out", f"SELECT from_file AS file, to_file, count(*) AS n_calls, count(DISTINCT dst) AS n_callees FROM ({_CALLS}) GROUP BY ALL")
def file_calls_out(t):
    return lookup.calls_between(t.calls, t.functions).groupBy(F.col("from_file").alias("file"), "to_file").agg(F.count("*").alias("n_calls"), F.count_distinct("dst").alias("n_callees"))


@query("file_calls_in", f"SELECT to_file AS file, from_file, count(*) AS n_calls, count(DISTINCT src) AS n_callers FROM ({_CALLS}) GROUP BY ALL")
def file_calls_in(t):
    return lookup.calls_between(t.calls, t.functions).groupBy(F.col("to_file").alias("file"), "from_file").agg(F.count("*").alias("n_calls"), F.count_distinct("src").alias("n_callers"))


@query("symbol_lookup", """WITH c AS (SELECT dst, count(DISTINCT src) AS n, count(DISTINCT file) AS files
    FROM {calls} JOIN {functions} ON id = src GROUP BY dst), i AS (SELECT dst, count(DISTINCT src) AS n FROM {imports} GROUP BY dst)
    SELECT s.name, s.sym_id, s.kind, s.file_path, coalesce(c.n, 0) AS callers, coalesce(c.files, 0) AS caller_files, coalesce(i.n, 0) AS importers
    FROM {symbols} s LEFT JOIN c ON c.dst = s.sym_id LEFT JOIN i ON i.dst = s.file_id""")
def symbol_lookup(t):
    return lookup.usages(t.symbols, t.calls, t.functions, t.imports, t.parts)


@query("symbol_callers", """SELECT sym_id, nth, caller, file FROM (SELECT c.dst AS sym_id, c.src AS caller, f.file, CAST(row_number() OVER (PARTITION BY c.dst ORDER BY f.file, c.src) AS INTEGER) AS nth
    FROM {calls} c JOIN {functions} f ON f.id = c.src WHERE c.dst IN (SELECT sym_id FROM {symbols})) WHERE nth BETWEEN 6 AND 15""")
def symbol_callers(t):
    """The second and third five callers of every symbol."""
    return lookup.callers(t.symbols, t.calls, t.functions, 5, 10, t.parts)


@query("fuzzy_symbol", """WITH w AS (SELECT unnest(['red_widget', 'WIDGET', 'no_such']) AS wanted),
    exact AS (SELECT wanted, sym_id, name, 'exact' AS how FROM w JOIN {symbols} ON name = wanted),
    fuzzy AS (SELECT wanted, sym_id, name, 'fuzzy' AS how FROM w JOIN {symbols} ON contains(lower(name), lower(wanted)) WHERE wanted NOT IN (SELECT wanted FROM exact)
    QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY name, sym_id) <= 10)
    SELECT * FROM exact UNION ALL SELECT * FROM fuzzy""")
def fuzzy_symbol(t):
    return lookup.symbols_by_name(t.symbols, ["red_widget", "WIDGET", "no_such"])


@query("symbol_source", """SELECT s.sym_id, CAST(len(l[s.start_line:s.end_line]) AS INTEGER) AS n_lines, sha256(array_to_string(l[s.start_line:s.end_line], chr(10))) AS source_sha
    FROM {symbols} s JOIN (SELECT doc_id, repo_id, string_split(content, chr(10)) AS l FROM {files}) f ON f.doc_id = s.file_id AND f.repo_id = s.repo_id""")
def symbol_source(t):
    out = lookup.with_source(t.symbols.withColumnRenamed("file_id", "doc_id"), t.files, ["repo_id", "doc_id"])
    return out.select("sym_id", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("source_sha"))


@query("type_info", """SELECT s.name, s.file_path, s.kind, s.signature, coalesce(c.n, 0) AS callers, coalesce(c.mismatches, 0) AS mismatches FROM {symbols} s
    LEFT JOIN (SELECT dst, count(DISTINCT src) AS n, count(*) FILTER (WHERE src % 3 <> dst % 4) AS mismatches FROM {calls} GROUP BY dst) c ON c.dst = s.sym_id
    WHERE s.kind IN ('function', 'class')""")
def type_info(t):
    calls = t.calls.withColumn("has_type_mismatch", F.col("src") % 3 != F.col("dst") % 4)
    return lookup.type_info(t.symbols, calls)


@query("exports_by_kind", """SELECT file_path AS package, kind, count(*) OVER (PARTITION BY file_path, kind) AS n, CAST(row_number() OVER (PARTITION BY file_path, kind ORDER BY name, sym_id) AS INTEGER) AS nth, name
    FROM {symbols} WHERE name IS NOT NULL""")
def exports_by_kind(t):
    return lookup.exports_by_kind(t.symbols.withColumnRenamed("file_path", "package").withColumnRenamed("sym_id", "id"))


@query("resolve_start", """WITH w AS (SELECT DISTINCT name, NULL AS file_path FROM {symbols} UNION ALL SELECT DISTINCT name, file_path FROM {symbols} UNION ALL SELECT 'no_such', NULL)
    SELECT w.name, w.file_path, count(s.sym_id) AS candidates, arg_min(s.sym_id, (s.file_path, s.start_line, s.sym_id)) AS sym_id,
    CASE WHEN count(s.sym_id) = 0 THEN 'missing' WHEN count(s.sym_id) > 1 AND w.file_path IS NULL THEN 'ambiguous' ELSE 'found' END AS status
    FROM w LEFT JOIN {symbols} s ON s.name = w.name AND (w.file_path IS NULL OR w.file_path = s.file_path) GROUP BY w.name, w.file_path""")
def resolve_start(t):
    s = t.symbols
    none = t.spark.createDataFrame([("no_such", None)], "name string, file_path string")
    wanted = s.select("name", F.lit(None).cast("string").alias("file_path")).distinct().unionByName(s.select("name", "file_path").distinct()).unionByName(none)
    return g.resolve_start(s, wanted)


@query("graph_nodes", """SELECT 'File' AS label, file_path AS key, string_split(file_path, '/')[-1] AS display FROM {files} WHERE repo_id = 1
    UNION ALL SELECT 'Symbol', file_path || '::' || sym_id, coalesce(name, string_split(file_path, '/')[-1]) FROM {symbols} WHERE repo_id = 1
    UNION ALL SELECT 'Repository', url, name FROM {repositories} WHERE repo_id = 1""")
def graph_nodes(t):
    return lookup.graph_nodes(t.repositories, t.files, t.symbols, 1)


@query("graph_edges", """WITH n AS (SELECT sym_id FROM {symbols} WHERE repo_id = 1) SELECT src, dst FROM {calls} WHERE src IN (SELECT sym_id FROM n) AND dst IN (SELECT sym_id FROM n)""")
def graph_edges(t):
    return g.induced(t.calls, t.symbols.filter("repo_id = 1").select(F.col("sym_id").alias("id")))


@query("flow_counts", """WITH o AS (SELECT source_file AS f, count(*) AS n FROM {findings} GROUP BY 1), i AS (SELECT sink_file AS f, count(*) AS n FROM {findings} GROUP BY 1)
    SELECT fl.doc_id AS file_id, coalesce(o.n, 0) AS flows_out, coalesce(i.n, 0) AS flows_in FROM {files} fl LEFT JOIN o ON o.f = doc_id LEFT JOIN i ON i.f = doc_id""")
def flow_counts(t):
    return lookup.flow_counts(t.files.select(F.col("doc_id").alias("file_id")), t.findings)
