"""Interval, cascade, candidate and flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, logs as lg
from ..plans import flows, resolve
from .registry import query

_FNS, _ALL = "'function', 'class'", "'function', 'class', 'type', 'constant'"


def _inner(kinds: str) -> str:
    return f"""SELECT o.occ_order, o.occ_line, o.file_id, o.line, o.target, p.sym_id FROM {{occurrences}} o JOIN
    (SELECT q.file_id, q.line, arg_min(s.sym_id, (s.end_line - s.start_line, s.start_line, s.sym_id)) AS sym_id FROM (SELECT DISTINCT file_id, line FROM {{occurrences}}) q
    LEFT JOIN {{symbols}} s ON s.file_id = q.file_id AND q.line BETWEEN s.start_line AND s.end_line AND s.kind IN ({kinds}) GROUP BY ALL) p USING (file_id, line)"""


@query("innermost_function", f"SELECT occ_order, occ_line, file_id, line, sym_id FROM ({_inner(_FNS)})")
def innermost_function(t):
    spans = t.symbols.filter("kind in ('function', 'class')")
    out = joins.innermost(t.occurrences, spans, ["file_id"], "line", "start_line", "end_line", "sym_id")
    return out.select("occ_order", "occ_line", "file_id", "line", "sym_id")


@query("attach_diagnostics", f"SELECT sym_id, count(*) AS errors, min(line) AS first_line FROM ({_inner(_ALL)}) WHERE occ_line = 1 AND sym_id IS NOT NULL GROUP BY sym_id")
def attach_diagnostics(t):
    """Occurrences of the first line of an order stand for diagnostics that are errors."""
    d = t.occurrences.filter("occ_line = 1")
    out = joins.innermost(d, t.symbols, ["file_id"], "line", "start_line", "end_line", "sym_id")
    return out.filter("sym_id is not null").groupBy("sym_id").agg(F.count("*").alias("errors"), F.min("line").alias("first_line"))


_DERIVED = f"""SELECT DISTINCT i.sym_id AS caller, i.target AS callee, i.line FROM ({_inner("'function'")}) i
    JOIN {{symbols}} c ON c.sym_id = i.target AND c.kind IN ('function', 'class') WHERE i.sym_id IS NOT NULL AND i.sym_id <> i.target"""


@query("derive_calls", _DERIVED)
def derive_calls(t):
    return flows.derive_calls(t.occurrences, t.symbols)


@query("collapse_calls", f"SELECT caller, callee, max(line) AS line FROM ({_DERIVED}) GROUP BY caller, callee")
def collapse_calls(t):
    return flows.collapse_calls(flows.derive_calls(t.occurrences, t.symbols), "line")


@query("collapse_imports", """SELECT l_suppkey AS src, l_partkey % 50 AS dst, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS statement FROM lineitem GROUP BY ALL""")
def collapse_imports(t):
    from ..storage import last_by

    li = t.raw("lineitem").selectExpr("l_suppkey AS src", "l_partkey % 50 AS dst", "l_orderkey AS statement", "l_shipdate", "l_linenumber", "l_partkey")
    return last_by(li, ["src", "dst"], F.col("l_shipdate"), F.col("statement"), F.col("l_linenumber"), F.col("l_partkey")).select("src", "dst", "statement")


@query("cascade_match", """WITH l AS (SELECT sym_id, file_path || '::' || name || '#' || (sym_id % 3) AS a, file_path || '::' || kind || '.' || name AS b, file_path || '::' || name AS c FROM {symbols}),
    r AS (SELECT CASE sym_id % 3 WHEN 0 THEN file_path || '::' || name || '#0' WHEN 1 THEN file_path || '::' || kind || '.' || name ELSE file_path || '::' || name END AS k, sym_id AS target FROM {symbols} WHERE sym_id % 5 <> 0),
    m AS (SELECT l.sym_id, 1 AS priority, target FROM l JOIN r ON k = a UNION ALL SELECT l.sym_id, 2, target FROM l JOIN r ON k = b UNION ALL SELECT l.sym_id, 3, target FROM l JOIN r ON k = c)
    SELECT sym_id, arg_min(target, (priority, target)) AS target, CAST(min(priority) AS INTEGER) AS priority FROM m GROUP BY sym_id""")
def cascade_match(t):
    base = F.concat("file_path", F.lit("::"), "name")
    contained = F.concat("file_path", F.lit("::"), "kind", F.lit("."), "name")
    key = F.when(F.col("sym_id") % 3 == 0, F.concat(base, F.lit("#0"))).when(F.col("sym_id") % 3 == 1, contained).otherwise(base)
    right = t.symbols.filter("sym_id % 5 <> 0").select(key.alias("k"), F.col("sym_id").alias("target"))
    return joins.cascade(t.symbols, right, "sym_id", [F.concat(base, F.lit("#"), F.col("sym_id") % 3), contained, base], "k", "target")


def _imports(t):
    """An import of each symbol's file: relative, aliased, scoped, plain or dangling, told by its id."""
    i = F.col("sym_id") % 6
    f = F.col("file_id")
    source = (
        F.when(i == 0, F.concat(F.lit("./f"), f)).when(i == 1, F.concat(F.lit("../src/f"), f, F.lit(".js"))).when(i == 2, F.concat(F.lit("@/f"), f))
        .when(i == 3, F.lit("@scope/pkg/deep")).when(i == 4, F.concat(F.lit("./missing"), f)).otherwise(F.lit("lodash/fp"))
    )
    return t.spread(t.symbols, "sym_id", "part").select(F.col("sym_id").alias("import_id"), F.concat(F.lit("src/m"), f, F.lit(".ts")).alias("from_file"), source.alias("source"))


def _resolved(t):
    return resolve.resolve_imports(_imports(t), t.symbols.select("file_path").distinct(), {"@/*": "src/*"})


_RESOLVED = """SELECT sym_id AS import_id, CASE WHEN sym_id % 6 < 3 THEN file_path END AS resolved_path,
    CAST(CASE sym_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 1 END AS INTEGER) AS probe, CASE sym_id % 6 WHEN 3 THEN '@scope/pkg' WHEN 5 THEN 'lodash' END AS package,
    CASE WHEN sym_id % 6 < 3 THEN 'resolved' WHEN sym_id % 6 = 4 THEN 'unresolvable' ELSE 'external' END AS resolution_status FROM {symbols}"""


@query("resolve_candidates", _RESOLVED)
def resolve_candidates(t):
    return _resolved(t).select("import_id", "resolved_path", "probe", "package", "resolution_status")


_BARRELS = """WITH RECURSIVE own AS (SELECT DISTINCT file_id, name FROM {symbols}),
    star AS (SELECT src, min(dst) AS nxt FROM {imports} GROUP BY src),
    w AS (SELECT sym_id AS import_id, file_id % (SELECT count(*) FROM supplier) AS file, name, 0 AS hops, []::BIGINT[] AS seen FROM {symbols} WHERE kind = 'function'
    UNION ALL SELECT import_id, nxt, w.name, hops + 1, list_append(seen, file) FROM w JOIN star ON src = file WHERE hops < 10 AND NOT list_contains(seen, file)
    AND NOT EXISTS (SELECT 1 FROM own WHERE own.file_id = file AND own.name = w.name)),
    e AS (SELECT w.*, EXISTS (SELECT 1 FROM own WHERE own.file_id = file AND own.name = w.name) AS f, list_contains(seen, file) AS cyc, (SELECT nxt FROM star WHERE src = file) AS nxt FROM w)
    SELECT import_id, name, file, CAST(hops AS INTEGER) AS hops, CASE WHEN f THEN 'found' WHEN cyc THEN 'cycle' WHEN nxt IS NULL THEN 'missing' ELSE 'too deep' END AS outcome
    FROM e WHERE f OR cyc OR nxt IS NULL OR hops = 10"""


@query("barrel_unwind", _BARRELS)
def barrel_unwind(t):
    """Import edges stand for wildcard re-exports, in order of their target."""
    ns = t._count("supplier")
    text = lambda c: F.col(c).cast("string")
    wanted = t.symbols.filter("kind = 'function'").select(F.col("sym_id").alias("import_id"), (F.col("file_id") % ns).cast("string").alias("file"), "name")
    re = t.imports.select(text("src").alias("file"), F.col("dst").alias("nth"), F.lit(None).cast("string").alias("name"), text("dst").alias("target"))
    own = t.symbols.select(text("file_id").alias("file"), "name")
    return resolve.unwind_barrels(wanted, re, own).withColumn("file", F.col("file").cast("bigint"))


_SYMBOLS = """WITH x AS (SELECT sym_id AS import_id, file_path AS target, name, 'named' AS import_kind FROM {symbols} UNION ALL SELECT sym_id, file_path, 'zz' || name, 'named' FROM {symbols}
    UNION ALL SELECT sym_id, file_path, 'dflt', 'default' FROM {symbols} WHERE sym_id % 2 = 0 UNION ALL SELECT sym_id, file_path, 'ns', 'namespace' FROM {symbols} WHERE sym_id % 3 = 0)
    SELECT import_id, name, target, import_kind, CASE import_kind WHEN 'named' THEN (target, name) IN (SELECT (file_path, name) FROM {symbols} WHERE kind <> 'type')
    WHEN 'default' THEN target IN (SELECT file_path FROM {symbols} WHERE kind = 'class') ELSE true END AS resolved FROM x"""


@query("resolve_symbols", _SYMBOLS)
def resolve_symbols(t):
    imports = t.symbols.select(
        F.col("sym_id").alias("import_id"), F.col("file_path").alias("target"), F.array("name", F.concat(F.lit("zz"), "name")).alias("names"),
        F.when(F.col("sym_id") % 2 == 0, "dflt").alias("default_name"), F.when(F.col("sym_id") % 3 == 0, "ns").alias("namespace"),
    )
    exports = t.symbols.filter("kind <> 'type'").select("file_path", "name", (F.col("kind") == "class").alias("is_default"))
    return resolve.resolve_symbols(imports, exports, t.symbols)


@query("resolution_stats", f"""SELECT i.*, (SELECT count(*) FROM ({_SYMBOLS}) WHERE NOT resolved) AS unresolved_symbols, (SELECT count(*) FROM ({_BARRELS}) WHERE outcome = 'cycle') AS barrel_cycles,
    (SELECT count(*) FROM ({_BARRELS}) WHERE outcome = 'too deep') AS barrel_depth_exceeded
    FROM (SELECT count(*) AS total, count(*) FILTER (WHERE resolution_status = 'resolved') AS resolved, count(*) FILTER (WHERE resolution_status = 'external') AS "external", count(*) FILTER (WHERE resolution_status = 'unresolvable') AS unresolvable,
    count(*) FILTER (WHERE resolution_status = 'dynamic') AS dynamic, count(*) FILTER (WHERE probe > 0) AS by_probe, count(DISTINCT package) AS packages
    FROM ({_RESOLVED} UNION ALL SELECT sym_id, NULL, NULL, NULL, 'dynamic' FROM {{symbols}} WHERE sym_id % 13 = 0)) i""")
def resolution_stats(t):
    """All counters of a run; imports without a source are dynamic."""
    dynamic = _imports(t).filter("import_id % 13 = 0").withColumn("source", F.lit(None).cast("string")).withColumn("import_id", -1 - F.col("import_id"))
    found = resolve.resolve_imports(_imports(t).unionByName(dynamic), t.symbols.select("file_path").distinct(), {"@/*": "src/*"})
    return resolve.resolution_stats(found, resolve_symbols(t), barrel_unwind(t))



@query("resolve_exports", "SELECT f.file_path, s.name, s.sym_id FROM (SELECT DISTINCT file_path, name FROM {symbols} WHERE kind = 'class') f JOIN {symbols} s ON s.file_path = f.file_path AND s.name = f.name")
def resolve_exports(t):
    wanted = t.symbols.filter("kind = 'class'").select("file_path", "name").distinct()
    return wanted.join(t.symbols.select("file_path", "name", "sym_id"), ["file_path", "name"])


def _side(x: str) -> str:
    return f"""{x} AS (SELECT f.finding_id, arg_min(s.sym_id, (s.end_line - s.start_line, s.start_line, s.sym_id)) AS fn FROM {{findings}} f LEFT JOIN {{symbols}} s
        ON s.kind = 'function' AND s.file_id = f.{x}_file AND f.{x}_line BETWEEN s.start_line AND s.end_line GROUP BY f.finding_id)"""


_MATCHED = f"""WITH {_side('source')}, {_side('sink')}, m AS (SELECT f.finding_id, f.query_id, f.severity, a.fn AS source_fn, b.fn AS sink_fn,
    CASE WHEN a.fn IS NOT NULL AND b.fn IS NOT NULL THEN 'complete' WHEN a.fn IS NULL AND b.fn IS NULL THEN 'none' ELSE 'partial' END AS match
    FROM {{findings}} f JOIN source a USING (finding_id) JOIN sink b USING (finding_id)),
    e AS (SELECT source_fn, sink_fn, query_id, max(finding_id) AS finding_id, arg_max(severity, finding_id) AS severity FROM m WHERE match = 'complete' GROUP BY ALL)"""


@query("match_findings", f"{_MATCHED} SELECT finding_id, source_fn, sink_fn, match FROM m")
def match_findings(t):
    return flows.match_findings(t.findings, t.symbols).select("finding_id", "source_fn", "sink_fn", "match")


def _flows(t):
    return flows.flow_edges(flows.match_findings(t.findings, t.symbols))


@query("flow_edges", f"{_MATCHED} SELECT source_fn, sink_fn, query_id, finding_id, severity FROM e")
def flow_edges(t):
    return _flows(t)


@query("data_flow_both", f"""{_MATCHED}, s AS (SELECT sym_id AS fn FROM {{symbols}} WHERE kind = 'function' AND start_line <= 20)
    SELECT * FROM (SELECT 'down' AS direction, source_fn AS fn, sink_fn AS other, query_id FROM e WHERE source_fn IN (SELECT fn FROM s) ORDER BY fn, other, query_id LIMIT 25)
    UNION ALL SELECT * FROM (SELECT 'up', sink_fn AS fn, source_fn AS other, query_id FROM e WHERE sink_fn IN (SELECT fn FROM s) ORDER BY fn, other, query_id LIMIT 25)""")
def data_flow_both(t):
    return flows.trace(_flows(t), t.symbols.filter("kind = 'function' and start_line <= 20").select(F.col("sym_id").alias("fn")))


@query("findings_list", "SELECT finding_id, query_id, severity FROM {findings} ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, query_id, finding_id LIMIT 50")
def findings_list(t):
    return flows.listed(t.findings).select("finding_id", "query_id", "severity")


@query("findings_by_query", "SELECT query_id, severity, count(*) AS n FROM {findings} GROUP BY ALL")
def findings_by_query(t):
    return t.findings.groupBy("query_id", "severity").agg(F.count("*").alias("n"))


@query("dedupe_findings", "SELECT query_id, source_file, min(finding_id) AS finding_id FROM {findings} GROUP BY ALL")
def dedupe_findings(t):
    return flows.dedupe_findings(t.findings, "query_id", "source_file").select("query_id", "source_file", "finding_id")


@query("arity_mismatch", """SELECT c.src AS caller, c.dst AS callee, 'expected ' || (s.sym_id % 4) || ' arguments, got ' || (c.src % 4) AS detail FROM {calls} c JOIN {symbols} s ON s.sym_id = c.dst WHERE c.src % 4 <> s.sym_id % 4""")
def arity_mismatch(t):
    many = lambda c: F.array_repeat(F.lit("x"), (F.col(c) % 4).cast("int"))
    calls = t.calls.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), many("src").alias("arg_expressions"))
    found = flows.arity_mismatch(calls, t.symbols.select("sym_id", many("sym_id").alias("param_types")))
    return found.filter("has_type_mismatch").select("caller", "callee", F.col("type_mismatch_detail").alias("detail"))


@query("nearby_logs", """SELECT a.id AS anchor, b.id, CAST(epoch_us(b.ts) - epoch_us(a.ts) AS BIGINT) AS gap_us FROM {logs} a JOIN {logs} b ON a.repo_id = b.repo_id AND a.id <> b.id
    AND b.ts BETWEEN a.ts - INTERVAL 60 SECONDS AND a.ts + INTERVAL 60 SECONDS WHERE a.level = 'error'""")
def nearby_logs(t):
    return lg.nearby(t.logs, t.logs.filter("level = 'error'"))


@query("trace_error_callers", """WITH top AS (SELECT event_id AS id, user_id % (SELECT count(*) FROM customer) AS fn FROM events WHERE event_type = 'error')
    SELECT top.id, fn, count(c.src) AS callers FROM top LEFT JOIN {calls} c ON c.dst = fn GROUP BY ALL""")
def trace_error_callers(t):
    """Callers are counted once for each function, and then joined to the errors."""
    nc = t._count("customer")
    top = t.raw("events").filter("event_type = 'error'").selectExpr("event_id AS id", f"user_id % {nc} AS fn")
    c = t.calls.groupBy(F.col("dst").alias("fn")).agg(F.count("*").alias("callers"))
    return top.join(c, "fn", "left").select("id", "fn", F.coalesce("callers", F.lit(0)).alias("callers"))


@query("tenant_filter", "SELECT file_path FROM {files} WHERE repo_id IN (SELECT repo_id FROM {repositories} WHERE repo_id % 2 = 0)")
def tenant_filter(t):
    owned = t.repositories.filter("repo_id % 2 = 0").select("repo_id")
    return t.files.join(owned, "repo_id", "left_semi").select("file_path")
