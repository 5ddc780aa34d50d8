"""Readers of files and signatures over texts made of whole tables, appending, and questions in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.signatures import call_arguments, signature_info
from ..plans import adhoc
from ..sources import manifests, sarif
from ..storage import append, shared_dir
from .registry import query


@query("read_sarif", """SELECT 'q' || finding_id AS query_id, severity, 'src/f' || source_file || '.ts' AS source_file, CAST(source_line AS INTEGER) AS source_line, 'src/f' || CASE WHEN finding_id % 2 = 0 THEN sink_file ELSE source_file END || '.ts' AS sink_file,
    CAST(CASE WHEN finding_id % 2 = 0 THEN sink_line ELSE source_line END AS INTEGER) AS sink_line, CAST(CASE WHEN finding_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS steps, 'found ' || finding_id AS message FROM {findings}""")
def read_sarif(t):
    """Each finding as a log of its own: the even ones with a flow of two steps, a third with the level at the rule."""
    i = F.col("finding_id").cast("string")
    place = lambda file, line: F.concat(F.lit('{"physicalLocation":{"artifactLocation":{"uri":"src/f'), file, F.lit('.ts"},"region":{"startLine":'), line, F.lit("}}}"))
    source, sink = place(F.col("source_file"), F.col("source_line")), place(F.col("sink_file"), F.col("sink_line"))
    level = F.concat(F.lit('"level":"'), F.col("severity"), F.lit('"'))
    by_rule = F.col("finding_id") % 3 == 0
    flow = F.when(F.col("finding_id") % 2 == 0, F.concat(F.lit(',"codeFlows":[{"threadFlows":[{"locations":[{"location":'), source, F.lit('},{"location":'), sink, F.lit("}]}]}]"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"runs":[{"tool":{"driver":{"rules":[{"id":"q'), i, F.lit('"'), F.when(by_rule, F.concat(F.lit(',"defaultConfiguration":{'), level, F.lit("}"))).otherwise(F.lit("")), F.lit('}]}},"results":[{"ruleId":"q'), i,
        F.lit('",'), F.when(by_rule, F.lit("")).otherwise(F.concat(level, F.lit(","))), F.lit('"message":{"text":"found '), i, F.lit('"},"locations":['), source, F.lit("]"), flow, F.lit("}]}]}"),
    )
    logs = t.findings.select(F.from_json(text, sarif.SCHEMA).alias("x")).select("x.*")
    return sarif.findings(logs).select("query_id", "severity", "source_file", "source_line", "sink_file", "sink_line", F.size("path_steps").alias("steps"), "message")


@query("read_manifests", """SELECT DISTINCT 'pkg/' || replace(p_brand, '#', '') || CASE p_size % 2 WHEN 0 THEN '/package.json' ELSE '/requirements.txt' END AS file_path, 'lib' || p_partkey AS name,
    CASE p_size % 2 WHEN 0 THEN '^' || p_size || '.0.0' ELSE p_size || '.1' END AS version, CASE p_size % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS registry FROM part""")
def read_manifests(t):
    """A manifest of either kind for each brand, with its parts as packages."""
    p = t.raw("part").select(F.regexp_replace("p_brand", "#", "").alias("brand"), (F.col("p_size") % 2 == 0).alias("npm"), F.concat(F.lit("lib"), "p_partkey").alias("name"), F.col("p_size").cast("string").alias("v"))
    line = F.when(F.col("npm"), F.concat(F.lit('"'), "name", F.lit('": "^'), "v", F.lit('.0.0"'))).otherwise(F.concat("name", F.lit("=="), "v", F.lit(".1")))
    g = p.groupBy("brand", "npm").agg(F.collect_list(line).alias("lines"))
    content = F.when(F.col("npm"), F.concat(F.lit('{"name": "x", "dependencies": {'), F.array_join("lines", ", "), F.lit("}}"))).otherwise(F.array_join("lines", "\n"))
    files = g.select(F.concat(F.lit("pkg/"), "brand", F.when(F.col("npm"), "/package.json").otherwise("/requirements.txt")).alias("file_path"), content.alias("content"))
    return manifests.dependencies(files)


@query("signature_types", """SELECT p_partkey AS id, 'Map<string, T' || p_partkey || '>|number[]|(x: A, y: B) => C' AS params, 'Promise<R' || p_size || '>' AS returns, true AS generic, 'T' || p_partkey AS type_params,
    'a.b(1, 2)|{ x: [1, ' || p_size || '] }|"s, t"' AS arguments FROM part""")
def signature_types(t):
    """Nested types and arguments, with each part's own numbers in them."""
    i, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    s = F.concat(F.lit("function f<T"), i, F.lit(">(a: Map<string, T"), i, F.lit(">, b: number[], c: (x: A, y: B) => C): Promise<R"), n, F.lit(">"))
    line = F.concat(F.lit("  const y = await call"), i, F.lit("(a.b(1, 2), { x: [1, "), n, F.lit('] }, "s, t");'))
    x = t.spread(t.raw("part").select("p_partkey", "p_size"), "p_partkey", "part").select(F.col("p_partkey").alias("id"), signature_info(s).alias("s"), call_arguments(line, F.concat(F.lit("call"), i)).alias("a"))
    return x.select("id", F.array_join("s.param_types", "|").alias("params"), F.col("s.return_type").alias("returns"), F.col("s.is_generic").alias("generic"), F.array_join("s.type_params", "|").alias("type_params"), F.array_join("a", "|").alias("arguments"))


@query("append_logs", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT id) AS ids FROM {logs} GROUP BY 1")
def append_logs(t):
    """Two halves appended to a table by day, which stays as it is in between."""
    at = f"{shared_dir(t.spark)}/loomgraph/appended-{uuid.uuid4().hex}"
    rows = t.logs.select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    for half in (0, 1):
        append(rows.filter(F.col("id") % 2 == half), at, ["day"])
    return t.spark.read.schema("id bigint, day string").parquet(at).groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


_QUESTION = """WITH busy AS (SELECT src, count(*) AS n FROM calls GROUP BY src HAVING count(*) > 3)
    SELECT f.file, count(*) AS callers, sum(b.n) AS calls FROM busy b JOIN functions f ON f.id = b.src WHERE f.id NOT IN (SELECT dst FROM calls WHERE src = 1) GROUP BY f.file"""


@query("adhoc_query", "SELECT file, callers, CAST(calls AS BIGINT) AS calls FROM (" + _QUESTION.replace(" calls GROUP", " {calls} GROUP").replace("functions f", "{functions} f").replace("FROM calls WHERE", "FROM {calls} WHERE") + ")")
def adhoc_query(t):
    """A question in SQL over two views, after the guard."""
    return adhoc.run_query(t.spark, _QUESTION, {"calls": t.calls, "functions": t.functions})
