"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..plans.graph import clamp_depth as _clamp
from ..sources import files as sf
from ..sources import symbols as sources
from .registry import query


@query("scan_files", "SELECT file_path, language, size_bytes, content_hash FROM {files} WHERE size_bytes > 0 AND size_bytes <= 512000")
def scan_files(t):
    return sf.indexable(t.files, "size_bytes").select("file_path", "language", "size_bytes", "content_hash")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, sha256('k' || sha256(text)) AS keyed FROM documents")
def content_hash(t):
    d = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.withColumn("keyed", F.sha2(F.concat(F.lit("k"), "content_hash"), 256))


@query("url_repo_name", "SELECT page_id, regexp_extract(url, '/([^/]+?)(?:\\.git)?/?$', 1) AS repo_name FROM pages")
def url_repo_name(t):
    return t.raw("pages").select("page_id", fx.repo_name(F.col("url")).alias("repo_name"))


@query("package_name", """WITH s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '@' || regexp_replace(url, '^https?://', '') ELSE regexp_replace(url, '^https?://', '') END AS s FROM pages)
    SELECT page_id, CASE WHEN starts_with(s, '@') THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE string_split(s, '/')[1] END AS package FROM s""")
def package_name(t):
    bare = F.regexp_replace("url", "^https?://", "")
    s = t.raw("pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("@"), bare)).otherwise(bare).alias("s"))
    return s.select("page_id", fx.package_name(F.col("s")).alias("package"))


@query("scip_symbol_id", """SELECT sym_id, file_path, name, CASE WHEN kind = 'function' THEN 'Cls' END AS container FROM {symbols}""")
def scip_symbol_id(t):
    """Ids are composed from the symbols and taken apart again."""
    folder, base = F.lit("src/"), F.regexp_replace("file_path", "^src/", "")
    chain = F.when(F.col("kind") == "function", F.concat(F.lit("Cls#"), "name", F.lit("()."))).otherwise(F.concat("name", F.lit("#")))
    s = t.symbols.select("sym_id", F.concat(F.lit("scip-x npm pkg 1.0 "), folder, F.lit("`"), base, F.lit("`/"), chain).alias("id"))
    path, name, container = fx.symbol_id(F.col("id"))
    return s.select("sym_id", path.alias("file_path"), name.alias("name"), container.alias("container"))


@query("sink_kind", """SELECT finding_id, CASE finding_id % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'xss' WHEN 2 THEN 'path' ELSE 'q' || (finding_id % 7) END AS sink_kind FROM {findings}""")
def sink_kind(t):
    i = F.col("finding_id") % 4
    rule = F.when(i == 0, "js/sql-injection").when(i == 1, "js/reflected-xss").when(i == 2, "js/path-traversal").otherwise(F.col("query_id"))
    return t.findings.select("finding_id", fx.sink_kind(rule).alias("sink_kind"))


@query("strip_prefix", """SELECT id, CASE id % 6 WHEN 0 THEN file_path WHEN 1 THEN file_path WHEN 2 THEN file_path WHEN 3 THEN file_path WHEN 4 THEN file_path ELSE '/srv/' || file_path END AS path FROM {logs}""")
def strip_prefix(t):
    i = F.col("id") % 6
    head = F.when(i == 0, "/var/task/").when(i == 1, "/app/").when(i == 2, "/home/ci/").when(i == 3, "/opt/svc/").when(i == 4, "/workspace/").otherwise("/srv/")
    return t.logs.select("id", fx.strip_prefix(F.concat(head, "file_path")).alias("path"))


@query("normalize_logs", """SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'error' ELSE 'info' END AS level_p1,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level_p2 FROM events""")
def normalize_logs(t):
    e = F.col("event_type")
    word = F.when(e == "error", "ERROR").when(e == "signup", "warning").when(e == "purchase", "stderr").otherwise("log")
    return t.raw("events").select("event_id", fx.log_level("p1", word).alias("level_p1"), fx.log_level("p2", word).alias("level_p2"))


@query("deployment_status_map", """SELECT deployment_id, CASE status WHEN 'cancelled' THEN 'cancelled' ELSE status END AS p1, CASE status WHEN 'cancelled' THEN 'canceled' WHEN 'ready' THEN 'ready' ELSE status END AS p2 FROM {deployments}""")
def deployment_status_map(t):
    word = F.when(F.col("status") == "cancelled", "CANCELED").otherwise(F.upper("status"))
    return t.deployments.select("deployment_id", fx.deploy_status("p1", word).alias("p1"), fx.deploy_status("p2", word).alias("p2"))


@query("level_threshold", "SELECT id FROM {logs} WHERE level IN ('warn', 'error')")
def level_threshold(t):
    return t.logs.filter(fx.at_least(F.col("level"), "unheard of")).select("id")


@query("clamp_depth", "SELECT id, CAST(least(greatest(round(duration), 1), 15) AS INTEGER) AS depth FROM {logs}")
def clamp_depth(t):
    assert (_clamp(0), _clamp(3.4), _clamp(99)) == (1, 3, 15)
    return t.logs.select("id", F.least(F.greatest(F.round("duration"), F.lit(1.0)), F.lit(15.0)).cast("int").alias("depth"))


@query("null_fns", "SELECT id, nullif(line_number, 0) AS line_number, coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE message END, ''), 'none') AS message FROM {logs}")
def null_fns(t):
    message = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("message"))
    return t.logs.select("id", fx.or_null(F.col("line_number")).alias("line_number"), F.coalesce(fx.or_null(message), F.lit("none")).alias("message"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract(t):
    j = F.from_json("props", "k BIGINT, missing STRING", {"mode": "PERMISSIVE"})
    return t.raw("events").select("event_id", j["k"].alias("k"), j["missing"].alias("missing"))


@query("date_fns", "SELECT id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS day, strftime(ts - INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M') AS since FROM {logs}")
def date_fns(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.logs.select("id", ms.alias("ms"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.col("ts") - F.expr("INTERVAL 30 MINUTES"), "yyyy-MM-dd HH:mm").alias("since"))


@query("string_fns", """SELECT sym_id, upper(name) AS up, lpad(CAST(sym_id AS VARCHAR), 8, '0') AS padded, replace(signature, '#', '-') AS sig, array_to_string(string_split(name, '_'), '.') AS dotted, substr(name, 1, 4) AS head FROM {symbols}""")
def string_fns(t):
    return t.symbols.select(
        "sym_id", F.upper("name").alias("up"), F.lpad(F.col("sym_id").cast("string"), 8, "0").alias("padded"), F.regexp_replace("signature", "#", "-").alias("sig"),
        F.array_join(F.split("name", "_"), ".").alias("dotted"), F.substring("name", 1, 4).alias("head"),
    )


@query("array_fns", """WITH a AS (SELECT sym_id, [sym_id % 7, sym_id % 5, sym_id % 3, 1] AS xs FROM {symbols})
    SELECT sym_id, array_to_string(list_sort(list_distinct(xs)), ',') AS distinct_sorted, list_contains(xs, 0) AS has_zero, CAST(len(list_filter(xs, lambda x: x > 1)) AS INTEGER) AS big, array_to_string(xs[2:3], ',') AS middle FROM a""")
def array_fns(t):
    xs = F.array(F.col("sym_id") % 7, F.col("sym_id") % 5, F.col("sym_id") % 3, F.lit(1).cast("bigint"))
    a = t.symbols.select("sym_id", xs.alias("xs"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return a.select("sym_id", text(F.array_sort(F.array_distinct("xs"))).alias("distinct_sorted"), F.array_contains("xs", 0).alias("has_zero"), F.size(F.filter("xs", lambda x: x > 1)).alias("big"), text(F.slice("xs", 2, 2)).alias("middle"))


@query("webhook_commits", """SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS sha, substr('[' || event_type || '] ' || props, 1, 120) AS message FROM events WHERE event_type IN ('click', 'view')""")
def webhook_commits(t):
    """Push events are composed as JSON and read back; other branches and unchanged heads are left out."""
    e = t.raw("events")
    commits = F.array(F.struct(F.sha2(F.col("event_id").cast("string"), 256).alias("id"), F.concat(F.lit("["), "event_type", F.lit("] "), "props", F.lit("\nbody")).alias("message")))
    branch = F.when(F.col("event_type") == "click", "main").when(F.col("event_type") == "view", "main").otherwise("other")
    body = F.to_json(F.struct(F.concat(F.lit("refs/heads/"), branch).alias("ref"), F.lit("new").alias("after"), commits.alias("commits")))
    return sf.push_commits(e.select("event_id", body.alias("body")), "event_id", "main", "old")


@query("file_symbols", """WITH s AS (SELECT sym_id AS i, start_line AS n, sym_id % 3 AS k FROM {symbols})
    SELECT i AS file, 'C' || i AS name, 'class' AS kind, 1 AS start_line, CAST(CASE k WHEN 0 THEN n + 5 ELSE n + 3 + CAST(k = 2 AS INTEGER) END AS INTEGER) AS end_line, NULL::VARCHAR AS parent, 0 AS depth FROM s
    UNION ALL SELECT i, 'f' || i, 'function', 3, CAST(CASE k WHEN 0 THEN n + 4 ELSE n + 3 END AS INTEGER), 'C' || i, 1 FROM s
    UNION ALL SELECT i, 'g' || i, 'function', CAST(n + 5 AS INTEGER), CAST(n + 5 AS INTEGER), CASE k WHEN 0 THEN 'C' || i END, CASE k WHEN 0 THEN 1 ELSE 0 END FROM s WHERE k < 2""")
def file_symbols(t):
    """A source text of each symbol, as long as its first line's number says, in three languages, through the table function."""
    i, n, k = F.col("sym_id").cast("string"), F.col("start_line").cast("int"), F.col("sym_id") % 3
    ts = F.concat(F.lit("class C"), i, F.lit(" {\n// function no() {\n  function f"), i, F.lit("() {\n"), F.repeat(F.lit("    x('}');\n"), n), F.lit("  }\n  function g"), i, F.lit("() { } }\n"))
    py = F.concat(F.lit("class C"), i, F.lit(":\n    '''def no():'''\n    def f"), i, F.lit("(self):\n"), F.repeat(F.lit("        x()\n"), n), F.lit("\ndef g"), i, F.lit("(): return 1\n"))
    rb = F.concat(F.lit("class C"), i, F.lit("\n  # def no\n  def f"), i, F.lit("\n"), F.repeat(F.lit("    x 'end'\n"), n - 1), F.lit("  end\nend\n"))
    text, language = (F.when(k == 0, a).when(k == 1, b).otherwise(c) for a, b, c in ((ts, py, rb), (F.lit("typescript"), F.lit("python"), F.lit("ruby"))))
    files = t.spread(t.symbols, "sym_id", "part").select(F.col("sym_id").alias("file_path"), language.alias("language"), text.alias("content"))
    return sources.symbols(files).select(F.col("file_path").alias("file"), "name", "kind", "start_line", "end_line", "parent", "depth")
