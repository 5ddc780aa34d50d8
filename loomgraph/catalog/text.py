"""Search over file contents and log messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import frames, text as fx
from ..operators import search as s
from ..operators.search_index import SearchIndex
from ..storage import shared_dir
from .registry import query

_SPLIT = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def _ranked(view: str, c: str, where: str, wanted: str) -> str:
    w = _SPLIT.format(c=c)
    hits = f"len(list_filter(w, lambda x: x IN ({wanted})))"
    return f"(SELECT *, CAST({hits} AS INTEGER) AS hits, round({hits} / (1 + ln(CAST(len(w) AS DOUBLE))), 6) AS rank FROM (SELECT *, {w} AS w FROM {{{view}}}) WHERE {where})"


@query("search_code", "SELECT file_path, language, size_bytes, hits, rank FROM " + _ranked("files", "content", "list_has_any(w, ['the']) AND list_has_any(w, ['thand', 'erion', 'inre']) AND NOT list_contains(w, 'zzz')", "'the', 'thand', 'erion', 'inre'") + " ORDER BY rank DESC, file_path LIMIT 10")
def search_code(t):
    found = s.search(t.files, "content", "the thand or erion or inre -zzz")
    return found.orderBy(F.desc("rank"), "file_path").limit(10).select("file_path", "language", "size_bytes", "hits", "rank")


def _index(t, carry):
    path = f"{shared_dir(t.spark)}/loomgraph/search-{uuid.uuid4().hex}"
    return SearchIndex.build(t.files, "doc_id", "content", path, carry)


@query("search_index", "SELECT doc_id AS key, file_path, language, hits, rank FROM " + _ranked("files", "content", "list_has_any(w, ['the']) AND list_has_any(w, ['thand', 'erion', 'inre']) AND NOT list_contains(w, 'zzz')", "'the', 'thand', 'erion', 'inre'"))
def search_index(t):
    """The search of search_code over a written index, all that match."""
    return _index(t, ["file_path", "language"]).search("the thand or erion or inre -zzz")


@query("search_files", "SELECT file_path, hits, rank FROM " + _ranked("files", "content", "contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND list_has_any(w, ['on', 'thand']) AND NOT list_contains(w, 'license')", "'of', 'the', 'on', 'thand'") + " ORDER BY rank DESC, file_path LIMIT 20")
def search_files(t):
    """The table function in SQL."""
    _index(t, ["file_path"]).register()
    return t.spark.sql("SELECT file_path, hits, rank FROM search_files('\"of the\" on or thand -license') ORDER BY rank DESC, file_path LIMIT 20")


@query("scoped_hits", "SELECT repo_id, file_path, hits FROM " + _ranked("files", "content", "list_has_any(w, ['copyright', 'license', 'secret'])", "'copyright', 'license', 'secret'") + " WHERE repo_id IN (SELECT repo_id FROM {repositories} WHERE name LIKE 'A%')")
def scoped_hits(t):
    scope = t.repositories.filter("name LIKE 'A%'").select("repo_id")
    return s.search(t.files.join(F.broadcast(scope), "repo_id", "left_semi"), "content", "copyright or license or secret").select("repo_id", "file_path", "hits")


@query("search_substring", "SELECT file_path, language FROM {files} WHERE contains(lower(content), 'license')")
def search_substring(t):
    return s.search_substring(t.files, "content", "LICENSE").select("file_path", "language")


@query("search_logs", "SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, message FROM (SELECT *, " + _SPLIT.format(c="message") + " AS w FROM {logs}) WHERE list_contains(w, 'failed') AND list_contains(w, 'error') AND contains(' ' || array_to_string(w, ' ') || ' ', ' k 17 ') ORDER BY ts DESC, id DESC LIMIT 30")
def search_logs(t):
    found = s.search(t.logs, "message", 'failed error "k 17"').orderBy(F.desc("ts"), F.desc("id")).limit(30)
    return found.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "message")


@query("search_snippets", """WITH l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln, len(string_split(content, chr(10))) AS n FROM {files}),
    h AS (SELECT * FROM l WHERE contains(lower(line), 'license') OR contains(lower(line), 'secret') OR contains(lower(line), 'ertion')),
    m AS (SELECT *, CASE WHEN ln - 2 <= lag(ln) OVER (PARTITION BY doc_id ORDER BY ln) + 3 THEN 0 ELSE 1 END AS new FROM h),
    i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS nth FROM m)
    SELECT doc_id, CAST(nth AS BIGINT) AS nth, CAST(greatest(min(ln) - 2, 1) AS INTEGER) AS first_line, CAST(least(max(ln) + 2, any_value(n)) AS INTEGER) AS last_line, count(*) AS n_matches FROM i WHERE nth <= 5 GROUP BY doc_id, nth""")
def search_snippets(t):
    return s.snippets(t.files, "doc_id", "content", ["license", "secret", "ertion"])


@query("grep_lines", """SELECT doc_id, CAST(ln AS INTEGER) AS line_number, substr(trim(line), 1, 120) AS line FROM
    (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM {files}) WHERE contains(line, 'thth')""")
def grep_lines(t):
    return s.grep_lines(t.files, "doc_id", "content", "thth")


def _traces(t):
    """Traces of several formats, one line after the other."""
    n, fn = F.col("line_number").cast("string"), F.col("function_name")
    lines = [
        F.concat(F.lit("    at charge (/app/src/pay"), F.col("id"), F.lit(".ts:"), n, F.lit(":7)")),
        F.concat(F.lit('  File "/var/task/api/job.py", line '), n, F.lit(", in "), fn), F.concat(F.lit("at com.acme.Svc.run$In(Svc.java:"), n, F.lit(")")),
        F.lit("at java.util.List.of(List.java:5)"), F.concat(F.lit("/home/ci/lib/a.rb:"), n, F.lit(":in `go'")), F.concat(F.lit("#0 /opt/srv/x.php("), n, F.lit("): Kls->go()")),
        F.lit("at Node.x (node_modules/y/z.js:1:2)"), F.lit("no frame here"),
    ]
    return t.logs.filter("level = 'error'").select("id", F.concat_ws("\n", *lines).alias("stack_trace"))


@query("stack_frames", """WITH e AS (SELECT id, line_number AS n, function_name AS fn FROM {logs} WHERE level = 'error')
    SELECT id, 0 AS nth, 'js' AS format, 'src/pay' || id || '.ts' AS file_path, n AS line_number, 7 AS column_number, 'charge' AS function_name FROM e
    UNION ALL SELECT id, 1, 'python', 'api/job.py', n, NULL, fn FROM e UNION ALL SELECT id, 2, 'jvm', 'Svc.java', n, NULL, 'com.acme.Svc.run$In' FROM e
    UNION ALL SELECT id, 4, 'ruby', 'lib/a.rb', n, NULL, 'g' FROM e UNION ALL SELECT id, 5, 'php', 'x.php', n, NULL, 'Kls->go' FROM e""")
def stack_frames(t):
    return frames.stack_frames(_traces(t), "id", "stack_trace")


@query("log_enrich", """SELECT id, CASE WHEN level = 'error' AND id % 2 = 0 THEN 'src/pay' || id || '.ts' ELSE file_path END AS file_path, line_number,
    CASE WHEN level = 'error' AND id % 2 = 0 THEN 'charge' ELSE function_name END AS function_name FROM {logs}""")
def log_enrich(t):
    from ..operators.logs import enrich

    bare = (F.col("level") == "error") & (F.col("id") % 2 == 0)
    logs = t.logs
    for c in ("file_path", "function_name", "line_number"):
        logs = logs.withColumn(c, F.when(~bare, F.col(c)).otherwise(F.lit(None).cast(logs.schema[c].dataType)))
    return enrich(logs.join(_traces(t), "id", "left")).select("id", "file_path", "line_number", "function_name")


@query("error_patterns", """SELECT id, name, category FROM (SELECT id, message || CASE event_type WHEN 'error' THEN ': connect ECONNREFUSED' WHEN 'signup' THEN ' Rate Limit' ELSE '' END AS m FROM {logs}),
    (VALUES ('econnrefused', 'network', 'ECONNREFUSED|connect ECONNREFUSED'), ('rate-limit', 'network', '(?i)rate limit|429|too many requests'), ('sigterm', 'runtime', 'signal SIGTERM|Lifecycle script .+ failed.*SIGTERM')) p(name, category, pattern)
    WHERE regexp_matches(m, pattern)""")
def error_patterns(t):
    more = F.when(F.col("event_type") == "error", ": connect ECONNREFUSED").when(F.col("event_type") == "signup", " Rate Limit").otherwise("")
    return t.logs.select("id", F.explode(fx.error_patterns(F.concat("message", more))).alias("name")).withColumn("category", fx.error_category(F.col("name")))


@query("log_prefix", """SELECT id, event_type AS module, regexp_extract(message, '^\\[(\\w[\\w-]*)\\]\\s+(.+?)(?:\\s+failed|\\s+error|\\s+crashed)', 2) AS action, CASE WHEN level = 'error' THEN 'TypeError' END AS error_type FROM {logs}""")
def log_prefix(t):
    m = F.concat("message", F.when(F.col("level") == "error", ": TypeError: x").otherwise(""))
    module, action, kind = fx.log_prefix(m)
    return t.logs.select("id", module.alias("module"), action.alias("action"), kind.alias("error_type"))
