"""Specified analytics: rolling metrics, regressions, heat, conventions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conventions as cv
from ..operators import metrics as m
from ..operators import snapshots as sn
from ..storage import written
from .registry import AS_OF, query

_WINDOWS = {"1d": 24, "7d": 168, "30d": 720}


def _metrics(t):
    return m.rolling(t.logs, AS_OF, _WINDOWS)


_M = f"""m AS (SELECT function_name, w AS "window", count(*) AS invocations, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warn') AS warnings,
    quantile_cont(duration, 0.5) AS p50, quantile_cont(duration, 0.95) AS p95, quantile_cont(duration, 0.99) AS p99,
    arg_max(message, (ts, id)) FILTER (WHERE level = 'error') AS last_error, max(ts) AS last_invocation, round(count(*) FILTER (WHERE level = 'error') / count(*), 6) AS error_rate
    FROM {{logs}}, (VALUES ('1d', 24), ('7d', 168), ('30d', 720)) v(w, h) WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - to_hours(h) AND TIMESTAMP '{AS_OF}' GROUP BY function_name, w)"""


@query("fn_metrics", f"""WITH {_M} SELECT function_name, "window", invocations, errors, warnings, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99, last_error, strftime(last_invocation, '%Y-%m-%d %H:%M:%S') AS last_invocation, error_rate FROM m""")
def fn_metrics(t):
    x = _metrics(t).withColumn("last_invocation", F.date_format("last_invocation", "yyyy-MM-dd HH:mm:ss"))
    return x.select("function_name", "window", "invocations", "errors", "warnings", *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")], "last_error", "last_invocation", "error_rate")


_R = """r AS (SELECT b.function_name, unnest(list_filter([
    CASE WHEN r.error_rate > 5 * b.error_rate OR r.error_rate > 0.10 THEN {{'kind': 'error_rate', 'severity': 'critical'}} WHEN r.error_rate > 2 * b.error_rate AND r.error_rate - b.error_rate > 0.01 THEN {{'kind': 'error_rate', 'severity': 'warning'}} END,
    CASE WHEN r.p95 > 5 * b.p95 OR r.p95 > 5000 THEN {{'kind': 'latency', 'severity': 'critical'}} WHEN r.p95 > 2 * b.p95 AND r.p95 > 200 THEN {{'kind': 'latency', 'severity': 'warning'}} END,
    CASE WHEN r.errors > 0 AND b.errors = r.errors THEN {{'kind': 'new_errors', 'severity': 'warning'}} END,
    CASE WHEN coalesce(r.invocations, 0) < 0.1 * b.invocations THEN {{'kind': 'traffic_drop', 'severity': 'warning'}} END], lambda x: x IS NOT NULL)) AS x
    FROM m b LEFT JOIN m r ON r.function_name = b.function_name AND r."window" = '1d' WHERE b."window" = '7d')""".replace("{{", "{").replace("}}", "}")


@query("regressions", f"WITH {_M}, {_R} SELECT function_name, x.kind AS kind, x.severity AS severity FROM r")
def regressions(t):
    return m.regressions(_metrics(t), "1d", "7d")


@query("regression_deploy", f"""WITH {_M}, {_R}, f AS (SELECT r.function_name, x.kind AS kind, min(l.ts) AS began FROM r JOIN {{logs}} l ON l.function_name = r.function_name AND l.level = 'error' AND l.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS GROUP BY ALL)
    SELECT f.function_name, f.kind, arg_max(d.deployment_id, d.started_at) AS deployment_id FROM f JOIN {{deployments}} d ON d.started_at <= f.began GROUP BY ALL""")
def regression_deploy(t):
    """The last deployment before a function's first error of the week, however long before."""
    found = m.regressions(_metrics(t), "1d", "7d").select("function_name", "kind")
    since = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    began = t.logs.filter((F.col("level") == "error") & (F.col("ts") >= since)).groupBy("function_name").agg(F.min("ts").alias("began"))
    of = m.last_before(found.join(began, "function_name"), "began", t.deployments, "started_at", "deployment_id")
    return of.filter("deployment_id is not null").select("function_name", "kind", "deployment_id")


@query("regression_resolved", """WITH d AS (SELECT function_name, date_trunc('day', ts) AS day, count(*) FILTER (WHERE level = 'error') AS e FROM {logs} GROUP BY ALL),
    b AS (SELECT function_name, avg(e) AS base FROM d GROUP BY 1), o AS (SELECT d.function_name, day, e <= 1.5 * base AS ok FROM d JOIN b USING (function_name))
    SELECT function_name, strftime(day, '%Y-%m-%d') AS day, coalesce(ok AND lag(ok) OVER (PARTITION BY function_name ORDER BY day), false) AS resolved FROM o""")
def regression_resolved(t):
    d = t.logs.groupBy("function_name", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("level") == "error").alias("e"))
    base = d.groupBy("function_name").agg(F.avg("e").alias("base"))
    return m.resolved(d.join(base, "function_name"), "function_name", "day", "e", "base").select("function_name", "day", "resolved")


@query("heat_tiers", f"""WITH {_M}, x AS (SELECT function_name, invocations, error_rate, (SELECT count(*) FROM m b WHERE b."window" = '30d' AND b.invocations > a.invocations) / (SELECT count(*) FROM m b WHERE b."window" = '30d') AS share FROM m a WHERE "window" = '30d')
    SELECT function_name, invocations, CASE WHEN invocations = 0 THEN 'dead' WHEN error_rate >= 0.25 THEN 'degraded' WHEN share < 0.05 AND error_rate < 0.01 THEN 'critical' WHEN share < 0.2 THEN 'hot' WHEN share < 0.6 THEN 'warm' ELSE 'cold' END AS tier FROM x""")
def heat_tiers(t):
    return m.heat_tiers(_metrics(t).filter("window = '30d'"))


@query("hot_paths", f"""WITH {_M} SELECT function_name, invocations, error_rate FROM m WHERE "window" = '7d' ORDER BY invocations DESC, function_name LIMIT 20""")
def hot_paths(t):
    x = m.rolling(t.logs, AS_OF, {"7d": 168})
    return x.orderBy(F.desc("invocations"), "function_name").limit(20).select("function_name", "invocations", "error_rate")


@query("deploy_impact", """WITH c AS (SELECT deployment_id, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS errors FROM {logs} GROUP BY 1)
    SELECT d.deployment_id, c.n, c.errors, c.errors - lag(c.errors) OVER (ORDER BY d.started_at) AS error_change FROM {deployments} d JOIN c USING (deployment_id)""")
def deploy_impact(t):
    """Errors against the deployment before; one row a deployment is left when the window runs."""
    c = t.logs.groupBy("deployment_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("errors"))
    j = t.deployments.join(c, "deployment_id")
    was = F.lag("errors").over(Window.orderBy("started_at", "deployment_id"))
    return j.select("deployment_id", "n", "errors", (F.col("errors") - was).alias("error_change"))


@query("hourly_snapshots", "SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS errors FROM {logs} GROUP BY ROLLUP (1, 2)")
def hourly_snapshots(t):
    return m.hourly(t.logs)


_CASE = """CASE WHEN regexp_matches(n, '^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$') THEN 'SCREAMING_SNAKE' WHEN regexp_matches(n, '^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$') THEN 'snake_case'
    WHEN regexp_matches(n, '^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(n, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(n, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' ELSE 'other' END"""
_NAMES = f"n AS (SELECT sym_id, file_path AS scope, CASE WHEN sym_id % 5 = 0 THEN replace(name, '_', '') WHEN sym_id % 7 = 0 THEN upper(name) ELSE name END AS n FROM {{symbols}}), c AS (SELECT *, {_CASE} AS pattern FROM n)"
_CONV = """v AS (SELECT scope, arg_max(pattern, (k, pattern)) AS pattern, round(max(k) / sum(k), 6) AS adoption, CAST(sum(k) AS BIGINT) AS n FROM (SELECT scope, pattern, count(*) AS k FROM c GROUP BY ALL) GROUP BY scope HAVING round(max(k) / sum(k), 6) >= 0.6)"""


def _names(t):
    i = F.col("sym_id")
    name = F.when(i % 5 == 0, F.regexp_replace("name", "_", "")).when(i % 7 == 0, F.upper("name")).otherwise(F.col("name"))
    return t.symbols.select("sym_id", F.col("file_path").alias("scope"), name.alias("n"))


def _stored(t):
    return written(sn.snapshots(t.logs), "snapshots")


_SNAP = """count(*) AS invocations, count(*) FILTER (WHERE level = 'warn') AS warnings, count(*) FILTER (WHERE level = 'error') AS errors, round(count(*) FILTER (WHERE level = 'error') / count(*), 6) AS error_rate,
    quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95, quantile_disc(duration, 0.99) AS p99 FROM {logs}"""


@query("function_snapshots", f"SELECT function_name, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, {_SNAP} GROUP BY ALL")
def function_snapshots(t):
    """Hours are stored, merged to days and those to weeks."""
    weeks = sn.with_rates(sn.merged(sn.merged(_stored(t), "day"), "week"))
    return weeks.select("function_name", F.date_format("at", "yyyy-MM-dd").alias("week"), *sn.COUNTS, "error_rate", "p50", "p95", "p99")


@query("function_trend", f"""WITH d AS (SELECT function_name, date_trunc('day', ts) AS at_, {_SNAP} WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)
    SELECT function_name, strftime(at_, '%Y-%m-%d') AS day, p95 AS value, round(p95 - lag(p95) OVER (PARTITION BY function_name ORDER BY at_), 6) AS change FROM d""")
def function_trend(t):
    x = sn.trend(_stored(t), "p95", "day", F.lit("2024-01-10").cast("timestamp_ntz"))
    return x.select("function_name", F.date_format("at", "yyyy-MM-dd").alias("day"), "value", F.round("change", 6).alias("change"))


_TIER = """tiers AS (SELECT function_name, CASE WHEN invocations = 0 THEN 'dead' WHEN error_rate >= 0.25 THEN 'degraded' WHEN share < 0.05 AND error_rate < 0.01 THEN 'critical' WHEN share < 0.2 THEN 'hot' WHEN share < 0.6 THEN 'warm' ELSE 'cold' END AS tier
    FROM (SELECT function_name, invocations, error_rate, (SELECT count(*) FROM m b WHERE b."window" = '30d' AND b.invocations > a.invocations) / (SELECT count(*) FROM m b WHERE b."window" = '30d') AS share FROM m a WHERE "window" = '30d'))"""


@query("degraded_functions", f"""WITH {_M}, {_R}, g AS (SELECT function_name, string_agg(DISTINCT x.kind, ',' ORDER BY x.kind) AS kinds, CASE WHEN bool_or(x.severity = 'critical') THEN 'critical' ELSE 'warning' END AS worst FROM r GROUP BY 1)
    SELECT g.*, m.invocations, m.error_rate FROM g JOIN m USING (function_name) WHERE m."window" = '7d' AND worst = 'critical'""")
def degraded_functions(t):
    x = written(_metrics(t), "metrics")
    return sn.degraded(x.filter("window = '7d'"), m.regressions(x, "1d", "7d"), "critical")


@query("change_risk", f"""WITH {_M}, {_R}, {_TIER}, all_time AS (SELECT function_name, {_SNAP} GROUP BY 1), k AS (SELECT function_name, count(*) AS n, bool_or(x.severity = 'critical') AS critical FROM r GROUP BY 1),
    targets AS (SELECT DISTINCT function_name FROM {{logs}} UNION ALL SELECT 'fn_unknown')
    SELECT function_name, coalesce(invocations, 0) AS invocations, error_rate, p95, tier, coalesce(n, 0) AS regressions,
    CASE WHEN invocations IS NULL THEN 'none' WHEN coalesce(tier IN ('critical', 'hot', 'degraded'), false) OR coalesce(critical, false) THEN 'high' WHEN coalesce(tier = 'warm', false) OR coalesce(n, 0) > 0 THEN 'medium' ELSE 'low' END AS risk
    FROM targets LEFT JOIN all_time USING (function_name) LEFT JOIN tiers USING (function_name) LEFT JOIN k USING (function_name)""")
def change_risk(t):
    """All functions, and one that was never called, as if they were to be changed."""
    x = written(_metrics(t), "metrics")
    targets = t.logs.select("function_name").unionByName(t.spark.createDataFrame([("fn_unknown",)], "function_name string"))
    return sn.change_risk(targets, _stored(t), m.heat_tiers(x.filter("window = '30d'")), m.regressions(x, "1d", "7d"))


@query("naming_conventions", f"WITH {_NAMES}, {_CONV} SELECT scope, pattern, adoption, n FROM v")
def naming_conventions(t):
    return cv.dominant(_names(t), "scope", "n")


@query("convention_outliers", f"WITH {_NAMES}, {_CONV} SELECT sym_id, c.scope, c.pattern, v.pattern AS expected FROM c JOIN v ON v.scope = c.scope WHERE c.pattern <> v.pattern")
def convention_outliers(t):
    names = _names(t)
    return cv.outliers(names, cv.dominant(names, "scope", "n"), "scope", "n").select("sym_id", "scope", "pattern", "expected")


@query("recency_weighted_votes", """WITH w AS (SELECT o_orderpriority AS scope, o_orderstatus AS pattern, sum(exp(-0.693 * date_diff('day', o_orderdate, TIMESTAMP '2001-12-31') / 180.0)) AS weight FROM orders GROUP BY ALL)
    SELECT scope, pattern, round(weight, 4) AS weight, round(weight / sum(weight) OVER (PARTITION BY scope), 4) AS share FROM w""")
def recency_weighted_votes(t):
    age = F.date_diff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate"))
    v = cv.recency_votes(t.raw("orders"), "o_orderpriority", "o_orderstatus", age)
    return v.select(F.col("o_orderpriority").alias("scope"), F.col("o_orderstatus").alias("pattern"), F.round("weight", 4).alias("weight"), F.round("share", 4).alias("share"))


@query("function_length_stats", """WITH f AS (SELECT file_path, CAST(end_line - start_line + 1 AS DOUBLE) AS len FROM {symbols} WHERE kind = 'function'),
    g AS (SELECT file_path, count(*) AS n, round(avg(len), 6) AS mean, round(quantile_cont(len, 0.95), 6) AS p95 FROM f GROUP BY 1)
    SELECT g.*, (SELECT count(*) FROM f WHERE f.file_path = g.file_path AND len > p95) AS outliers FROM g""")
def function_length_stats(t):
    return cv.length_stats(t.symbols, "file_path")
