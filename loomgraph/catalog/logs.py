"""Log and deployment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as lg
from .registry import AS_OF, query


def _ts(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("recent_logs", f"SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, level, message FROM {{logs}} WHERE logs.ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 2 DAYS AND TIMESTAMP '{AS_OF}' AND source = 'p1' ORDER BY logs.ts DESC, id DESC LIMIT 50")
def recent_logs(t):
    return lg.recent(t.logs, AS_OF, 2880, source="p1", level="all").select("id", _ts(), "level", "message")


@query("logs_page", "SELECT id, level, count(*) OVER () AS total FROM {logs} WHERE level <> 'info' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100")
def logs_page(t):
    return lg.page(t.logs.filter("level <> 'info'"), 3, 50).select("id", "level", "total")


@query("log_stats_level", "SELECT count(*) AS total, count(*) FILTER (WHERE level = 'info') AS n_info, count(*) FILTER (WHERE level = 'warn') AS n_warn, count(*) FILTER (WHERE level = 'error') AS n_error FROM {logs}")
def log_stats_level(t):
    return lg.level_stats(t.logs)


@query("log_stats_source", "SELECT source, count(*) AS n FROM {logs} GROUP BY source")
def log_stats_source(t):
    return lg.source_stats(t.logs)


@query("deployment_history", """WITH d AS (SELECT * FROM {deployments} ORDER BY started_at DESC, deployment_id LIMIT 10)
    SELECT d.deployment_id, strftime(d.started_at, '%Y-%m-%d') AS started_at, d.status, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warn') AS warnings
    FROM d LEFT JOIN {logs} l ON l.deployment_id = d.deployment_id GROUP BY ALL""")
def deployment_history(t):
    return lg.deployment_history(t.deployments, t.logs).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd"))


@query("deploy_errors", "SELECT id, deployment_id, message FROM {logs} WHERE level = 'error' AND deployment_id IN (SELECT deployment_id FROM {deployments} ORDER BY started_at DESC, deployment_id LIMIT 2)")
def deploy_errors(t):
    return lg.deploy_errors(t.deployments, t.logs, 2).select("id", "deployment_id", "message")


@query("collector_health", f"""WITH s AS (SELECT deployment_id, CASE WHEN day(started_at) % 5 = 0 THEN NULL ELSE started_at END AS last_poll_at, day(started_at) % 4 <> 0 AS enabled FROM {{deployments}})
    SELECT deployment_id, CASE WHEN NOT enabled THEN 'disabled' WHEN last_poll_at IS NULL THEN 'never polled' WHEN last_poll_at < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAYS THEN 'stale' ELSE 'fresh' END AS state FROM s""")
def collector_health(t):
    d = F.day("started_at")
    s = t.deployments.select("deployment_id", F.when(d % 5 != 0, F.col("started_at")).alias("last_poll_at"), (d % 4 != 0).alias("enabled"), F.lit(86400).alias("interval_s"))
    return lg.collector_health(s, AS_OF).select("deployment_id", "state")


@query("stuck_jobs", f"""SELECT deployment_id, CASE WHEN status = 'building' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAYS THEN 'failed' WHEN status = 'building' THEN 'running' ELSE status END AS status FROM {{deployments}}""")
def stuck_jobs(t):
    jobs = t.deployments.withColumn("status", F.when(F.col("status") == "building", "running").otherwise(F.col("status")))
    return lg.stuck_jobs(jobs, AS_OF, 14400).select("deployment_id", "status")


@query("first_deploys", """WITH e AS (SELECT 'c' || (user_id % 40) AS commit_sha, ts, event_id FROM events WHERE event_type IN ('purchase', 'signup'))
    SELECT commit_sha, arg_min(event_id, (ts, event_id)) AS deployment_id FROM e WHERE commit_sha NOT IN ('c3', 'c5') GROUP BY commit_sha""")
def first_deploys(t):
    e = t.raw("events").filter("event_type in ('purchase', 'signup')")
    d = e.select(F.concat(F.lit("c"), F.col("user_id") % 40).alias("commit_sha"), F.col("ts").alias("started_at"), F.col("event_id").alias("deployment_id"), F.lit("ready").alias("status"))
    known = t.spark.createDataFrame([("c3",), ("c5",)], "commit_sha string")
    return lg.first_deploys(d, known).select("commit_sha", "deployment_id")


@query("dedupe_logs", "SELECT source, deployment_id, message, min(id) AS id FROM {logs} GROUP BY ALL")
def dedupe_logs(t):
    return lg.dedupe(t.logs.select("id", "source", "deployment_id", "message"), "source", "deployment_id", "message")
