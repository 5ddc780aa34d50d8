"""Streaming queries, run to the end of their input, and the batch forms of trigger handling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import log_source
from ..storage import shared_dir
from ..streaming import ingest as ing
from ..streaming import triggers as tr
from .registry import query


def _run(t, stream, mode="append"):
    """The rows that a stream leaves in its sink when its input is used up."""
    at = f"{shared_dir(t.spark)}/loomgraph/stream-{uuid.uuid4().hex}"
    ing.to_files(stream, f"{at}/out", f"{at}/checkpoint", mode).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


def _events(t):
    """The events as a stream: the file source reads the folder of the tables and takes this one."""
    return ing.log_stream(t.spark, t.sf_dir, t.raw("events").schema, pattern="events.parquet")


def _level():
    return F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")


@query("stream_ingest", "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'error' ELSE 'warn' END AS level FROM events WHERE event_type IN ('error', 'signup')")
def stream_ingest(t):
    logs = _events(t).select(F.col("event_id").alias("id"), "ts", _level().alias("level"))
    return _run(t, ing.ingest(logs, "warn")).select("id", "level")


@query("platform_drain", "SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'error' THEN 'error' ELSE 'warn' END AS level, 'dep_' || strftime(ts, '%Y%m%d') AS deployment_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events WHERE event_type IN ('error', 'signup')")
def platform_drain(t):
    """The events as the logs that a platform has left in a store, a deployment a day: the stream reads them deployment by deployment, and what is stored is of level warn and above."""
    at = f"{shared_dir(t.spark)}/loomgraph/export-{uuid.uuid4().hex}"
    word = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "warning").otherwise("log")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = t.raw("events").select(F.concat(F.lit("dep_"), F.date_format("ts", "yyyyMMdd")).alias("deployment"), F.col("event_id").alias("id"), ms.alias("timestamp"), word.alias("type"), F.col("event_type").alias("message"))
    e.repartition("deployment", F.pmod("id", F.lit(8))).write.partitionBy("deployment").json(f"{at}/logs")
    e.groupBy(F.col("deployment").alias("id")).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).write.json(f"{at}/deployments")
    got = _run(t, ing.ingest(log_source.logs(t.spark, [{"name": "store", "platform": "export", "url": at}], streaming=True), "warn"))
    return got.select("id", "level", "deployment_id", F.unix_millis("ts").alias("ms"))


@query("late_drop", """WITH e AS (SELECT ts::DATE AS day, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level FROM events)
    SELECT strftime(day, '%Y-%m-%d') AS day, level, count(*) AS n FROM e WHERE day < (SELECT (max(ts) - INTERVAL 30 MINUTES)::DATE FROM events) GROUP BY ALL""")
def late_drop(t):
    """Days that the watermark has closed; the last day stays open."""
    logs = _events(t).select("ts", _level().alias("level"))
    return _run(t, ing.level_counts(logs)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "level", "n")


@query("debounce_sessions", """WITH e AS (SELECT user_id % 5 AS repo_id, ts FROM events),
    m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY repo_id ORDER BY ts)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY repo_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT repo_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts) + INTERVAL 30 MINUTES) AS BIGINT) AS fires_us, count(*) AS n FROM i GROUP BY repo_id, s""")
def debounce_sessions(t):
    changes = t.raw("events").select((F.col("user_id") % 5).alias("repo_id"), F.col("ts").cast("timestamp").alias("ts"))
    d = tr.debounce(changes, "repo_id")
    return d.select("repo_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("fires_at").alias("fires_us"), "n")


@query("bulk_change_windows", "SELECT CAST(epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start_us, count(*) AS n, count(*) > 80 AS bulk FROM events GROUP BY 1")
def bulk_change_windows(t):
    e = t.raw("events").select(F.col("ts").cast("timestamp").alias("ts"))
    return tr.bulk_windows(e, "ts", "6 hours", 80).select(F.unix_micros("start").alias("start_us"), "n", "bulk")


@query("watch_batches", """WITH RECURSIVE e AS (SELECT user_id % 3 AS key, user_id AS path, CAST(epoch_us(ts) AS BIGINT) AS us FROM events),
    c AS (SELECT *, CASE WHEN us - lag(us) OVER w < 900000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY key, path ORDER BY us)),
    q AS (SELECT *, sum(new) OVER (PARTITION BY key, path ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM c),
    f AS (SELECT key, path, max(us) + 900000000 AS us, count(*) AS changes FROM q GROUP BY key, path, s),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, path) AS i FROM f),
    r AS (SELECT key, i, us, changes, 1 AS batch, 1 AS size FROM o WHERE i = 1
        UNION ALL SELECT o.key, o.i, o.us, o.changes, CASE WHEN o.us - r.us >= 1200000000 OR r.size = 10 THEN r.batch + 1 ELSE r.batch END, CASE WHEN o.us - r.us >= 1200000000 OR r.size = 10 THEN 1 ELSE r.size + 1 END
        FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
    SELECT key, CAST(batch AS INTEGER) AS batch, count(*) AS n, CAST(sum(changes) AS BIGINT) AS changes, min(us) AS first_us, CASE WHEN count(*) = 10 THEN max(us) ELSE max(us) + 1200000000 END AS fires_us FROM r GROUP BY key, batch""")
def watch_batches(t):
    """Users stand for paths, quiet for 15 minutes; a batch closes after 20 minutes, or with the tenth path."""
    e = t.raw("events").select((F.col("user_id") % 3).alias("key"), F.col("user_id").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return tr.watch_batches(e, 900_000_000, 1_200_000_000, 10)


@query("backoff_schedule", """WITH p AS (SELECT user_id AS source, event_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT source, event_id, n - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY source ORDER BY n), 0) AS failures FROM p)
    SELECT source, event_id, CAST(failures AS INTEGER) AS failures, CAST(CASE WHEN failures = 0 THEN 0 ELSE least(15 * least(pow(2, failures), 32), 600) END AS INTEGER) AS wait_s FROM f""")
def backoff_schedule(t):
    p = t.raw("events").select(F.col("user_id").alias("source"), "event_id", (F.col("event_type") == "error").alias("failed"))
    return tr.failure_runs(p, "source", "event_id", "failed").select("source", "event_id", F.col("failures").cast("int").alias("failures"), "wait_s")


_RUNS = """WITH RECURSIVE e AS (SELECT user_id % 5 AS key, CAST(epoch_us(ts) AS BIGINT) AS us, event_id AS id, 1200000000 AS d, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT key, n, us + d AS busy, CAST(NULL AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS late, CAST(NULL AS BIGINT) AS late_us, id AS own, us AS own_us FROM e WHERE n = 1
        UNION ALL SELECT key, n, CASE WHEN us >= free THEN us + d ELSE free END, CASE WHEN us < free THEN id END, CASE WHEN due THEN pending END, CASE WHEN due THEN busy END,
        CASE WHEN us >= free THEN id END, CASE WHEN us >= free THEN us END
        FROM (SELECT e.*, r.busy, r.pending, r.pending IS NOT NULL AND e.us >= r.busy AS due, CASE WHEN r.pending IS NOT NULL AND e.us >= r.busy THEN r.busy + e.d ELSE r.busy END AS free
            FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)),
    runs AS (SELECT key, own AS trigger_id, own_us AS started_us FROM r WHERE own IS NOT NULL UNION ALL SELECT key, late, late_us FROM r WHERE late IS NOT NULL
        UNION ALL SELECT key, arg_max(pending, n), arg_max(busy, n) FROM (SELECT key, n, coalesce(pending, -1) AS pending, busy FROM r) GROUP BY key HAVING arg_max(pending, n) >= 0)"""


def _triggers(e):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select((F.col("user_id") % 5).alias("key"), us.alias("us"), F.col("event_id").alias("trigger_id"), F.lit(20 * 60 * 1_000_000).cast("bigint").alias("duration_us"))


@query("coalesce_triggers", f"{_RUNS} SELECT * FROM runs")
def coalesce_triggers(t):
    """A run takes 20 minutes."""
    return tr.coalesce_triggers(_triggers(t.raw("events")))


@query("coalesce_stream", f"{_RUNS} SELECT * FROM runs WHERE started_us <= (SELECT max(us) // 1000 * 1000 FROM e)")
def coalesce_stream(t):
    """The same as a stream, up to its watermark: state and timers for each key."""
    return _run(t, tr.coalesce_stream(_triggers(_events(t))))


@query("backoff_stream", """WITH p AS (SELECT user_id AS source, event_id AS "at", event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT source, "at", n - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY source ORDER BY n), 0) AS failures FROM p)
    SELECT source, "at", CAST(failures AS INTEGER) AS failures, CAST(CASE WHEN failures = 0 THEN 0 ELSE least(15 * least(pow(2, failures), 32), 600) END AS INTEGER) AS wait_s FROM f""")
def backoff_stream(t):
    polls = _events(t).select(F.col("user_id").alias("source"), F.col("event_id").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return _run(t, tr.backoff_stream(polls))
