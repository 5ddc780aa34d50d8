"""Log and deployment operators: reading, counting, enriching, relating logs to deployments and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.frames import top_frames
from ..plans.temporal import at_time


def optional(column: str, value: str | None) -> Column:
    """Equality, or no condition for null and `all`."""
    return F.lit(True) if value in (None, "all") else F.col(column) == value


def recent(logs: DataFrame, as_of: str, minutes: int, source: str | None = None, level: str | None = None, most: int = 50) -> DataFrame:
    since = at_time(logs, "ts", as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    found = logs.filter((F.col("ts") >= since) & (F.col("ts") <= at_time(logs, "ts", as_of)) & optional("source", source) & optional("level", level))
    return found.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def page(logs: DataFrame, number: int, size: int) -> DataFrame:
    """The number-th page (from 1), newest first; size is held between 1 and 200. Each row carries the number of all rows."""
    size = max(1, min(200, size))
    total = logs.agg(F.count("*").alias("total"))
    return logs.orderBy(F.desc("ts"), F.desc("id")).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def level_stats(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("total"), *[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("info", "warn", "error")])


def source_stats(logs: DataFrame) -> DataFrame:
    return logs.groupBy("source").agg(F.count("*").alias("n"))


def deployment_history(deployments: DataFrame, logs: DataFrame, most: int = 10) -> DataFrame:
    """The newest deployments with their numbers of errors and warnings; only their logs are counted."""
    d = deployments.orderBy(F.desc("started_at"), "deployment_id").limit(most)
    counts = logs.join(F.broadcast(d.select("deployment_id")), "deployment_id", "left_semi").groupBy("deployment_id").agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings")
    )
    j = d.join(counts, "deployment_id", "left")
    return j.select("deployment_id", "started_at", "status", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def deploy_errors(deployments: DataFrame, logs: DataFrame, last: int = 1) -> DataFrame:
    """Errors of the newest `last` deployments."""
    d = deployments.orderBy(F.desc("started_at"), "deployment_id").limit(last).select("deployment_id")
    return logs.filter("level = 'error'").join(F.broadcast(d), "deployment_id", "left_semi")


def nearby(logs: DataFrame, anchors: DataFrame, seconds: int = 60, most: int | None = None) -> DataFrame:
    """anchor, id, gap: logs of the same repository within so many seconds of an anchor (id, repo_id, ts), itself excluded.

    Time is cut into buckets of that length; an anchor meets its own bucket and both neighbours by equality, so a busy
    repository is spread over its buckets. most: the first so many of an anchor, by time.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    a = anchors.select(F.col("id").alias("anchor"), "repo_id", at("ts").alias("_t"))
    a = a.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.floor(F.col("_t") / width) + x)))
    b = logs.select("id", "repo_id", at("ts").alias("_u")).withColumn("_b", F.floor(F.col("_u") / width))
    j = a.join(b, ["repo_id", "_b"]).filter((F.abs(F.col("_t") - F.col("_u")) <= width) & (F.col("anchor") != F.col("id")))
    out = j.select("anchor", "id", (F.col("_u") - F.col("_t")).alias("gap_us"))
    if most is None:
        return out
    w = Window.partitionBy("anchor").orderBy("gap_us", "id")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def enrich(logs: DataFrame) -> DataFrame:
    """Errors without a file get the place of the top frame of their trace, or of their message if that holds frames."""
    bare = logs.filter("level = 'error' and file_path is null").select("id", F.coalesce("stack_trace", "message").alias("_trace"))
    top = top_frames(bare, "id", "_trace").select("id", F.col("file_path").alias("_f"), F.col("line_number").alias("_l"), F.col("function_name").alias("_n"))
    j = logs.join(top, "id", "left")
    filled = {"file_path": F.coalesce("file_path", "_f"), "line_number": F.coalesce("line_number", "_l"), "function_name": F.coalesce("function_name", "_n")}
    return j.select(*[filled.get(c, F.col(c)).alias(c) for c in logs.columns])


def collector_health(sources: DataFrame, as_of: str) -> DataFrame:
    """sources with state: disabled, never polled, stale (three intervals missed) or fresh. interval_s, last_poll_at, enabled."""
    minutes = (F.unix_micros(at_time(sources, "last_poll_at", as_of).cast("timestamp")) - F.unix_micros(F.col("last_poll_at").cast("timestamp"))) / 60e6
    state = F.when(~F.col("enabled"), "disabled").when(F.col("last_poll_at").isNull(), "never polled").when(minutes > 3 * F.col("interval_s") / 60, "stale").otherwise("fresh")
    return sources.withColumn("state", state)


def first_deploys(deployments: DataFrame, digested: DataFrame) -> DataFrame:
    """The first successful deployment of each commit that is not digested yet."""
    ok = deployments.filter("status = 'ready'").join(digested.select("commit_sha"), "commit_sha", "left_anti")
    return ok.groupBy("commit_sha").agg(F.min(F.struct("started_at", "deployment_id")).alias("f")).select("commit_sha", "f.*")


def dedupe(logs: DataFrame, *keys: str) -> DataFrame:
    """The first row (least id) of each group of equal keys."""
    rest = [c for c in logs.columns if c not in keys]
    return logs.groupBy(*keys).agg(F.min_by(F.struct(*rest), "id").alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in logs.columns])


def stuck_jobs(jobs: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    late = F.col("started_at") < at_time(jobs, "started_at", as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return jobs.withColumn("status", F.when((F.col("status") == "running") & late, "failed").otherwise(F.col("status")))


def normalized(raw: DataFrame, platform: str) -> DataFrame:
    """A platform's raw logs (ts, word, message, ...) with the common level names."""
    return raw.withColumn("source", F.lit(platform)).withColumn("level", fx.log_level(platform, F.col("word")))
