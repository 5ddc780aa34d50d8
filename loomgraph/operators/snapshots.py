"""Metrics of functions by the hour, stored once and merged to days, weeks and whole periods; what a change would touch.

A snapshot has counts and a quantile sketch of durations (KLL). Counts of merged snapshots are those of the logs; a quantile is exact for up to some 200 durations, and
beyond that its rank is off by about 1.5 % at most, however often sketches were merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a snapshot counts.
COUNTS = ("invocations", "warnings", "errors")
QUANTILES = (0.5, 0.95, 0.99)


def snapshots(logs: DataFrame, by: Sequence[str] = ("function_name",)) -> DataFrame:
    """by, at (hour), invocations, warnings, errors, latency (sketch, null without durations), last_error_at, last_at of logs (ts, level, duration). Rows without a time count nowhere."""
    level = lambda word: F.count_if(F.col("level") == word)
    timed = F.count("duration")
    g = logs.filter("ts is not null").groupBy(*by, F.date_trunc("hour", "ts").alias("at")).agg(
        F.count("*").alias("invocations"), level("warn").alias("warnings"), level("error").alias("errors"), timed.alias("_timed"),
        F.kll_sketch_agg_double("duration").alias("_latency"), F.max(F.when(F.col("level") == "error", F.col("ts"))).alias("last_error_at"), F.max("ts").alias("last_at"),
    )
    return g.select(*by, "at", *COUNTS, F.when(F.col("_timed") > 0, F.col("_latency")).alias("latency"), "last_error_at", "last_at")


def merged(hours: DataFrame, unit: str | None, by: Sequence[str] = ("function_name",)) -> DataFrame:
    """Snapshots of a longer unit (day, week, month), or of all time with unit None, from those of a shorter one. Logs are not read again."""
    at = [F.date_trunc(unit, "at").alias("at")] if unit else []
    g = hours.groupBy(*by, *at).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.kll_merge_agg_double("latency").alias("_latency"), F.count("latency").alias("_with"), F.max("last_error_at").alias("last_error_at"), F.max("last_at").alias("last_at")
    )
    return g.select(*by, *(["at"] if unit else []), *COUNTS, F.when(F.col("_with") > 0, F.col("_latency")).alias("latency"), "last_error_at", "last_at")


def with_rates(snaps: DataFrame) -> DataFrame:
    """Snapshots with error_rate and quantiles p50, p95, p99 (null without durations) instead of the sketch."""
    q = [F.when(F.col("latency").isNotNull(), F.kll_sketch_get_quantile_double("latency", F.lit(p))).alias(f"p{round(p * 100)}") for p in QUANTILES]
    rest = [c for c in snaps.columns if c != "latency"]
    return snaps.select(*rest, F.round(F.col("errors") / F.col("invocations"), 6).alias("error_rate"), *q)


def trend(hours: DataFrame, metric: str, unit: str = "day", since: Column | None = None, by: Sequence[str] = ("function_name",)) -> DataFrame:
    """by, at, value, change: a metric (invocations, errors, error_rate, p50, p95, p99) by hour or longer, and its change against the time before that has any."""
    from pyspark.sql import Window

    some = hours if since is None else hours.filter(F.col("at") >= since)
    rows = with_rates(some if unit == "hour" else merged(some, unit, by))
    w = Window.partitionBy(*by).orderBy("at")
    return rows.select(*by, "at", F.col(metric).cast("double").alias("value")).withColumn("change", F.col("value") - F.lag("value").over(w))


def degraded(metrics: DataFrame, regressions: DataFrame, least: str | None = None, by: str = "function_name") -> DataFrame:
    """Functions with regressions (by, kind, severity): by, kinds, worst, invocations, error_rate, of that severity or worse."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    g = regressions.withColumn("_rank", rank).groupBy(by).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max(F.struct("_rank", "severity")).alias("_worst"))
    g = g.filter(F.col("_worst._rank") >= {None: 0, "info": 0, "warning": 1, "critical": 2}[least])
    return g.join(metrics.select(by, "invocations", "error_rate"), by).select(by, "kinds", F.col("_worst.severity").alias("worst"), "invocations", "error_rate")


def change_risk(targets: DataFrame, snaps: DataFrame, tiers: DataFrame, regressions: DataFrame, by: str = "function_name") -> DataFrame:
    """Each target (by) with its invocations, error_rate, p95, tier (by, tier), number of regressions and risk: high if it is hot, critical or degraded, or has a critical
    regression; medium if it is warm or has another; none if it was never called; else low. Branches are aggregated before they are joined."""
    of = with_rates(merged(snaps, None, [by])).select(by, "invocations", "error_rate", "p95")
    r = regressions.groupBy(by).agg(F.count("*").alias("regressions"), F.max(F.col("severity") == "critical").alias("_critical"))
    j = targets.select(by).distinct().join(of, by, "left").join(tiers.select(by, "tier"), by, "left").join(r, by, "left")
    n = F.coalesce("regressions", F.lit(0))
    risk = (
        F.when(F.col("invocations").isNull(), "none").when(F.col("tier").isin("critical", "hot", "degraded") | F.coalesce("_critical", F.lit(False)), "high")
        .when((F.col("tier") == "warm") | (n > 0), "medium").otherwise("low")
    )
    return j.select(by, F.coalesce("invocations", F.lit(0)).alias("invocations"), "error_rate", "p95", "tier", n.alias("regressions"), risk.alias("risk"))
