"""Stored snapshots against the logs that they were made of."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loomgraph.operators import snapshots as sn

LOGS = "function_name string, ts timestamp_ntz, level string, duration double"
START = dt.datetime(2024, 1, 1)


def test_quantiles_of_many_durations(spark):
    """Some 60,000 durations over 30 days, merged twice: counts exact, ranks within 1.5 %."""
    df = spark.range(60_000).select(
        F.lit("f").alias("function_name"), (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 43).cast("decimal(18,6)"))).alias("ts"),
        F.when(F.col("id") % 10 == 0, "error").otherwise("info").alias("level"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("duration"),
    )
    r = sn.with_rates(sn.merged(sn.merged(sn.snapshots(df), "day"), None)).first()
    assert (r.invocations, r.errors, r.warnings, r.error_rate) == (60_000, 6_000, 0, 0.1)
    for p, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
        assert abs(df.filter(F.col("duration") <= got).count() / 60_000 - p) < 0.015


def test_few_durations_are_exact(spark):
    rng = random.Random(1)
    rows = [(f"f{i % 3}", START + dt.timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.choice(["info", "warn", "error"]), rng.random() * 100) for i in range(450)]
    df = spark.createDataFrame(rows, LOGS)
    got = {r.function_name: r for r in sn.with_rates(sn.merged(sn.snapshots(df), None)).collect()}
    for f in ("f0", "f1", "f2"):
        d = sorted(r[3] for r in rows if r[0] == f)
        assert got[f].p50 == d[74] and got[f].p95 == d[142] and got[f].last_at == max(r[1] for r in rows if r[0] == f)
        assert got[f].last_error_at == max(r[1] for r in rows if r[0] == f and r[2] == "error")


def test_odd_rows(spark):
    rows = [("a", START, None, None), (None, START, "error", 5.0), ("a", None, "error", 1.0), ("b", START, "info", None)]
    hours = sn.snapshots(spark.createDataFrame(rows, LOGS))
    got = {r.function_name: (r.invocations, r.errors, r.p95) for r in sn.with_rates(hours).collect()}
    assert got == {"a": (1, 0, None), None: (1, 1, 5.0), "b": (1, 0, None)}
    assert {r.function_name: r.p95 for r in sn.with_rates(sn.merged(hours, "week")).collect()} == {"a": None, None: 5.0, "b": None}
    assert sn.merged(hours.limit(0), "day").count() == 0


def test_trend_by_hour_and_risk(spark):
    rows = [("a", START + dt.timedelta(hours=h), "error" if h == 2 else "info", float(h)) for h in (0, 1, 2, 2, 30)]
    hours = sn.snapshots(spark.createDataFrame(rows, LOGS))
    assert [(r.value, r.change) for r in sn.trend(hours, "errors", "hour").orderBy("at").collect()] == [(0, None), (0, 0), (2, 2), (0, -2)]
    assert [(r.value, r.change) for r in sn.trend(hours, "invocations", "day").orderBy("at").collect()] == [(4, None), (1, -3)]
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "function_name string")
    tiers = spark.createDataFrame([("a", "cold")], "function_name string, tier string")
    bad = lambda s: spark.createDataFrame([("a", "latency", s)], "function_name string, kind string, severity string")
    for severity, risk in (("critical", "high"), ("warning", "medium")):
        assert {r.function_name: r.risk for r in sn.change_risk(names("a", "a", "z"), hours, tiers, bad(severity)).collect()} == {"a": risk, "z": "none"}
    assert sn.change_risk(names("a"), hours, tiers, bad("x").limit(0)).first().risk == "low"
