"""Complexity and runtime metrics, heat tiers, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.temporal import at_time


def complexity(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, metric_name, metric_value in long form. Files without imports, importers or symbols have no row of these;
    coupling_score, imports and importers together, is 0 then."""
    out = imports.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("import_count"))
    inn = imports.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("reverse_import_count"))
    sym = symbols.groupBy("file_id").agg(F.count("*").alias("symbol_count"))
    wide = out.join(inn, "file_id", "full_outer").join(sym, "file_id", "full_outer")
    wide = wide.withColumn("coupling_score", F.coalesce("import_count", F.lit(0)) + F.coalesce("reverse_import_count", F.lit(0)))
    long = wide.unpivot("file_id", ["import_count", "reverse_import_count", "symbol_count", "coupling_score"], "metric_name", "metric_value")
    return long.filter("metric_value is not null")


def digest_delta(jobs: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """keys, ordinal, stat, delta: what changed against the previous completed run, zeros left out."""
    w = Window.partitionBy(*keys).orderBy("ordinal")
    d = jobs.filter("status = 'completed'").select(*keys, "ordinal", *[(F.col(s) - F.coalesce(F.lag(s).over(w), F.lit(0))).alias(s) for s in stats])
    return d.unpivot([*keys, "ordinal"], list(stats), "stat", "delta").filter("delta <> 0")


def rolling(logs: DataFrame, as_of: str, windows: dict[str, int], by: str = "function_name") -> DataFrame:
    """by, window, counts, error rate, latency percentiles and last times over windows (name to hours) that end at as_of.

    Each row is listed once for each window that holds it, so all windows take one pass and one shuffle.
    """
    end = at_time(logs, "ts", as_of)
    held = F.array_compact(F.array(*[F.when(F.col("ts") >= end - F.expr(f"INTERVAL {int(h)} HOURS"), F.lit(n)) for n, h in windows.items()]))
    rows = logs.filter((F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"INTERVAL {max(windows.values())} HOURS"))).withColumn("window", F.explode(held))
    error = F.col("level") == "error"
    g = rows.groupBy(by, "window").agg(
        F.count("*").alias("invocations"), F.count_if(error).alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"),
        *[F.percentile("duration", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)],
        F.max_by(F.when(error, F.col("message")), F.when(error, F.struct("ts", "id"))).alias("last_error"), F.max("ts").alias("last_invocation"),
    )
    return g.withColumn("error_rate", F.round(F.col("errors") / F.col("invocations"), 6))


def regressions(metrics: DataFrame, recent: str, base: str, by: str = "function_name") -> DataFrame:
    """by and kind, severity of each rule that a function's recent window breaks against its base window."""
    cols = ["invocations", "errors", "error_rate", "p95"]
    r = metrics.filter(F.col("window") == recent).select(by, *[F.col(c).alias(f"r_{c}") for c in cols])
    b = metrics.filter(F.col("window") == base).select(by, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = b.join(r, by, "left")
    rate, was, p, q = F.col("r_error_rate"), F.col("b_error_rate"), F.col("r_p95"), F.col("b_p95")
    rules = [
        F.when((rate > 5 * was) | (rate > 0.10), F.struct(F.lit("error_rate").alias("kind"), F.lit("critical").alias("severity"))).when((rate > 2 * was) & (rate - was > 0.01), F.struct(F.lit("error_rate").alias("kind"), F.lit("warning").alias("severity"))),
        F.when((p > 5 * q) | (p > 5000), F.struct(F.lit("latency").alias("kind"), F.lit("critical").alias("severity"))).when((p > 2 * q) & (p > 200), F.struct(F.lit("latency").alias("kind"), F.lit("warning").alias("severity"))),
        F.when((F.col("r_errors") > 0) & (F.col("b_errors") == F.col("r_errors")), F.struct(F.lit("new_errors").alias("kind"), F.lit("warning").alias("severity"))),
        F.when(F.coalesce("r_invocations", F.lit(0)) < 0.1 * F.col("b_invocations"), F.struct(F.lit("traffic_drop").alias("kind"), F.lit("warning").alias("severity"))),
    ]
    return j.select(by, F.explode(F.array_compact(F.array(*rules))).alias("x")).select(by, "x.*")


def heat_tiers(metrics: DataFrame, by: str = "function_name", slices: str = "invocations") -> DataFrame:
    """by, invocations, tier by the share of functions that are called more often.

    Numbers of calls are counted first, so the order that the shares come from has a row for each distinct number and not for
    each function.
    """
    w = Window.orderBy(F.desc(slices))
    distinct = metrics.groupBy(slices).agg(F.count("*").alias("n"))
    ranked = distinct.withColumn("above", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = distinct.agg(F.sum("n").alias("total"))
    share = ranked.crossJoin(F.broadcast(total)).select(slices, (F.col("above") / F.col("total")).alias("share"))
    j = metrics.join(share, slices)
    tier = (
        F.when(F.col(slices) == 0, "dead").when(F.col("error_rate") >= 0.25, "degraded").when((F.col("share") < 0.05) & (F.col("error_rate") < 0.01), "critical")
        .when(F.col("share") < 0.2, "hot").when(F.col("share") < 0.6, "warm").otherwise("cold")
    )
    return j.select(by, slices, tier.alias("tier"))


def resolved(cycles: DataFrame, by: str, ordinal: str, value: str, base: str, factor: float = 1.5) -> DataFrame:
    """cycles with resolved: this and the cycle before are both within `factor` of the base."""
    ok = F.col(value) <= factor * F.col(base)
    w = Window.partitionBy(by).orderBy(ordinal)
    return cycles.withColumn("resolved", F.coalesce(ok & F.lag(ok).over(w), F.lit(False)))


def hourly(logs: DataFrame) -> DataFrame:
    """day, hour, n, errors of all functions together; with day totals (hour null) and the grand total (both null) by rollup."""
    day, hour = F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("hour")
    return logs.select(day, hour, "level").rollup("day", "hour").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("errors"))


def last_before(moments: DataFrame, at: str, marks: DataFrame, mark_at: str, name: str) -> DataFrame:
    """moments with the column `name` of the last of the marks at or before the moment, null if there is none before; however long ago it was.

    As of a moment, within its month, by the last value that is not null; before the month's first mark, by the last mark of the months before, of
    which there is one row each.
    """
    month = lambda c: F.date_trunc("month", F.col(c))
    rest = [c for c in moments.columns if c != name]
    row = F.struct(*rest)
    m = marks.select(month(mark_at).alias("_month"), F.col(mark_at).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(mark_at).alias("at"), F.col(name).alias("v")).alias("_mark"))
    by_month = m.groupBy("_month").agg(F.max("_mark").alias("_last"))
    order = Window.orderBy("_month")
    asked = moments.select(month(at).alias("_month")).distinct()
    months = asked.unionByName(by_month.select("_month")).distinct().join(by_month, "_month", "left")
    carried = months.select("_month", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    both = m.withColumn("_row", F.lit(None).cast(moments.select(row.alias("r")).schema["r"].dataType)).unionByName(
        moments.select(month(at).alias("_month"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(m.schema["_mark"].dataType).alias("_mark"), row.alias("_row"))
    )
    w = Window.partitionBy("_month").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_own", F.last("_mark", ignorenulls=True).over(w)).filter("_kind = 1").join(carried, "_month", "left")
    return held.select("_row.*", F.coalesce("_own.v", "_carried.v").alias(name))
