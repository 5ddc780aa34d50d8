"""Parts of a key's events that cannot affect each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spells(events: DataFrame, pause: int) -> DataFrame:
    """events (key, us and more) with spell: a number, the same for events of a key between which there is no pause of that many microseconds.

    Events of one time bucket of that width have no such pause between them: the pauses are found between the buckets' ends, which are
    aggregated before they are shuffled, and only those pass a window by key.
    """
    pause = max(int(pause), 1)
    t = events.withColumn("_b", F.expr(f"us div {pause}"))
    w = Window.partitionBy("key").orderBy("_b")
    ends = t.groupBy("key", "_b").agg(F.min("us").alias("_from"), F.max("us").alias("_to"))
    cut = ends.withColumn("_cut", F.coalesce(F.col("_from") - F.lag("_to").over(w) >= pause, F.lit(True)).cast("bigint"))
    named = cut.select(F.col("key").alias("_k"), F.col("_b").alias("_c"), F.sum("_cut").over(w).alias("spell"))
    return t.join(named, F.col("key").eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c"))).drop("_b", "_k", "_c")
