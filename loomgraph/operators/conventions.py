"""Conventions of code: naming cases, recency-weighted votes, function lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cases, tried in order.
CASES = (("SCREAMING_SNAKE", r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"), ("snake_case", r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"), ("kebab-case", r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$"),
         ("PascalCase", r"^[A-Z][a-zA-Z0-9]*$"), ("camelCase", r"^[a-z][a-zA-Z0-9]*$"))


def naming_case(name: Column) -> Column:
    out = F.lit("other")
    for case, pattern in reversed(CASES):
        out = F.when(name.rlike(pattern), case).otherwise(out)
    return out


def dominant(names: DataFrame, scope: str, name: str, least: float = 0.6) -> DataFrame:
    """scope, pattern, adoption, n: the most common case of a scope, if at least that share of its names keeps it."""
    g = names.groupBy(scope, naming_case(F.col(name)).alias("pattern")).agg(F.count("*").alias("n"))
    top = g.groupBy(scope).agg(F.max(F.struct("n", "pattern")).alias("m"), F.sum("n").alias("total"))
    out = top.select(scope, F.col("m.pattern").alias("pattern"), F.round(F.col("m.n") / F.col("total"), 6).alias("adoption"), F.col("total").alias("n"))
    return out.filter(F.col("adoption") >= least)


def outliers(names: DataFrame, conventions: DataFrame, scope: str, name: str) -> DataFrame:
    """names that do not keep the convention of their scope."""
    c = conventions.select(scope, F.col("pattern").alias("expected"))
    return names.join(c, scope).withColumn("pattern", naming_case(F.col(name))).filter("pattern <> expected")


def recency_votes(rows: DataFrame, scope: str, pattern: str, age_days: Column, half_life: float = 180.0) -> DataFrame:
    """scope, pattern, weight: votes that halve with every half-life of age, and the share of the scope's weight."""
    g = rows.withColumn("_w", F.exp(-0.693 * age_days / half_life)).groupBy(scope, pattern).agg(F.sum("_w").alias("weight"))
    return g.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(scope)))


def length_stats(symbols: DataFrame, scope: str) -> DataFrame:
    """scope, n, mean, p95 of the lengths of its functions, and how many are longer than the p95."""
    length = (F.col("end_line") - F.col("start_line") + 1).cast("double")
    f = symbols.filter("kind = 'function'").select(scope, length.alias("length"))
    g = f.groupBy(scope).agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean"), F.round(F.percentile("length", 0.95), 6).alias("p95"))
    over = f.join(g, scope).groupBy(scope).agg(F.count_if(F.col("length") > F.col("p95")).alias("outliers"))
    return g.join(over, scope)
