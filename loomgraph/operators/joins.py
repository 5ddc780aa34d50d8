"""Joins that Spark has no name for: innermost interval, cascaded keys, ordered candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bin: a point meets the intervals of its own bin by equality.
BIN = 64


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """points with `name`, that of the shortest span of their keys that holds them (the earliest, then the least name, of several); null if none.

    Spans are listed under each bin of lines that they touch, so the join is on equality of key and bin, and one long file with
    many spans is spread over its bins. Equal places have one answer, so each is looked up once and joined back.
    """
    s = spans.select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(name).alias("_n"))
    s = s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / BIN), F.floor(F.greatest("_a", "_b") / BIN))))
    p = points.select(*keys, at).distinct().withColumn("_bin", F.floor(F.col(at) / BIN))
    hit = p.join(s, [*keys, "_bin"]).filter((F.col("_a") <= F.col(at)) & (F.col(at) <= F.col("_b")))
    best = hit.groupBy(*keys, at).agg(F.min(F.struct((F.col("_b") - F.col("_a")).alias("w"), "_a", "_n")).alias("m")).select(*keys, at, F.col("m._n").alias(name))
    return points.join(best, [*keys, at], "left")


def cascade(left: DataFrame, right: DataFrame, id_: str, keys: Sequence[Column], right_key: str, value: str) -> DataFrame:
    """id_, value, priority: of the first of the keys, tried in order, that right has; the least value of several.

    All keys go through one join: each left row is listed once for each key, with its priority.
    """
    tries = F.filter(F.array(*[F.struct(F.lit(i).alias("priority"), k.alias("_key")) for i, k in enumerate(keys, 1)]), lambda x: x["_key"].isNotNull())
    listed = left.select(id_, F.explode(tries).alias("t")).select(id_, "t.*")
    j = listed.join(right.select(F.col(right_key).alias("_key"), value), "_key")
    return j.groupBy(id_).agg(F.min(F.struct("priority", value)).alias("m")).select(id_, F.col(f"m.{value}").alias(value), F.col("m.priority").alias("priority"))


def first_candidate(left: DataFrame, id_: str, candidates: Column, inventory: DataFrame, path: str) -> DataFrame:
    """id_, resolved_path, probe: the first of an array of candidate paths that the inventory holds, and its place (from 0)."""
    listed = left.select(id_, F.posexplode(candidates).alias("probe", "_c"))
    j = listed.join(inventory.select(F.col(path).alias("_c")).distinct(), "_c")
    return j.groupBy(id_).agg(F.min(F.struct("probe", "_c")).alias("m")).select(id_, F.col("m._c").alias("resolved_path"), F.col("m.probe").alias("probe"))
