"""Connected components of a distributed graph, with aggregations and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

MAX_ROUNDS = 60
#: Edges of a file of an intermediate table.
PER_FILE = 200_000


def _files(edges: int) -> int:
    return edges // PER_FILE + 1


def _stars(edges: DataFrame, both: bool, files: int) -> tuple[DataFrame, DataFrame]:
    """Each node's neighbours (those above it, or all those not above it) tied to the least of them and the node itself; and
    the table of minima that this reads."""
    if both:
        e = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the minima are written, so that the join reads both sides afresh and can split a hub that holds many edges
    low = written(e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low", files)
    j = e.join(low, "a")
    if both:
        return j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), low
    kept = j.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(low.select("a", F.col("m").alias("b"))), low


def components(edges: DataFrame) -> DataFrame:
    """id and component, the least id reachable, of every node of the edges (a, b); ids are whole numbers, null edges count not.

    Large stars and small stars by turns: the edges of a component become a star around its least node in a number of rounds
    that grows with the logarithm of its size. Hubs are handled by partial minima and by joins that the engine may split.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, mark = e.count(), None
    for _ in range(MAX_ROUNDS if n else 0):
        stars, low1 = _stars(e, True, _files(n))
        large = written(stars.filter("a <> b").distinct(), "large", _files(n))
        stars, low2 = _stars(large, False, _files(n))
        new = written(stars.filter("a <> b").distinct(), "edges", _files(n))
        dropped(low1, low2, large, e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        n = now["n"]
        if now == mark or _is_stars(e):
            break
        mark = now
    else:
        if n:
            raise RuntimeError("components did not settle")
    nodes = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _is_stars(e: DataFrame) -> bool:
    """Whether no node has two edges downward, nor one at either side: then nothing is left to be done."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("v").agg(F.sum("down").alias("d"), F.max("up").alias("u")).filter("d > 1 or (d = 1 and u = 1)").isEmpty()


def roots(parents: DataFrame) -> DataFrame:
    """id and component of the nodes of a forest (id, parent), in which every id is there once and parents are below their ids.

    Pointers are doubled: each round halves the way that is left to the root.
    """
    p, files = written(parents.select("id", "parent"), "parents"), None
    for _ in range(MAX_ROUNDS):
        up = p.select(F.col("id").alias("parent"), F.col("parent").alias("over"))
        new = written(p.join(up, "parent", "left").select("id", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("moved")), "parents", files)
        moved, n = new.agg(F.max("moved"), F.count("*")).first()
        dropped(p)
        p, files = new, _files(n)
        if not moved:
            break
    else:
        raise RuntimeError("the parents form no forest")
    own = p.select("id", F.col("parent").alias("component"))
    return own.unionByName(p.select(F.col("parent").alias("id"), F.col("parent").alias("component")).distinct())
