"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document has the same expected number of copies, target / source size. Documents stand in order of
size, so that equal steps along the prefix sum take equally from short and long texts; a document is emitted once for each
integer between its own end of the prefix sum and its predecessor's, both moved by one random offset per source.

Defined cases: null or empty text has size 0; a null source is a source of its own, last in order; a source without words has
target 0 and takes nothing; repeated rows are documents of their own; a null doc_id is an id like any other; an empty table yields no rows; columns besides those used pass
through mix(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
#: Low bits of monotonically_increasing_id() that number the rows of a partition.
ROW_BITS = 33


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Targets are in proportion to the weights up to the level at which the capped sources and the rest together take
    share * all sizes. Sources are taken in order of the level at which they reach their cap; those below the level are
    capped. There is a row for each source here, whatever the number of documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    by_code_point = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy().orderBy("level", "n")
    t = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("n", F.row_number().over(by_code_point) - 1)
        .withColumn("w", w)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("w"))
        .withColumn("all", F.least(share * F.sum("source_size").over(every), F.sum("cap").over(every)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("reached", (F.col("all") - F.col("capped")) / F.col("left"))
        # the first source whose cap is not below the level that all later ones would share fixes that level
        .withColumn("final", F.min(F.when(F.col("level") >= F.col("reached"), F.struct("level", "n", "reached"))).over(every))
    )
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("final.reached") * F.col("w")), F.col("cap")).alias("target"))


def _sampled(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, carried: Sequence[Column] = ()) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, digest (of the text), and what is carried along.

    The rank of a document within its source comes from its place in a range partitioning, which splits a source of any
    size evenly, and the counts of the partitions before; no window holds more than one row per partition and source.
    """
    spark = docs.sparkSession
    # digest orders the rows of one doc_id
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("tie"), F.xxhash64("text").alias("digest"), *carried)
    more = sized.columns[5:]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("source", "size", "tie", "doc_id", "digest")
    placed = written(
        sized.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("doc_id", "source", "size", "digest", *more, F.monotonically_increasing_id().alias("place")),
        "mixing",
    ).withColumn("part", F.shiftright("place", ROW_BITS))
    w = Window.partitionBy("source").orderBy("part")
    starts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("place").alias("from"), F.sum("size").alias("size"))
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(starts.select("source", "size"), weights, share, most).withColumnRenamed("source", "s")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", F.col("part").alias("p"), "from", "before", "source_size", "target",
        F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)).alias("rate"),
    )
    ranked = placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["part"] == starts["p"])).withColumn(
        "rank", F.col("before") + F.col("place") - F.col("from")
    )
    offset = F.pmod(F.xxhash64(F.lit(seed), "s"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor((F.col("rank") + 1) * F.col("rate") + offset) - F.floor(F.col("rank") * F.col("rate") + offset)
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "digest", *more)


def sample_copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, digest (of the text). Texts are read and not moved."""
    return _sampled(docs, weights, share, most, seed)


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as its document is taken.

    Rows go through the range partitioning as wholes, so that each has its own rank, however many are equal to it.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    taken = _sampled(docs, weights, share, most, seed, [row]).filter("copies > 0")
    again = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_systematic_mix(spark, sf_dir: str) -> DataFrame:
    m = sample_copies(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
