"""Written intermediate tables, keyed upserts, and replacing a table that is being read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a new local one only where it is unset and all tasks run in this process, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def written(df: DataFrame, what: str = "t") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "scratch", None):
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a task that holds them, or what is distinct of them, in memory.
ROWS = 1 << 18


def tasks(rows: int, each: int = ROWS) -> int:
    """How many tasks that many rows make, of `each` at most on average. Given to repartition, adaptive execution leaves the number: it would join small
    partitions up to a size in bytes, some ten million rows of two numbers, so that the memory of a task would grow with the input."""
    return max(1, -(-rows // each))


def last_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the last in the given total order, by an aggregation that combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new, and those of old whose key new does not have. new has one row for each key."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns)


def retained(df: DataFrame, ts: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows not older than `days` before as_of; on a table partitioned by date this prunes whole partitions."""
    return df.filter(F.col(ts) >= F.lit(as_of).cast(df.schema[ts].dataType) - F.expr(f"INTERVAL {int(days)} DAYS"))


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df, which may read path itself, to a staging folder beside it, then put that in its place.

    Parquet folders have no MERGE; the new state is whole before the old one goes.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staged)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    to, at = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    fs = to.getFileSystem(conf)
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(to):
        fs.rename(to, old)
    fs.rename(at, to)
    fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order (columns with their own asc or desc)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
