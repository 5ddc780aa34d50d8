"""Shared helpers: table reading, written intermediate tables, whole-text chunks for numpy."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from tempfile import mkdtemp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds, unless a single text is longer.
CHUNK_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a new one of our own only where that is unset and all tasks run in this process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "t", files: int | None = None) -> DataFrame:
    """df as a table in the shared folder: later reads do not compute it again, and a lost executor loses nothing of it.

    files: how many there are at most, where the rows are known to be few for the partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "scratch", None):
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or one made of it that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Remainders of hashed ids; a table with a row for each may be broadcast, as it has no more rows than these.
REMAINDERS = 1 << 20


def remainder(id_column: Column) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(REMAINDERS)).cast("int")


def possible(docs: DataFrame, ids: DataFrame, how: str = "left_semi", column: str = "doc_id") -> DataFrame:
    """Rows of docs that may (left_semi), or surely do not (left_anti), have one of the ids: a pass without a shuffle."""
    at = ids.select(remainder(F.col(column)).alias("r")).distinct()
    return docs.join(F.broadcast(at), remainder(docs[f"`{column}`"]) == at["r"], how)


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the ids. Only rows that may have one of them are shuffled."""
    gone = ids.select(F.col(column).alias(free_name(docs, "gone"))).distinct()
    some = possible(docs, ids, column=column)
    rest = some.join(gone, some[f"`{column}`"] == gone[gone.columns[0]], "left_anti")
    return possible(docs, ids, "left_anti", column).unionByName(rest)


def bucket(column: str, n: int):
    """crc32 of the value as text, modulo n: the split between learning and holding out."""
    return F.crc32(F.col(column).cast("string")) % n


def with_schema(df: DataFrame, ddl_columns: str, *replaced: str) -> str:
    """Schema text of df without the replaced columns, and ddl_columns after it."""
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in replaced]
    return ", ".join([*kept, ddl_columns])


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null reads as empty; a text is never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        lo, hi = offsets[at], offsets[end]
        yield at, end, raw[lo:hi], offsets[at : end + 1] - lo
        at = end


def give_back() -> None:
    """Freed memory goes back to the system: Spark keeps idle Python workers, and other stages need their memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving its memory back after a task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


#: Bytes of the batches in which rows go to Python workers and back, unless a single row is longer.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: a batch is held by the JVM and by the worker at the same time, and its usual bound is 64 MB."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(bound).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(bound, BATCH_BYTES)


def stratified(rows: DataFrame, by: str, most: int, on: str = "doc_id", seed: int = 0, weight: str | None = None) -> DataFrame:
    """About `most` rows, shared out evenly among the values of `by` and chosen by a hash of `on`; never over twice as many.

    For fitting on a bounded sample; the values of `by` are few (labels). weight: name of a column with how many rows each stands for.
    """
    n = {r[0]: r[1] for r in rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*")).collect()}
    each = most / max(1, len(n))
    u = F.pmod(F.xxhash64(F.lit(seed), on), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.lit(0.0)
    for value, count in n.items():
        share = F.when(F.col(by) == value, min(1.0, each / count)).otherwise(share)
    return (rows.withColumn(weight, 1 / F.greatest(share, F.lit(1e-12))) if weight else rows).filter(u < share).limit(2 * most)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, label, weight of about `most` labelled documents, written. labels: doc_id, label; rows without a label are not used.

    The sample is drawn from the labels alone, so that the broadcast side has 2 * most rows at the very most and no text is
    shuffled. Both labels have about as many rows in it; weight tells how many of the labelled a row stands for.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    some = stratified(known, "label", most, weight="weight")
    return written(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "sample")
