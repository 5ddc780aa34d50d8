"""Log ingestion as a stream: level filter, enrichment, late data, duplicates, an exactly-once file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.frames import line_frame
from ..functions.text import at_least

#: How late a row may come.
LATENESS = "30 minutes"


def log_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000, pattern: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", pattern) if pattern else r).parquet(path)


def timed(logs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """ts as a timestamp with a watermark. The offset of the source and the watermark take the place of a polling cursor."""
    return logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def enriched(logs: DataFrame) -> DataFrame:
    """Errors without a file get the first frame that their message holds; a stateless map over its lines."""
    frames = F.filter(F.transform(F.split("message", "\n"), line_frame), lambda f: f.isNotNull())
    j = logs.withColumn("_f", F.when((F.col("level") == "error") & F.col("file_path").isNull(), F.get(frames, F.lit(0))))
    return j.withColumn("file_path", F.coalesce("file_path", "_f.file_path")).withColumn("line_number", F.coalesce("line_number", "_f.line_number")).withColumn("function_name", F.coalesce("function_name", "_f.function_name")).drop("_f")


def ingest(logs: DataFrame, threshold: str = "info", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """What is stored: rows of the level and above, on time, each once."""
    kept = timed(logs).filter(at_least(F.col("level"), threshold))
    return kept.dropDuplicatesWithinWatermark(list(keys))


def level_counts(logs: DataFrame, width: str = "1 day") -> DataFrame:
    """start, level, n by event time; rows later than the watermark allows are left out by the engine."""
    return timed(logs).groupBy(F.window("ts", width).alias("w"), "level").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "n")


def to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """An exactly-once file sink; by default it takes all there is and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
