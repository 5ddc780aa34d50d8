"""Platform logs and deployments as files of JSON lines, made alike; batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import deploy_status, log_level

RAW = "id string, timestamp long, type string, message string, deploymentId string, proxy struct<path:string>"


def read(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RAW).json(path)


def normalized(raw: DataFrame, platform: str, since_ms: int = 0) -> DataFrame:
    """source, ts, level, message, deployment_id of the rows strictly after a time in milliseconds."""
    return raw.filter(F.col("timestamp") > since_ms).select(
        "id", F.lit(platform).alias("source"), F.timestamp_millis("timestamp").alias("ts"), log_level(platform, F.col("type")).alias("level"), F.coalesce("message", F.lit("")).alias("message"), F.col("deploymentId").alias("deployment_id")
    )


def deployments(raw: DataFrame, platform: str) -> DataFrame:
    """raw: uid, state, created (ms), ready (ms), commit_sha, branch."""
    return raw.select(
        F.lit(platform).alias("source"), F.col("uid").alias("deployment_id"), deploy_status(platform, F.col("state")).alias("status"), "branch", "commit_sha",
        F.timestamp_millis("created").alias("started_at"), F.timestamp_millis("ready").alias("completed_at"),
    )
