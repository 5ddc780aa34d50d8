"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "loomgraph", **conf: str) -> SparkSession:
    """The running session, or a new one; conf overrides CONF. Master, memory and shuffle partitions are the cluster's to set."""
    b = SparkSession.builder.appName(app)
    for k, v in (CONF | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
