"""Analysis results in SARIF: nested JSON flattened to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCATION = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>,message:struct<text:string>>"
SCHEMA = f"""runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>,
    results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<{_LOCATION}>,
    codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_LOCATION}>>>>>>>>>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def _place(loc: Column) -> Column:
    p = loc["physicalLocation"]
    return F.when(p["artifactLocation"]["uri"].isNotNull(), F.struct(
        p["artifactLocation"]["uri"].alias("file"), F.coalesce(p["region"]["startLine"], F.lit(1)).alias("line"), p["region"]["startColumn"].alias("column"), F.coalesce(loc["message"]["text"], F.lit("")).alias("message"),
    ))


def findings(logs: DataFrame) -> DataFrame:
    """query_id, severity, message, source and sink places, path_steps: one for each query, source and sink.

    A flow of two steps or more runs from its first to its last; without one the result's own place is both ends. A result's level
    goes before its rule's; anything but error and warning is a note. The first of several wins, in the order of the file.
    """
    r = logs.select(F.posexplode("runs").alias("run", "r")).select("run", F.col("r.tool.driver.rules").alias("rules"), F.posexplode("r.results").alias("nth", "x"))
    steps = F.transform(F.get(F.get(F.col("x.codeFlows"), F.lit(0))["threadFlows"], F.lit(0))["locations"], lambda s: _place(s["location"]))
    own = _place(F.get(F.col("x.locations"), F.lit(0)))
    flow = F.coalesce(F.size(steps) >= 2, F.lit(False))
    rule = F.get(F.filter("rules", lambda k: k["id"] == F.col("x.ruleId")), F.lit(0))["defaultConfiguration"]["level"]
    level = F.coalesce("x.level", rule)
    f = r.select(
        "run", "nth", F.coalesce("x.ruleId", F.lit("unknown")).alias("query_id"), F.when(level.isin("error", "warning"), level).otherwise("note").alias("severity"),
        F.coalesce("x.message.text", F.lit("")).alias("message"), F.when(flow, F.get(steps, F.lit(0))).otherwise(own).alias("source"),
        F.when(flow, F.element_at(steps, -1)).otherwise(own).alias("sink"), F.when(flow, F.array_compact(steps)).otherwise(F.array(own)).alias("path_steps"),
    ).filter("source is not null and sink is not null")
    keys = ["query_id", "source_file", "source_line", "sink_file", "sink_line"]
    flat = f.select("run", "nth", "query_id", "severity", "message", F.col("source.file").alias("source_file"), F.col("source.line").alias("source_line"), F.col("sink.file").alias("sink_file"), F.col("sink.line").alias("sink_line"), "path_steps")
    return flat.groupBy(*keys).agg(F.min_by(F.struct("severity", "message", "path_steps"), F.struct("run", "nth")).alias("m")).select(*keys, "m.*")
