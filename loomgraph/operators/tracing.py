"""From an error's trace to the function that raised it, to its callers, data flows and the logs around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import top_frames
from .joins import innermost
from .logs import nearby


def trace_errors(errors: DataFrame, logs: DataFrame, symbols: DataFrame, calls: DataFrame, flows: DataFrame, seconds: int = 60) -> DataFrame:
    """id, format, file_path, line_number, sym_id, callers, flows_in, flows_out, nearby of every error (id, repo_id, ts, trace).

    The trace's first frame that is no library's is looked up: the innermost function or class at its place. What is counted for a function is counted once,
    and then joined to the errors. An error without a frame, or a frame without a function, has null there and no callers or flows.
    """
    at = errors.select("id").join(top_frames(errors, "id", "trace"), "id", "left")
    spans = symbols.filter(F.col("kind").isin("function", "class")).select("file_path", "start_line", "end_line", "sym_id")
    placed = innermost(at.select("id", "format", "file_path", "line_number"), spans, ["file_path"], "line_number", "start_line", "end_line", "sym_id")

    def count(edges: DataFrame, by: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(by).alias("sym_id")).agg(F.count("*").alias(name))

    callers = calls.select("caller", F.col("callee").alias("sym_id")).distinct().groupBy("sym_id").agg(F.count("*").alias("callers"))
    out = placed.join(callers, "sym_id", "left").join(count(flows, "sink_fn", "flows_in"), "sym_id", "left").join(count(flows, "source_fn", "flows_out"), "sym_id", "left")
    around = nearby(logs, errors, seconds).groupBy(F.col("anchor").alias("id")).agg(F.count("*").alias("nearby"))
    out = out.join(around, "id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "flows_in", "flows_out", "nearby")]
    return out.select("id", "format", "file_path", "line_number", "sym_id", *counts)
