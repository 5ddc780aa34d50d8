"""Calls from occurrences, and data-flow findings as edges between functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_rank
from ..operators.joins import innermost
from ..storage import last_by

#: Bits of an occurrence's roles.
DEFINITION, IMPORT, WRITE, READ = 1, 2, 4, 8


def derive_calls(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """caller, callee, line: distinct calls from the innermost function that holds an occurrence to the function or class it names.

    occurrences: file_id, line, target. Calls of a function by itself do not count.
    """
    callable_ = symbols.filter(F.col("kind").isin("function", "class"))
    spans = callable_.filter("kind = 'function'").select("file_id", "start_line", "end_line", F.col("sym_id").alias("caller"))
    inside = innermost(occurrences, spans, ["file_id"], "line", "start_line", "end_line", "caller").filter("caller is not null")
    known = inside.join(callable_.select(F.col("sym_id").alias("target")), "target", "left_semi")
    return known.filter("caller <> target").select("caller", F.col("target").alias("callee"), "line").distinct()


def collapse_calls(calls: DataFrame, order: str) -> DataFrame:
    """One edge for each caller and callee, with the line of the last call."""
    return last_by(calls, ["caller", "callee"], F.col(order))


def match_findings(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """findings with source_fn and sink_fn, the innermost functions, and match: complete, partial or none."""
    fn = symbols.filter("kind = 'function'").select("file_id", "start_line", "end_line", F.col("sym_id").alias("fn"))
    out = findings
    for end in ("source", "sink"):
        spans = fn.select(F.col("file_id").alias(f"{end}_file"), "start_line", "end_line", F.col("fn").alias(f"{end}_fn"))
        out = innermost(out, spans, [f"{end}_file"], f"{end}_line", "start_line", "end_line", f"{end}_fn")
    both = F.col("source_fn").isNotNull().cast("int") + F.col("sink_fn").isNotNull().cast("int")
    return out.withColumn("match", F.when(both == 2, "complete").when(both == 1, "partial").otherwise("none"))


def flow_edges(matched: DataFrame) -> DataFrame:
    """source_fn, sink_fn, query_id, finding_id, severity: the last complete finding of each flow."""
    return last_by(matched.filter("match = 'complete'").select("source_fn", "sink_fn", "query_id", "finding_id", "severity"), ["source_fn", "sink_fn", "query_id"], F.col("finding_id"))


def trace(edges: DataFrame, start: DataFrame, most: int = 25) -> DataFrame:
    """direction, fn, other, query_id: flows from and to the start functions (fn), at most so many in each direction."""
    parts = []
    for direction, own, other in (("down", "source_fn", "sink_fn"), ("up", "sink_fn", "source_fn")):
        j = edges.join(start.select(F.col("fn").alias(own)), own, "left_semi").select(F.lit(direction).alias("direction"), F.col(own).alias("fn"), F.col(other).alias("other"), "query_id")
        parts.append(j.orderBy("fn", "other", "query_id").limit(most))
    return parts[0].unionByName(parts[1])


def listed(findings: DataFrame, most: int = 50, condition: Column | None = None) -> DataFrame:
    """Findings in order of severity."""
    f = findings if condition is None else findings.filter(condition)
    return f.orderBy(severity_rank(F.col("severity")), "query_id", "finding_id").limit(max(1, min(200, most)))


def dedupe_findings(findings: DataFrame, *keys: str) -> DataFrame:
    """The first finding of each place."""
    rest = [c for c in findings.columns if c not in keys]
    return findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), "finding_id").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def arity_mismatch(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (callee, arg_expressions) whose number of arguments is not that of the callee's parameters."""
    j = calls.join(symbols.select(F.col("sym_id").alias("callee"), "param_types"), "callee")
    return j.withColumn("has_type_mismatch", F.size("arg_expressions") != F.size("param_types")).withColumn(
        "type_mismatch_detail", F.when(F.col("has_type_mismatch"), F.concat(F.lit("expected "), F.size("param_types"), F.lit(" arguments, got "), F.size("arg_expressions")))
    )
