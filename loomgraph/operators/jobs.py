"""Jobs: how to digest, merged reports, refused submissions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spells import spells

#: Changed files beyond which a digest starts afresh.
MOST_CHANGED = 500


def digest_mode(changes: DataFrame, most: int = MOST_CHANGED) -> DataFrame:
    """changes (changed, known) with mode: full for what is not known or has changed too much, none without a change, else incremental."""
    mode = F.when(~F.col("known"), "full").when(F.col("changed") == 0, "none").when(F.col("changed") > most, "full").otherwise("incremental")
    return changes.withColumn("mode", mode)


def merge_stats(reports: DataFrame) -> DataFrame:
    """job_id and stats, a map, of reports (job_id, at, stats): the last value of each key counts, by aggregation with partial results."""
    each = reports.select("job_id", "at", F.explode("stats").alias("k", "v"))
    last = each.groupBy("job_id", "k").agg(F.max_by("v", "at").alias("v"))
    return last.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("stats"))


def refused(jobs: DataFrame, minutes: int = 10) -> DataFrame:
    """Jobs (job_id, repo_id, ts, status) submitted while an accepted one of their repository runs, which takes so many minutes from its start.

    What is refused never runs and refuses nothing itself; a job whose status is not running is over at once. Every decision depends on the
    last accepted job before: a fold in the order of ts and job_id, over busy spells, which no running job outlasts (see spells), with one number of state.
    Jobs without a time are never refused; those without a repository share one.
    """
    span = int(minutes) * 60_000_000
    own = jobs.select("job_id", "repo_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("status") == "running").alias("runs"))
    kind = lambda c: jobs.schema[c].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, busy = None, None
        for b in batches:
            turned_away = []
            for key, spell, us, runs in zip(*(b.column(c).to_pylist() for c in ("repo_id", "spell", "us", "runs"))):
                if (key, spell) != at:
                    at, busy = (key, spell), None
                no = busy is not None and us < busy
                if runs and not no:
                    busy = us + span
                turned_away.append(no)
            yield b.select(["job_id", "repo_id"]).filter(pa.array(turned_away, pa.bool_()))

    cut = spells(own.filter("us is not null").withColumnRenamed("repo_id", "key"), span).withColumnRenamed("key", "repo_id")
    n = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, "repo_id", "spell").sortWithinPartitions("repo_id", "spell", "us", "job_id").mapInArrow(fold, f"job_id {kind('job_id')}, repo_id {kind('repo_id')}")
