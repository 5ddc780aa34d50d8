"""Platforms as Spark data sources: `platform_logs`, batch and stream, and `platform_deployments`, batch.

Option sources: JSON, a list of sources, each with name, platform and what its adapter needs (see platforms). Option since: milliseconds, what lies at or before it is
not wanted. A stream's offset has a time for each source: a batch takes of every source the logs after its last offset, up to what its platform has complete when the
batch is planned. Spark keeps the offsets, so that a restart goes on where the last batch that was written ended, and a batch that is
run again reads the same times. A task reads one deployment of one source. A source that is added later begins at since.

Lines come as the platforms have them; levels and times are made alike by column functions (`logs`), not in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import STATUSES, deploy_status, log_level
from .platforms import platform

LOGS = "source string, platform string, project string, deployment_id string, id string, timestamp bigint, type string, message string, function_name string, metadata map<string,string>"
DEPLOYMENTS = "source string, platform string, deployment_id string, state string, created bigint, ready bigint, branch string, commit_sha string, url string"
#: Rows of an Arrow batch.
ROWS = 5000
_ARROW = pa.schema([(c, pa.string()) for c in ("source", "platform", "project", "deployment_id", "id")] + [("timestamp", pa.int64())] + [(c, pa.string()) for c in ("type", "message", "function_name")] + [("metadata", pa.map_(pa.string(), pa.string()))])


class Part(InputPartition):
    def __init__(self, source: dict[str, Any], deployment: str, since: int, until: int):
        self.source, self.deployment, self.since, self.until = source, deployment, since, until


def _sources(options: dict[str, str]) -> list[dict[str, Any]]:
    found = json.loads(options.get("sources", "[]"))
    names = [s.get("name") for s in found]
    if not found or None in names or len({*names}) < len(names):
        raise ValueError("option sources must be a JSON list of sources with a name each, none twice")
    for s in found:
        platform(s)  # names an unknown platform before any work
    return found


def _parts(sources: list[dict[str, Any]], since: dict[str, int], until: dict[str, int]) -> list[Part]:
    """One for each deployment that may have logs in its source's times."""
    out = []
    for s in sources:
        a, b = since[s["name"]], until[s["name"]]
        if a < b:
            known = {d["id"]: d for d in platform(s).deployments()}
            out += [Part(s, i, a, b) for i, d in known.items() if (d.get("first") or a) <= b and (d.get("last") is None or d["last"] > a)]
    return out


def _read(part: Part) -> Iterator[pa.RecordBatch]:
    s, held = part.source, []
    for x in platform(s).logs(part.deployment, part.since, part.until):
        held.append((s["name"], s["platform"], s.get("project"), part.deployment, x["id"], x["timestamp"], x["type"], x["message"], x["function"], list(x["metadata"].items())))
        if len(held) == ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.sources, self.since, self.until = _sources(options), int(options.get("since", -1)), options.get("until")

    def partitions(self) -> list[Part]:
        names = [s["name"] for s in self.sources]
        until = {s["name"]: int(self.until) if self.until is not None else platform(s).horizon() for s in self.sources}
        return _parts(self.sources, dict.fromkeys(names, self.since), until) or [Part({}, "", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return _read(part) if part.source else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.sources, self.since = _sources(options), int(options.get("since", -1))

    def initialOffset(self) -> dict[str, int]:
        return {s["name"]: self.since for s in self.sources}

    def latestOffset(self) -> dict[str, int]:
        return {s["name"]: platform(s).horizon() for s in self.sources}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Part]:
        known = [s for s in self.sources if s["name"] in end]
        return _parts(known, {s["name"]: start.get(s["name"], self.since) for s in known}, end)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return _read(part)


class PlatformLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "platform_logs"

    def schema(self) -> str:
        return LOGS

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


class _Deployments(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.sources, self.since = _sources(options), int(options.get("since", -1))

    def partitions(self) -> list[Part]:
        return [Part(s, "", self.since, 0) for s in self.sources]

    def read(self, part: Part) -> Iterator[tuple]:
        s = part.source
        for d in platform(s).deployments():
            if d["created"] is None or d["created"] > part.since:
                yield (s["name"], s["platform"], d["id"], d["state"], d["created"], d["ready"], d["branch"], d["commit"], d["url"])


class PlatformDeployments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "platform_deployments"

    def schema(self) -> str:
        return DEPLOYMENTS

    def reader(self, schema) -> _Deployments:
        return _Deployments(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    for source in (PlatformLogs, PlatformDeployments):
        spark.dataSource.register(source)


def _of_platform(f, word):
    """f of the row's platform; platforms without tables of their own are taken as the first."""
    first = next(iter(STATUSES))
    out = f(first, word)
    for name in STATUSES:
        out = F.when(F.col("platform") == name, f(name, word)).otherwise(out)
    return out


def logs(spark: SparkSession, sources: list[dict[str, Any]], streaming: bool = False, **options) -> DataFrame:
    """Logs of the sources, made alike: source, id, ts, level, message, deployment_id, function_name, metadata, and file_path and line_number, which enrichment fills."""
    register(spark)
    r = (spark.readStream if streaming else spark.read).format("platform_logs").option("sources", json.dumps(sources)).options(**options)
    return r.load().select(
        "source", "id", F.timestamp_millis("timestamp").alias("ts"), _of_platform(log_level, F.col("type")).alias("level"), "message", "deployment_id", "function_name", "metadata",
        F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"),
    )


def deployments(spark: SparkSession, sources: list[dict[str, Any]], **options) -> DataFrame:
    """Deployments of the sources, made alike."""
    register(spark)
    d = spark.read.format("platform_deployments").option("sources", json.dumps(sources)).options(**options).load()
    return d.select("source", "deployment_id", _of_platform(deploy_status, F.col("state")).alias("status"), "branch", "commit_sha", "url", F.timestamp_millis("created").alias("started_at"), F.timestamp_millis("ready").alias("completed_at"))
