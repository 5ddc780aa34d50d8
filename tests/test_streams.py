"""Triggers against a plain simulation; streams against batches."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from loomgraph.streaming import ingest, triggers


def simulated(rows):
    """Time goes on one event at a time: (time, kind, id, duration)."""
    out, busy, pending = [], None, None
    for us, i, d in sorted(rows):
        while busy is not None and busy <= us:
            if pending is None:
                busy = None
            else:
                out.append((pending[0], busy))
                busy, pending = busy + pending[1], None
        if busy is None:
            out.append((i, us))
            busy = us + d
        else:
            pending = (i, d)
    if pending is not None:
        out.append((pending[0], busy))
    return out


def test_coalescing(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 2000), i, rng.choice([1, 50, 200])) for i, k in enumerate([0] * 300 + [1] * 3 + [2])]
    df = spark.createDataFrame(rows, "key bigint, us bigint, trigger_id bigint, duration_us bigint")
    got = sorted(map(tuple, triggers.coalesce_triggers(df).collect()))
    want = sorted((k, i, us) for k in (0, 1, 2) for i, us in simulated([(us, i, d) for kk, us, i, d in rows if kk == k]))
    assert got == want
    assert triggers.coalesce_triggers(df.limit(0)).count() == 0


def test_spells(spark):
    rng = random.Random(5)
    rows, us = [], -500
    for n in range(300):
        us += rng.choice((0, 1, 5, 30, 79, 80, 81, 400))
        rows.append((n % 2, us, n, rng.choice((1, 20, 40))))
    df = spark.createDataFrame(rows, "key bigint, us bigint, trigger_id bigint, duration_us bigint")
    at = {}
    for r in triggers.spells(df, 80).collect():
        at.setdefault((r.key, r.spell), []).append(r.us)
    assert sum(map(len, at.values())) == 300 and len(at) > 20
    for key in (0, 1):
        ends = sorted((min(x), max(x)) for (k, _), x in at.items() if k == key)
        assert all(b[0] - a[1] >= 80 for a, b in zip(ends, ends[1:]))
    got = sorted(map(tuple, triggers.coalesce_triggers(df).collect()))
    assert got == sorted((k, i, us) for k in (0, 1) for i, us in simulated([(us, i, d) for kk, us, i, d in rows if kk == k]))


def test_coalescing_stream(spark, tmp_path):
    """Equal to the batch form up to the watermark, over batches, restarts and triggers out of order within the lateness."""
    schema = "key bigint, us bigint, trigger_id bigint, duration_us bigint"
    rng = random.Random(9)
    rows = [(rng.randrange(3), n * 100_000 + rng.randrange(90_000), n, rng.choice((50_000, 400_000, 900_000))) for n in range(240)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(1_900_000))  # at most about two seconds out of order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = []
    for n in range(6):
        spark.createDataFrame(mixed[40 * n : 40 * n + 40], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        if n % 2:  # a restart every two batches
            ingest.to_files(triggers.coalesce_stream(stream, "2 seconds"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    end = (max(r[1] for r in rows) // 1000 - 2000) * 1000
    batch = sorted(tuple(r) for r in triggers.coalesce_triggers(spark.createDataFrame(rows, schema)).collect())
    assert got == [r for r in batch if r[2] <= end] and len(got) > 50


class Held(dict):
    """One key's state, value or map."""

    def exists(self):
        return bool(self)

    def get(self, key=()):
        return super().get(key)

    getValue = get

    def update(self, value):
        self[()] = value

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(self.items())

    def values(self):
        return iter(super().values())


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Held())

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Held())

    def registerTimer(self, ms):
        self.timers.append(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_triggers_are_read_page_by_page(monkeypatch):
    """Whatever number of triggers of a key waits, a worker asks for no more than a page at a time, and hands its runs on in small frames."""
    for name, n in (("RUN", 50), ("PAGE", 8), ("FRAME", 20)):
        monkeypatch.setattr(triggers, name, n)
    rng = random.Random(7)
    rows = [(n * 2000 + rng.randrange(900), n, rng.choice((500, 3000, 20_000))) for n in range(600)]
    late = sorted(rows, key=lambda r: r[0] + rng.randrange(200_000))
    q, handle, got = triggers.Queue(), Handle(), []
    q.init(handle)
    for at in range(0, 600, 200):
        part = late[at : at + 200]
        frames = [pd.DataFrame(part[i : i + 30], columns=["us", "trigger_id", "duration_us"]) for i in range(0, 200, 30)]
        assert sum(map(len, q.handleInputRows((1,), iter(frames), None))) == 0
        assert all(len(us) <= 8 for us, _, _ in handle.states["pages"].values())
        now = max(r[0] for r in late[: at + 200]) // 1000 - 200
        handle.timers.sort()
        while handle.timers and handle.timers[0] <= now:
            out = list(q.handleExpiredTimer((1,), Watermark(now), handle.timers.pop(0)))
            assert all(len(f) < 40 for f in out)
            got += [(int(i), int(us)) for f in out for _, i, us in f.itertuples(index=False)]
            handle.timers.sort()
        assert all(us > now * 1000 for us, _, _ in handle.states["lists"].values())
    end = now * 1000
    want = sorted(x for x in simulated(rows) if x[1] <= end)
    assert sorted(got) == want and len(want) > 50 and handle.states["pages"]


def test_backoff_stream(spark, tmp_path):
    stream = spark.readStream.schema("source bigint, at bigint, failed boolean").parquet(f"{tmp_path}/in/*")
    rows = [(s, at, (at + s) % 7 > 1) for at in range(60) for s in (1, 2)]
    for n in range(3):
        spark.createDataFrame(rows[40 * n : 40 * n + 40], "source bigint, at bigint, failed boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        ingest.to_files(triggers.backoff_stream(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = sorted((r.source, r.at, r.failures, r.wait_s) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    polls = spark.createDataFrame(rows, "source bigint, at bigint, failed boolean")
    assert got == sorted((r.source, r.at, r.failures, r.wait_s) for r in triggers.failure_runs(polls, "source", "at", "failed").collect())


def test_watch_batches(spark):
    rng = random.Random(3)
    rows, us = [], 0
    for _ in range(900):
        us += rng.choice((10, 50, 100, 290, 310, 700, 2000)) * 1000
        rows.append((rng.randrange(2), f"p{rng.randrange(12)}", us))
    got = sorted(tuple(r) for r in triggers.watch_batches(spark.createDataFrame(rows, "key int, path string, us bigint"), most=7).collect())
    want = []
    for key in (0, 1):
        fired = []
        for path in {r[1] for r in rows}:
            times = sorted(r[2] for r in rows if r[:2] == (key, path))
            run = times[:1]
            for a in times[1:]:
                if a - run[-1] >= 300_000:
                    fired.append((run[-1] + 300_000, path, len(run)))
                    run = []
                run.append(a)
            if run:
                fired.append((run[-1] + 300_000, path, len(run)))
        batches = []
        for f in sorted(fired):
            if not batches or len(batches[-1]) == 7 or f[0] - batches[-1][-1][0] >= 500_000:
                batches.append([])
            batches[-1].append(f)
        want += [(key, i, len(b), sum(x[2] for x in b), b[0][0], b[-1][0] + (0 if len(b) == 7 else 500_000)) for i, b in enumerate(batches, 1)]
    assert got == sorted(want) and any(b[2] == 7 for b in want)
    assert triggers.watch_batches(spark.createDataFrame([], "key int, path string, us bigint")).count() == 0


def test_backoff(spark):
    waits = [r[0] for r in spark.range(0, 9).select(triggers.backoff_s(F.col("id"))).collect()]
    assert waits == [0, 30, 60, 120, 240, 480, 480, 480, 480]


def test_duplicates_and_late_rows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "error"), (1, "2024-01-01 00:00:00", "error"), (2, "2024-01-03 00:00:00", "info"), (3, "2024-01-03 00:00:01", "warn")]
    schema = "id bigint, ts timestamp, level string"
    df = spark.createDataFrame(rows, "id bigint, t string, level string").select("id", F.col("t").cast("timestamp").alias("ts"), "level")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    ingest.to_files(ingest.ingest(stream, "warn"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3]
    ingest.to_files(ingest.level_counts(stream), f"{tmp_path}/out2", f"{tmp_path}/c2").awaitTermination()
    assert [(r.level, r.n) for r in spark.read.parquet(f"{tmp_path}/out2").collect()] == [("error", 2)]


def test_enriched(spark):
    df = spark.createDataFrame([("error", None, None, None, "boom\n  at f (a.js:1:2)"), ("error", "k.ts", 3, None, "at g (b.js:1:1)"), ("info", None, None, None, "at f (a.js:1:2)")], "level string, file_path string, line_number int, function_name string, message string")
    assert [(r.file_path, r.line_number, r.function_name) for r in ingest.enriched(df).collect()] == [("a.js", 1, "f"), ("k.ts", 3, None), (None, None, None)]
