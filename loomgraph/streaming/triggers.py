"""Change triggers: debouncing, coalescing while a run is busy, bulk changes, backoff. Batch and streaming forms agree on what they emit."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.spells import spells


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """key, first_ts, fires_at, n: one row for each run of events with no quiet period of `gap` in it.

    The same call serves a batch table and a stream with a watermark; a stream emits a session once its gap is past.
    """
    g = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"))
    return g.select(key, "first_ts", F.col("w.end").alias("fires_at"), "n")


def bulk_windows(events: DataFrame, ts: str, width: str, most: int) -> DataFrame:
    """start, n, bulk: tumbling windows, and whether one holds more changes than `most`."""
    g = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("bulk"))


def watch_batches(changes: DataFrame, quiet_us: int = 300_000, pause_us: int = 500_000, most: int = 100) -> DataFrame:
    """key, batch, n, changes, first_us, fires_us: what a watcher of files hands on of changes (key, path, us).

    A path's changes count as one, at the time when it has been quiet for quiet_us. Those of a key form a batch, which closes when no other follows within pause_us, or with
    the most-th; fires_us is the time of that. Batches of a key count from 1.
    """
    named = changes.select(F.struct("key", "path").alias("key"), "us")
    settled = spells(named, quiet_us).groupBy("key", "spell").agg((F.max("us") + F.lit(quiet_us)).alias("us"), F.count("*").alias("changes"))
    one = spells(settled.select("key.key", "key.path", "us", "changes"), pause_us)
    w = Window.partitionBy("key", "spell").orderBy("us", "path")
    part = one.withColumn("_part", ((F.row_number().over(w) - 1) / most).cast("int"))
    g = part.groupBy("key", "spell", "_part").agg(F.count("*").alias("n"), F.sum("changes").alias("changes"), F.min("us").alias("first_us"), F.max("us").alias("_last"))
    fires = F.when(F.col("n") == most, F.col("_last")).otherwise(F.col("_last") + pause_us)
    batch = F.row_number().over(Window.partitionBy("key").orderBy("spell", "_part"))
    return g.select("key", batch.alias("batch"), "n", "changes", "first_us", fires.alias("fires_us"))


def backoff_s(failures, base: int = 15, most: int = 600):
    """Seconds to wait after so many failures in a row: base times 2, 4, ... 32, at most `most`; 0 after none."""
    factor = F.least(F.pow(F.lit(2.0), F.least(failures, F.lit(30)).cast("double")), F.lit(32.0))
    return F.when(failures <= 0, 0).otherwise(F.least(F.lit(base) * factor, F.lit(float(most))).cast("int"))


def failure_runs(polls: DataFrame, key: str, order: str, failed: str) -> DataFrame:
    """polls with the number of failures in a row up to each, and the wait that follows."""
    w = Window.partitionBy(key).orderBy(order)
    last_ok = F.max(F.when(~F.col(failed), F.col("_n"))).over(w)
    n = polls.withColumn("_n", F.row_number().over(w)).withColumn("failures", F.col("_n") - F.coalesce(last_ok, F.lit(0)))
    return n.withColumn("wait_s", backoff_s(F.col("failures"))).drop("_n")


COALESCED = "key bigint, trigger_id bigint, started_us bigint"


def _runs(held: tuple | None, rows: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], tuple]:
    """One key's triggers (us, id, duration_us) in order. held: (busy until, pending id, its duration); a run that is pending starts
    when the busy one ends, and is always the latest trigger since."""
    busy, pending, long = held or (None, None, None)
    out = []
    for us, i, d in rows:
        if busy is not None and pending is not None and us >= busy:
            out.append((pending, busy))
            busy, pending, long = busy + long, None, None
        if busy is None or us >= busy:
            out.append((i, us))
            busy = us + d
        else:
            pending, long = i, d
    return out, (busy, pending, long)


def coalesce_triggers(triggers: DataFrame) -> DataFrame:
    """key, trigger_id, started_us of the runs that triggers (key, us, trigger_id, duration_us) lead to.

    While a key's run is busy only its latest trigger is kept, and runs when that ends. A key's triggers are cut into busy spells
    that cannot affect each other (see spells); Spark spreads and sorts those, and Python folds over each batch by batch with three
    numbers of state, however many triggers it has. Only a spell without any pause stays in one task. Triggers without a key are left out.
    """
    # after a trigger a key is busy for one run and one pending run at most
    longest = triggers.agg(F.max("duration_us")).first()[0] or 0
    t = spells(triggers.filter("key is not null").select("key", "us", "trigger_id", "duration_us"), 2 * longest)
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = t.repartition(n, "key", "spell").sortWithinPartitions("key", "spell", "us", "trigger_id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            out = []
            for k, part in f.groupby(["key", "spell"], sort=False):
                if k != key:
                    if state is not None and state[1] is not None:
                        out.append((key[0], state[1], state[0]))
                    key, state = k, None
                runs, state = _runs(state, list(zip(part["us"], part["trigger_id"], part["duration_us"])))
                out += [(k[0], i, us) for i, us in runs]
            yield pd.DataFrame(out, columns=["key", "trigger_id", "started_us"])
        if state is not None and state[1] is not None:
            yield pd.DataFrame([(key[0], state[1], state[0])], columns=["key", "trigger_id", "started_us"])

    return ordered.mapInPandas(fold, COALESCED)


#: Triggers that a worker sorts at a time, those of one entry of state, and runs of one result frame.
RUN, PAGE, FRAME = 1 << 17, 512, 10_000


class Queue(StatefulProcessor):
    """One key's queue: its run, what is pending, and triggers that the watermark has not passed yet.

    Triggers wait until no earlier one can come, so that the order of arrival within the lateness does not matter; a timer stands at the time of
    the first that waits, or of the end of the run that keeps one pending. They wait as sorted lists in pages of state, which are merged when their time
    has come: a worker holds one list while it comes in, and then one page of each, however many triggers wait.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "busy bigint, pending bigint, long bigint")
        self.made = handle.getValueState("made", "lists bigint")
        # the pages from `page` to `last` of a list are there; first_us is the time of the first trigger in them
        self.lists = handle.getMapState("lists", "list bigint", "first_us bigint, page bigint, last bigint")
        self.pages = handle.getMapState("pages", "list bigint, page bigint", "us array<bigint>, trigger_id array<bigint>, duration_us array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, firsts = [], []
        for f in rows:
            new += zip(*(f[c].astype("int64").tolist() for c in ("us", "trigger_id", "duration_us")))
            if len(new) >= RUN:
                firsts.append(self._wait(new))
                new = []
        if new:
            firsts.append(self._wait(new))
        if firsts:
            self._wake(min(firsts))
        yield pd.DataFrame({"key": [], "trigger_id": [], "started_us": []})

    def _wait(self, new: list[tuple[int, int, int]]) -> int:
        """Sorts a list of triggers and stores it; returns the time of the first."""
        new.sort()
        n = self.made.get()[0] if self.made.exists() else 0
        self.made.update((n + 1,))
        for i in range(0, len(new), PAGE):
            self._store(n, i // PAGE, new[i : i + PAGE])
        self.lists.updateValue((n,), (new[0][0], 0, (len(new) - 1) // PAGE))
        return new[0][0]

    def _store(self, n: int, page: int, rows: list[tuple[int, int, int]]) -> None:
        self.pages.updateValue((n, page), tuple(map(list, zip(*rows))))

    def _due(self, n: int, page: int, last: int, now: int) -> Iterator[tuple[int, int, int]]:
        """The triggers of a list up to that time; the rest of it stays in state."""
        for p in range(page, last + 1):
            rows = list(zip(*self.pages.getValue((n, p))))
            due = bisect_right(rows, now, key=lambda r: r[0])
            yield from rows[:due]
            if due < len(rows):
                if due:
                    self._store(n, p, rows[due:])
                self.lists.updateValue((n,), (rows[due][0], p, last))
                return
            self.pages.removeKey((n, p))
        self.lists.removeKey((n,))

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        lists = [(n, page, last) for (n,), (us, page, last) in self.lists.iterator() if us <= now]
        due = heapq.merge(*(self._due(*x, now) for x in lists))
        held = tuple(self.run.get()) if self.run.exists() else None
        out = []
        while some := list(islice(due, FRAME)):
            more, held = _runs(held, some)
            out += more
            if len(out) >= FRAME:
                yield self._frame(key, out)
                out = []
        busy, pending, long = held or (None, None, None)
        if pending is not None and busy <= now:
            out, busy, pending, long = [*out, (pending, busy)], busy + long, None, None
        if busy is not None:
            self.run.update((busy, pending, long))
        if lists and (rest := min((us for us, _, _ in self.lists.values()), default=None)) is not None:
            self._wake(rest)
        if pending is not None:
            self._wake(busy)
        yield self._frame(key, out)

    def _frame(self, key, out: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], i, us) for i, us in out], columns=["key", "trigger_id", "started_us"])

    def close(self) -> None:
        pass


#: Where a session keeps the state of such streams.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def coalesce_stream(triggers: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """The streaming form of coalesce_triggers: key, trigger_id, started_us of the runs that start before the watermark, in whatever order and batches triggers come."""
    triggers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    t = triggers.filter("key is not null").select("key", "us", "trigger_id", "duration_us").withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    return t.groupBy("key").transformWithStateInPandas(Queue(), COALESCED, "append", "eventTime")


class Backoff(StatefulProcessor):
    """One source's failures in a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        out = []
        for at, failed in sorted((int(a), bool(x)) for f in rows for a, x in zip(f["at"], f["failed"])):
            n = n + 1 if failed else 0
            out.append((key[0], at, n))
        self.failures.update((n,))
        yield pd.DataFrame(out, columns=["source", "at", "failures"])

    def close(self) -> None:
        pass


def backoff_stream(polls: DataFrame) -> DataFrame:
    """source, at, failures, wait_s of polls (source, at, failed), which come in order: the streaming form of failure_runs."""
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    n = polls.select("source", "at", "failed").groupBy("source").transformWithStateInPandas(Backoff(), "source bigint, at bigint, failures int", "append", "none")
    return n.withColumn("wait_s", backoff_s(F.col("failures")))
