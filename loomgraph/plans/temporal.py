"""Versioned history: version chains, point-in-time reads, snapshot differences and their application, blame and backfill.

A version is valid from its valid_from_ts (null: always) up to, not including, its valid_to_ts (null: open).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import last_by


def at_time(df: DataFrame, column: str, value: str) -> Column:
    return F.lit(value).cast(df.schema[column].dataType)


def version_chain(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, to: str = "valid_to_ts") -> DataFrame:
    """rows with the time at which the next version of their key closes them."""
    return rows.withColumn(to, F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, tie)))


def visible_at(df: DataFrame, t: str | None, start: str = "valid_from_ts", end: str = "valid_to_ts") -> DataFrame:
    """Versions valid at t; without t, the open ones."""
    if t is None:
        return df.filter(F.col(end).isNull())
    at = at_time(df, start, t)
    return df.filter((F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at)))


def snapshot_before(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, before: str) -> DataFrame:
    """The last row of each key before a time."""
    return last_by(rows.filter(F.col(ts) < at_time(rows, ts, before)), keys, F.col(ts), F.col(tie))


def as_of(events: DataFrame, versions: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """events with the version of their key that was valid at ts: an equality join on the key with the interval as residual."""
    j = events.join(versions, list(keys))
    return j.filter((F.col("valid_from_ts").isNull() | (F.col("valid_from_ts") <= F.col(ts))) & (F.col("valid_to_ts").isNull() | (F.col("valid_to_ts") > F.col(ts))))


def commit_chain(commits: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """commits with parent, the sha before them in their repository's order of time.

    Without partition columns the order is found by a join of ranks over ranges, not by one window over all.
    """
    if partition:
        return commits.withColumn("parent", F.lag("sha").over(Window.partitionBy(*partition).orderBy("ts", "sha")))
    # a commit's predecessor lies in its own year, or is the last one of an earlier year
    y = F.year("ts")
    own = Window.partitionBy("_y").orderBy("ts", "sha")
    c = commits.withColumn("_y", y).withColumn("_p", F.lag("sha").over(own))
    ends = c.groupBy("_y").agg(F.max_by("sha", F.struct("ts", "sha")).alias("_last"))
    before = ends.select((F.col("_y")).alias("_ly"), "_last")
    years = ends.select("_y").join(before, F.col("_ly") < F.col("_y"), "left").groupBy("_y").agg(F.max_by("_last", "_ly").alias("_q"))
    return c.join(years, "_y").select(*commits.columns, F.coalesce("_p", "_q").alias("parent"))


def diff(prev: DataFrame, curr: DataFrame, keys: Sequence[str], compared: Sequence[str] = ()) -> DataFrame:
    """keys, change_type (created, modified, deleted) of what differs; no compared columns: identity alone counts."""
    p = prev.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in compared], F.lit(True).alias("_in_p"))
    c = curr.select(*keys, *[F.col(c).alias(f"_c_{c}") for c in compared], F.lit(True).alias("_in_c"))
    j = p.join(c, list(keys), "full_outer")
    changed = reduce(lambda a, b: a | b, [~F.col(f"_p_{x}").eqNullSafe(F.col(f"_c_{x}")) for x in compared], F.lit(False))
    kind = F.when(F.col("_in_p").isNull(), "created").when(F.col("_in_c").isNull(), "deleted").when(changed, "modified")
    return j.select(*keys, kind.alias("change_type")).filter("change_type is not null")


def changeset_stats(**changes: DataFrame) -> DataFrame:
    """One row: for each named set of changes the numbers of created, modified and deleted."""
    tagged = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("entity"), "change_type") for n, d in changes.items()])
    kinds = ("created", "modified", "deleted")
    return tagged.agg(*[F.count_if((F.col("entity") == n) & (F.col("change_type") == k)).alias(f"{n}_{k}") for n in changes for k in kinds])


def scd2_apply(state: DataFrame, changes: DataFrame, curr: DataFrame, keys: Sequence[str], commit: str) -> DataFrame:
    """The next state: open rows of modified and deleted keys are closed, created and modified ones get a new open row.

    state: keys, attributes, valid_from, valid_to, change_type, closed_by. A version keeps the change that made it; what ended
    it stands in closed_by.
    """
    attributes = [c for c in state.columns if c not in (*keys, "valid_from", "valid_to", "change_type", "closed_by")]
    ended = changes.filter("change_type <> 'created'").select(*keys, F.col("change_type").alias("_by"))
    s = state.join(ended, list(keys), "left")
    ends = F.col("valid_to").isNull() & F.col("_by").isNotNull()
    old = s.select(*keys, *attributes, "valid_from", F.when(ends, commit).otherwise(F.col("valid_to")).alias("valid_to"), "change_type", F.when(ends, F.col("_by")).otherwise(F.col("closed_by")).alias("closed_by"))
    begun = changes.filter("change_type <> 'deleted'")
    none = F.lit(None).cast("string")
    new = curr.join(begun, list(keys)).select(*keys, *attributes, F.lit(commit).alias("valid_from"), none.alias("valid_to"), "change_type", none.alias("closed_by"))
    return old.unionByName(new)


def introduced_in(changes: DataFrame, commit: str) -> DataFrame:
    return changes.withColumn("commit", F.lit(commit))


def stamp_migrated(versions: DataFrame, head: str, head_ts: str) -> DataFrame:
    """Versions without a beginning get the head commit's, and count as migrated."""
    missing = F.col("valid_from_ts").isNull()
    return versions.withColumn("change_type", F.when(missing, "migrated").otherwise(F.col("change_type"))).withColumn(
        "valid_from", F.when(missing, head).otherwise(F.col("valid_from"))
    ).withColumn("valid_from_ts", F.coalesce("valid_from_ts", at_time(versions, "valid_from_ts", head_ts)))


def backfill_changes(rows: DataFrame, keys: Sequence[str], ordinal: str, compared: Sequence[str], *order: Column) -> DataFrame:
    """keys, ordinal, change_type of every step of a history at once.

    rows hold a key's states; the last of an ordinal counts. A difference depends on the state before alone, so the sequential
    fold over commits is one window over each key's ordinals.
    """
    state = last_by(rows, [*keys, ordinal], *order)
    w = Window.partitionBy(*keys).orderBy(ordinal)
    before = F.lag(F.struct(*compared)).over(w)
    kind = F.when(F.row_number().over(w) == 1, "created").when(~F.struct(*compared).eqNullSafe(before), "modified")
    return state.select(*keys, ordinal, kind.alias("change_type")).filter("change_type is not null")


def resolve_commit(commits: DataFrame, prefix: str) -> DataFrame:
    return commits.filter(F.col("sha").startswith(prefix)).orderBy("ts", "sha").limit(1)


def changes_between(versions: DataFrame, keys: Sequence[str], since: str, until: str, tie: str) -> DataFrame:
    """keys, tie, change_type of versions begun from since to until, both included."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("valid_from_ts", tie)) == 1
    v = versions.withColumn("change_type", F.when(first, "created").otherwise("modified"))
    return v.filter(F.col("valid_from_ts").between(at_time(versions, "valid_from_ts", since), at_time(versions, "valid_from_ts", until))).select(*keys, tie, "change_type")


def blame(versions: DataFrame, keys: Sequence[str], tie: str, *shown: str) -> DataFrame:
    """The version that introduced each key."""
    return versions.groupBy(*keys).agg(F.min_by(F.struct(*shown), F.struct("valid_from_ts", tie)).alias("v"), F.count("*").alias("versions")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in shown], "versions")


def newest(versions: DataFrame, ts: str, tie: str, most: int) -> DataFrame:
    return versions.orderBy(F.desc(ts), F.desc(tie)).limit(most)
