"""Versioned history: boundaries, invariants, symmetry, replay."""

import random

from pyspark.sql import functions as F

from loomgraph.plans import temporal as tp
from loomgraph.storage import delete_keys, last_by, replace_table, retained, upsert


def _versions(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-03 00:00:00"), ("b", 3, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "key string, version int, t string").select("key", "version", F.col("t").cast("timestamp_ntz").alias("valid_from_ts"))
    return tp.version_chain(df, ["key"], "valid_from_ts", "version")


def test_visibility_is_half_open(spark):
    at = lambda t: sorted(r.version for r in tp.visible_at(_versions(spark), t).collect())
    assert at("2024-01-01 00:00:00") == [1]
    assert at("2024-01-02 23:59:59") == [1, 3]
    assert at("2024-01-03 00:00:00") == [2, 3]
    assert at(None) == [2, 3]


def test_null_beginning_is_always_visible(spark):
    v = _versions(spark).withColumn("valid_from_ts", F.when(F.col("version") > 1, F.col("valid_from_ts")))
    assert [r.version for r in tp.visible_at(v, "1999-01-01 00:00:00").collect()] == [1]


def test_diff_is_symmetric_and_null_safe(spark):
    p = spark.createDataFrame([(1, "x", None), (2, "y", "s"), (3, "z", "s")], "k int, a string, b string")
    c = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", "s")], "k int, a string, b string")
    flip = {"created": "deleted", "deleted": "created", "modified": "modified"}
    there = {r.k: r.change_type for r in tp.diff(p, c, ["k"], ["a", "b"]).collect()}
    back = {r.k: r.change_type for r in tp.diff(c, p, ["k"], ["a", "b"]).collect()}
    assert there == {2: "modified", 3: "deleted", 4: "created"}
    assert back == {k: flip[v] for k, v in there.items()}


def test_replay_equals_snapshot(spark):
    rng = random.Random(3)
    schema = "key int, value int"
    states = [{k: rng.randint(0, 3) for k in range(12) if rng.random() < 0.7} for _ in range(5)]
    none = F.lit(None).cast("string")
    state = spark.createDataFrame([], schema).select("key", "value", none.alias("valid_from"), none.alias("valid_to"), none.alias("change_type"), none.alias("closed_by"))
    before = spark.createDataFrame([], schema)
    for i, s in enumerate(states):
        now = spark.createDataFrame(list(s.items()), schema)
        state = tp.scd2_apply(state, tp.diff(before, now, ["key"], ["value"]), now, ["key"], f"c{i}")
        state = spark.createDataFrame(state.collect(), state.schema)
        open_ = state.filter("valid_to is null")
        assert {r.key: r.value for r in open_.collect()} == s
        assert open_.count() == len(s)
        before = now
    for r in state.filter("valid_to is not null").collect():
        assert r.valid_from < r.valid_to and r.closed_by in ("modified", "deleted")


def test_backfill_equals_pairwise_diffs(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 3, 5)], "k int, ordinal int, v int")
    got = sorted((r.k, r.ordinal, r.change_type) for r in tp.backfill_changes(rows, ["k"], "ordinal", ["v"], F.col("v")).collect())
    assert got == [(1, 0, "created"), (1, 2, "modified"), (2, 1, "created")]


def test_commit_chain_over_years(spark):
    rows = [("c", "2024-05-01"), ("a", "2022-01-01"), ("b", "2022-06-01")]
    df = spark.createDataFrame(rows, "sha string, t string").select("sha", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert {r.sha: r.parent for r in tp.commit_chain(df).collect()} == {"a": None, "b": "a", "c": "b"}


def test_upsert_delete_retain(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([("z", 2), ("w", 3)], "v string, k int")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r.k for r in delete_keys(old, new, ["k"]).collect()] == [1]
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "k int, pos int, v string")
    assert {r.k: r.v for r in last_by(batch, ["k"], F.col("pos")).collect()} == {1: None, 2: "b"}
    logs = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2023-12-31 23:59:59")], "id int, t string").select("id", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert [r.id for r in retained(logs, "ts", "2024-01-31 00:00:00").collect()] == [1]


def test_replace_a_table_that_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    out = replace_table(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r.id for r in out.collect()) == [3, 4]
    assert not [p for p in tmp_path.iterdir() if p.name != "t"]
