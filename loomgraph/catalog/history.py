"""Queries over versioned history and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import temporal as tp
from ..storage import delete_keys, retained, upsert
from .registry import AS_OF, query

_TS = "%Y-%m-%d %H:%M:%S"
_MID = "1998-01-01 00:00:00"


def _ts(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("scd2_versions", f"SELECT key, version, status, price, strftime(valid_from_ts, '{_TS}') AS valid_from_ts, strftime(valid_to_ts, '{_TS}') AS valid_to_ts FROM {{versions}}")
def scd2_versions(t):
    return t.versions.select("key", "version", "status", "price", _ts("valid_from_ts"), _ts("valid_to_ts"))


@query("symbols_at_commit", f"""WITH c AS (SELECT max(ts) AS c_at FROM {{commits}} WHERE ts <= TIMESTAMP '{_MID}')
    SELECT key, version, status, price FROM {{versions}}, c WHERE valid_from_ts <= c_at AND (valid_to_ts IS NULL OR valid_to_ts > c_at)""")
def symbols_at_commit(t):
    """The commit's time is one row, which is joined as such."""
    at = t.commits.filter(F.col("ts") <= tp.at_time(t.commits, "ts", _MID)).agg(F.max("ts").alias("at"))
    v = t.versions.crossJoin(F.broadcast(at))
    return v.filter((F.col("valid_from_ts") <= F.col("at")) & (F.col("valid_to_ts").isNull() | (F.col("valid_to_ts") > F.col("at")))).select("key", "version", "status", "price")


@query("symbol_snapshot", f"SELECT key, coalesce(status, '') AS status, coalesce(price, 0) AS price FROM {{versions}} WHERE valid_from_ts <= TIMESTAMP '{_MID}' AND (valid_to_ts IS NULL OR valid_to_ts > TIMESTAMP '{_MID}')")
def symbol_snapshot(t):
    v = tp.visible_at(t.versions, _MID)
    return v.select("key", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("price", F.lit(0.0)).alias("price"))


@query("asof_version", """SELECT l_orderkey, l_linenumber, o_custkey AS key, v.version FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN {versions} v ON v.key = o_custkey AND v.valid_from_ts <= l_shipdate AND (v.valid_to_ts IS NULL OR v.valid_to_ts > l_shipdate)""")
def asof_version(t):
    o = t.raw("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS key")
    events = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, "l_orderkey")
    return tp.as_of(events, t.versions, ["key"], "l_shipdate").select("l_orderkey", "l_linenumber", "key", "version")


_DIFF = """CASE WHEN p.key IS NULL THEN 'created' WHEN c.key IS NULL THEN 'deleted' WHEN p.status IS DISTINCT FROM c.status OR p.price IS DISTINCT FROM c.price THEN 'modified' END"""
_NODES = f"SELECT coalesce(p.key, c.key) AS key, {_DIFF} AS change_type FROM {{snap_prev}} p FULL JOIN {{snap_curr}} c ON p.key = c.key"


def _nodes(t):
    return tp.diff(t.snap_prev, t.snap_curr, ["key"], ["status", "price"])


@query("graph_diff_nodes", f"SELECT * FROM ({_NODES}) WHERE change_type IS NOT NULL")
def graph_diff_nodes(t):
    return _nodes(t)


def _import_snapshot(t, since, until):
    ns = t._count("supplier")
    li = t.raw("lineitem").filter(f"l_shipdate >= TIMESTAMP_NTZ '{since}' AND l_shipdate < TIMESTAMP_NTZ '{until}'")
    e = li.selectExpr("l_suppkey AS src", f"l_partkey % {ns} AS dst", "concat(l_returnflag, l_linestatus) AS s").filter("src <> dst")
    return e.groupBy("src", "dst").agg(F.array_sort(F.collect_set("s")).alias("symbols"))


def _import_sql(since, until):
    return f"""SELECT l_suppkey AS src, l_partkey % ns AS dst, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS symbols FROM lineitem
        CROSS JOIN (SELECT count(*) AS ns FROM supplier) WHERE l_shipdate >= TIMESTAMP '{since}' AND l_shipdate < TIMESTAMP '{until}' AND l_suppkey <> l_partkey % ns GROUP BY ALL"""


_EDGES = f"""SELECT coalesce(p.src, c.src) AS src, coalesce(p.dst, c.dst) AS dst, CASE WHEN p.src IS NULL THEN 'created' WHEN c.src IS NULL THEN 'deleted'
    WHEN p.symbols <> c.symbols THEN 'modified' END AS change_type FROM ({_import_sql('1995-01-01', '1998-01-01')}) p
    FULL JOIN ({_import_sql('1996-01-01', '1999-01-01')}) c ON p.src = c.src AND p.dst = c.dst"""


def _edges(t):
    return tp.diff(_import_snapshot(t, "1995-01-01", "1998-01-01"), _import_snapshot(t, "1996-01-01", "1999-01-01"), ["src", "dst"], ["symbols"])


@query("graph_diff_edges", f"SELECT * FROM ({_EDGES}) WHERE change_type IS NOT NULL")
def graph_diff_edges(t):
    return _edges(t)


@query("graph_diff_calls", """WITH p AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 100 AS dst FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
    c AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 100 AS dst FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')
    SELECT src, dst, 'created' AS change_type FROM (SELECT * FROM c EXCEPT SELECT * FROM p) UNION ALL SELECT src, dst, 'deleted' FROM (SELECT * FROM p EXCEPT SELECT * FROM c)""")
def graph_diff_calls(t):
    e = t.orders.selectExpr("key AS src", "version % 100 AS dst", "valid_from_ts AS ts")
    prev = e.filter("ts < TIMESTAMP_NTZ '1998-01-01'").select("src", "dst").distinct()
    curr = e.filter("ts >= TIMESTAMP_NTZ '1996-01-01' AND ts < TIMESTAMP_NTZ '1999-01-01'").select("src", "dst").distinct()
    return tp.diff(prev, curr, ["src", "dst"])


@query("changeset_stats", "SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE e = '{e}' AND change_type = '{k}') AS BIGINT) AS {e}_{k}" for e in ("node", "edge") for k in ("created", "modified", "deleted"))
       + f" FROM (SELECT 'node' AS e, change_type FROM ({_NODES}) UNION ALL SELECT 'edge', change_type FROM ({_EDGES}))")
def changeset_stats(t):
    return tp.changeset_stats(node=_nodes(t), edge=_edges(t))


@query("scd2_apply", f"""WITH d AS ({_NODES})
    SELECT p.key, p.status, p.price, 'c0' AS valid_from, CASE WHEN d.change_type IN ('modified', 'deleted') THEN 'c1' END AS valid_to, 'created' AS change_type,
    CASE WHEN d.change_type IN ('modified', 'deleted') THEN d.change_type END AS closed_by FROM {{snap_prev}} p LEFT JOIN d USING (key)
    UNION ALL SELECT c.key, c.status, c.price, 'c1', NULL, d.change_type, NULL FROM {{snap_curr}} c JOIN d USING (key) WHERE d.change_type IN ('created', 'modified')""")
def scd2_apply(t):
    none = F.lit(None).cast("string")
    state = t.snap_prev.select("*", F.lit("c0").alias("valid_from"), none.alias("valid_to"), F.lit("created").alias("change_type"), none.alias("closed_by"))
    return tp.scd2_apply(state, _nodes(t), t.snap_curr, ["key"], "c1")


@query("introduced_in", f"SELECT key, change_type, 'c1' AS commit FROM ({_NODES}) WHERE change_type IS NOT NULL")
def introduced_in(t):
    return tp.introduced_in(_nodes(t), "c1")


@query("stamp_migrated", f"""SELECT version, CASE WHEN status = 'O' THEN 'head' ELSE 'c' || version END AS valid_from,
    CASE WHEN status = 'O' THEN '2002-01-01 00:00:00' ELSE strftime(valid_from_ts, '{_TS}') END AS valid_from_ts, CASE WHEN status = 'O' THEN 'migrated' ELSE 'created' END AS change_type FROM {{versions}}""")
def stamp_migrated(t):
    known = F.col("status") != "O"
    v = t.versions.select("version", F.when(known, F.concat(F.lit("c"), "version")).alias("valid_from"), F.when(known, F.col("valid_from_ts")).alias("valid_from_ts"), F.lit("created").alias("change_type"))
    return tp.stamp_migrated(v, "head", "2002-01-01 00:00:00").select("version", "valid_from", _ts("valid_from_ts"), "change_type")


@query("backfill_diff", """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
    s AS (SELECT y.y, o_custkey AS key, arg_max((o_orderstatus, o_totalprice), (o_orderdate, o_orderkey)) AS v FROM y JOIN orders ON year(o_orderdate) <= y.y GROUP BY y.y, o_custkey)
    SELECT c.key, c.y AS ordinal, CASE WHEN p.key IS NULL THEN 'created' ELSE 'modified' END AS change_type
    FROM s c LEFT JOIN s p ON p.key = c.key AND p.y = c.y - 1 WHERE p.key IS NULL OR p.v IS DISTINCT FROM c.v""")
def backfill_diff(t):
    rows = t.orders.withColumn("ordinal", F.year("valid_from_ts").cast("bigint"))
    return tp.backfill_changes(rows, ["key"], "ordinal", ["status", "price"], F.col("valid_from_ts"), F.col("version"))


@query("list_commits", f"SELECT sha, strftime(ts, '{_TS}') AS ts, author, parent FROM {{commits}} ORDER BY commits.ts DESC, sha LIMIT 200")
def list_commits(t):
    return t.commits.orderBy(F.desc("ts"), "sha").limit(200).select("sha", _ts("ts"), "author", "parent")


@query("resolve_commit", f"SELECT sha, strftime(ts, '{_TS}') AS ts FROM {{commits}} WHERE starts_with(sha, 'a1') ORDER BY commits.ts, sha LIMIT 1")
def resolve_commit(t):
    return tp.resolve_commit(t.commits, "a1").select("sha", _ts("ts"))


@query("symbol_history", f"""WITH k AS (SELECT key FROM {{versions}} GROUP BY key ORDER BY count(*) DESC, key LIMIT 1)
    SELECT key, version, status, price, strftime(valid_from_ts, '{_TS}') AS valid_from_ts FROM {{versions}} WHERE key IN (SELECT key FROM k) ORDER BY versions.valid_from_ts DESC, version DESC LIMIT 20""")
def symbol_history(t):
    k = t.orders.groupBy("key").count().orderBy(F.desc("count"), "key").limit(1).select("key")
    return tp.newest(t.orders.join(F.broadcast(k), "key"), "valid_from_ts", "version", 20).select("key", "version", "status", "price", _ts("valid_from_ts"))


@query("diff_commits", """SELECT key, version, CASE WHEN n = 1 THEN 'created' ELSE 'modified' END AS change_type
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid_from_ts, version) AS n FROM {versions}) WHERE valid_from_ts BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1998-03-01'""")
def diff_commits(t):
    return tp.changes_between(t.orders, ["key"], "1997-03-01 00:00:00", "1998-03-01 00:00:00", "version")


@query("structural_blame", f"""SELECT key, arg_min(version, (valid_from_ts, version)) AS version, strftime(min(valid_from_ts), '{_TS}') AS valid_from_ts, count(*) AS versions FROM {{versions}} GROUP BY key""")
def structural_blame(t):
    return tp.blame(t.orders, ["key"], "version", "version", "valid_from_ts").withColumn("valid_from_ts", _ts("valid_from_ts"))


@query("find_removed", f"""SELECT key, status, price FROM {{snap_prev}} WHERE key NOT IN (SELECT key FROM {{snap_curr}}) ORDER BY price DESC, key LIMIT 5""")
def find_removed(t):
    gone = _nodes(t).filter("change_type = 'deleted'")
    return t.snap_prev.join(gone, "key", "left_semi").orderBy(F.desc("price"), "key").limit(5)


_OLD = "SELECT * FROM {files} WHERE doc_id % 3 <> 0"
_NEW = "SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN sha256(content || 'x') ELSE content_hash END AS content_hash FROM {files} WHERE doc_id % 5 <> 0"


def _hashes(t):
    f = t.files
    old = f.filter("doc_id % 3 <> 0").select("file_path", "content_hash")
    new = f.filter("doc_id % 5 <> 0").select("file_path", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return old, new


@query("file_hash_diff", f"""SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'created' WHEN n.file_path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.file_path = n.file_path WHERE o.content_hash IS DISTINCT FROM n.content_hash""")
def file_hash_diff(t):
    """Two versions of the file table, made of the whole of it: a third of the paths is new, a fifth is gone, a seventh is edited."""
    return tp.diff(*_hashes(t), ["file_path"], ["content_hash"])


@query("deleted_files", f"SELECT file_path FROM ({_OLD}) EXCEPT SELECT file_path FROM ({_NEW})")
def deleted_files(t):
    old, new = _hashes(t)
    return old.join(new, "file_path", "left_anti").select("file_path")


@query("upsert_files", f"""SELECT file_path, content_hash FROM ({_NEW}) UNION ALL SELECT file_path, content_hash FROM ({_OLD}) WHERE file_path NOT IN (SELECT file_path FROM ({_NEW}))""")
def upsert_files(t):
    return upsert(*_hashes(t), ["file_path"])


@query("purge_files", """SELECT sym_id, file_path FROM {symbols} WHERE file_id NOT IN (SELECT doc_id FROM {files} WHERE repo_id = 2)""")
def purge_files(t):
    gone = t.files.filter("repo_id = 2").select(F.col("doc_id").alias("file_id"))
    return delete_keys(t.symbols, gone, ["file_id"]).select("sym_id", "file_path")


@query("retention_prune", f"SELECT id FROM {{logs}} WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS")
def retention_prune(t):
    return retained(t.logs, "ts", AS_OF).select("id")
