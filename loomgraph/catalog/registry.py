"""Registration of queries: a function of the entity tables, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import tasks

AS_OF = "2024-01-31 00:00:00"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

#: The entities in SQL, over the test tables; a query's text names those it uses.
ENTITY_SQL = {
    "repositories": "SELECT r_regionkey AS repo_id, r_name AS name, 'repo://' || r_name AS url FROM region",
    "files": "SELECT doc_id, doc_id % 5 AS repo_id, source || '/' || lang || '/doc_' || doc_id AS file_path, lang AS language, n_chars AS size_bytes, text AS content, sha256(text) AS content_hash FROM documents",
    "symbols": """SELECT p_partkey AS sym_id, replace(p_name, ' ', '_') AS name,
        CASE (p_partkey // 7) % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'type' ELSE 'constant' END AS kind,
        p_partkey % nf AS file_id, 'src/f' || (p_partkey % nf) || '.ts' AS file_path, p_size AS start_line,
        CAST(p_size + (p_partkey // 3) % 40 AS INTEGER) AS end_line, p_brand || ' ' || p_type AS signature, (p_partkey % nf) % 5 AS repo_id
        FROM part CROSS JOIN (SELECT count(*) // 10 AS nf FROM documents)""",
    "imports": """SELECT DISTINCT l_suppkey AS src, l_partkey % ns AS dst FROM lineitem CROSS JOIN (SELECT count(*) AS ns FROM supplier) WHERE l_suppkey <> l_partkey % ns""",
    "calls": """SELECT DISTINCT o_custkey AS src, l_partkey % nc AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        CROSS JOIN (SELECT count(*) AS nc FROM customer) WHERE o_custkey <> l_partkey % nc""",
    "call_sites": """SELECT o_custkey AS src, CASE WHEN l_partkey % 97 > 0 THEN l_partkey % nc END AS dst, CAST(l_quantity AS INTEGER) AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        CROSS JOIN (SELECT count(*) AS nc FROM customer) WHERE o_custkey <> l_partkey % nc""",
    "thin_imports": """SELECT DISTINCT l_suppkey AS src, l_partkey % ns AS dst FROM lineitem CROSS JOIN (SELECT count(*) AS ns FROM supplier)
        WHERE l_linenumber = 7 AND l_returnflag = 'R' AND l_quantity >= 40 AND l_suppkey <> l_partkey % ns""",
    "thin_calls": """SELECT DISTINCT o_custkey AS src, l_partkey % nc AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        CROSS JOIN (SELECT count(*) AS nc FROM customer) WHERE l_linenumber = 1 AND o_orderstatus = 'P' AND o_custkey <> l_partkey % nc""",
    "functions": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS file FROM customer",
    "versions": """SELECT o_custkey AS key, o_orderkey AS version, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS valid_from_ts,
        lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to_ts FROM orders""",
    "logs": """SELECT event_id AS id, ts, user_id % 5 AS repo_id, CASE WHEN user_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS source,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
        'dep_' || strftime(ts, '%Y%m%d') AS deployment_id, 'fn_' || user_id AS function_name, 'src/m' || (user_id % 10) || '.ts' AS file_path,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS line_number,
        '[' || event_type || '] k=' || json_extract_string(props, '$.k') || ' failed' AS message, value AS duration, event_type FROM events""",
    "deployments": """SELECT 'dep_' || strftime(d, '%Y%m%d') AS deployment_id, d AS started_at,
        CASE day(d) % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'error' WHEN 2 THEN 'building' ELSE 'cancelled' END AS status
        FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events)""",
    "findings": """SELECT doc_id AS finding_id, 'js/q' || (doc_id % 7) AS query_id, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'note' END AS severity,
        doc_id % nf AS source_file, 1 + doc_id % 60 AS source_line, (doc_id * 7 + 3) % nf AS sink_file, 1 + (doc_id * 3) % 60 AS sink_line
        FROM labels CROSS JOIN (SELECT count(*) // 10 AS nf FROM documents)""",
    "occurrences": """SELECT l_orderkey AS occ_order, l_linenumber AS occ_line, l_partkey % nf AS file_id, 1 + CAST(l_quantity AS INTEGER) AS line, l_suppkey AS target
        FROM lineitem CROSS JOIN (SELECT count(*) // 10 AS nf FROM documents)""",
    "commits": """SELECT sha256(strftime(d, '%Y-%m-%d')) AS sha, d AS ts, 'clerk_' || (dayofyear(d) % 20) AS author,
        lag(sha256(strftime(d, '%Y-%m-%d'))) OVER (ORDER BY d) AS parent FROM (SELECT DISTINCT o_orderdate AS d FROM orders)""",
    "snap_prev": "SELECT o_custkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "snap_curr": "SELECT * FROM (SELECT o_custkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE status <> 'F'",
}


class Tables:
    """The entities as DataFrames, made from the test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _count(self, name: str, per: int = 1) -> int:
        return self.raw(name).count() // per

    @cached_property
    def parts(self) -> int:
        """Tasks for steps on as many rows as the line items."""
        return tasks(self._count("lineitem"))

    def spread(self, df: DataFrame, key: str, table: str, each: int = 1 << 14) -> DataFrame:
        """df, made of the rows of a table that is few bytes and so one task, in more tasks for what costs much a row."""
        return df.repartition(tasks(self._count(table), each), key)

    @cached_property
    def n_files(self) -> int:
        return self._count("documents", 10)

    @cached_property
    def repositories(self) -> DataFrame:
        return self.raw("region").selectExpr("r_regionkey AS repo_id", "r_name AS name", "concat('repo://', r_name) AS url")

    @cached_property
    def files(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id", "doc_id % 5 AS repo_id", "concat(source, '/', lang, '/doc_', doc_id) AS file_path", "lang AS language",
            "n_chars AS size_bytes", "text AS content", "sha2(text, 256) AS content_hash",
        )

    @cached_property
    def symbols(self) -> DataFrame:
        nf = self.n_files
        return self.raw("part").selectExpr(
            "p_partkey AS sym_id", "replace(p_name, ' ', '_') AS name",
            "CASE (p_partkey div 7) % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'type' ELSE 'constant' END AS kind",
            f"p_partkey % {nf} AS file_id", f"concat('src/f', p_partkey % {nf}, '.ts') AS file_path", "p_size AS start_line",
            "CAST(p_size + (p_partkey div 3) % 40 AS INT) AS end_line", "concat(p_brand, ' ', p_type) AS signature", f"(p_partkey % {nf}) % 5 AS repo_id",
        )

    def _imports(self, kept: str = "true") -> DataFrame:
        ns = self._count("supplier")
        edges = self.raw("lineitem").filter(f"{kept} AND l_suppkey <> l_partkey % {ns}").selectExpr("l_suppkey AS src", f"l_partkey % {ns} AS dst")
        return edges.repartition(self.parts, "src").distinct()

    def _calls(self, kept: str = "true", *more: str) -> DataFrame:
        nc = self._count("customer")
        orders, items = self.raw("orders").repartition(self.parts, "o_orderkey"), self.raw("lineitem").repartition(self.parts, "l_orderkey")
        j = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
        return j.filter(f"{kept} AND o_custkey <> l_partkey % {nc}").selectExpr("o_custkey AS src", f"l_partkey % {nc} AS dst", *more)

    @cached_property
    def imports(self) -> DataFrame:
        return self._imports()

    @cached_property
    def calls(self) -> DataFrame:
        return self._calls().repartition(self.parts, "src").distinct()

    @cached_property
    def call_sites(self) -> DataFrame:
        """Calls with their lines; some could not be resolved and have no dst."""
        c = self._calls("true", "l_partkey", "CAST(l_quantity AS INT) AS line")
        return c.select("src", F.when(F.col("l_partkey") % 97 > 0, F.col("dst")).alias("dst"), "line")

    @cached_property
    def thin_imports(self) -> DataFrame:
        """For paths, whose number is exponential in a dense graph."""
        return self._imports("l_linenumber = 7 AND l_returnflag = 'R' AND l_quantity >= 40")

    @cached_property
    def thin_calls(self) -> DataFrame:
        return self._calls("l_linenumber = 1 AND o_orderstatus = 'P'").distinct()

    @cached_property
    def functions(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS file")

    @cached_property
    def orders(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_custkey AS key", "o_orderkey AS version", "o_orderstatus AS status", "o_totalprice AS price", "o_orderdate AS valid_from_ts")

    @cached_property
    def versions(self) -> DataFrame:
        from ..plans.temporal import version_chain

        return version_chain(self.orders, ["key"], "valid_from_ts", "version")

    @cached_property
    def logs(self) -> DataFrame:
        k = F.get_json_object("props", "$.k")
        return self.raw("events").select(
            F.col("event_id").alias("id"), "ts", (F.col("user_id") % 5).alias("repo_id"),
            F.when(F.col("user_id") % 2 == 0, "p1").otherwise("p2").alias("source"),
            F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info").alias("level"),
            F.concat(F.lit("dep_"), F.date_format("ts", "yyyyMMdd")).alias("deployment_id"), F.concat(F.lit("fn_"), F.col("user_id")).alias("function_name"),
            F.concat(F.lit("src/m"), F.col("user_id") % 10, F.lit(".ts")).alias("file_path"), k.cast("int").alias("line_number"),
            F.concat(F.lit("["), F.col("event_type"), F.lit("] k="), k, F.lit(" failed")).alias("message"), F.col("value").alias("duration"), "event_type",
        )

    @cached_property
    def deployments(self) -> DataFrame:
        d = self.raw("events").select(F.col("ts").cast("date").cast("timestamp_ntz").alias("d")).distinct()
        status = F.when(F.day("d") % 4 == 0, "ready").when(F.day("d") % 4 == 1, "error").when(F.day("d") % 4 == 2, "building").otherwise("cancelled")
        return d.select(F.concat(F.lit("dep_"), F.date_format("d", "yyyyMMdd")).alias("deployment_id"), F.col("d").alias("started_at"), status.alias("status"))

    @cached_property
    def findings(self) -> DataFrame:
        nf = self.n_files
        return self.raw("labels").selectExpr(
            "doc_id AS finding_id", "concat('js/q', doc_id % 7) AS query_id", "CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'note' END AS severity",
            f"doc_id % {nf} AS source_file", "1 + doc_id % 60 AS source_line", f"(doc_id * 7 + 3) % {nf} AS sink_file", "1 + (doc_id * 3) % 60 AS sink_line",
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS occ_order", "l_linenumber AS occ_line", f"l_partkey % {self.n_files} AS file_id", "1 + CAST(l_quantity AS INT) AS line", "l_suppkey AS target"
        )

    @cached_property
    def commits(self) -> DataFrame:
        from ..plans.temporal import commit_chain

        days = self.raw("orders").select(F.col("o_orderdate").alias("ts")).distinct()
        named = days.select(F.sha2(F.date_format("ts", "yyyy-MM-dd"), 256).alias("sha"), "ts", F.concat(F.lit("clerk_"), F.dayofyear("ts") % 20).alias("author"))
        return commit_chain(named)

    def snapshot(self, before: str) -> DataFrame:
        from ..plans.temporal import snapshot_before

        return snapshot_before(self.orders, ["key"], "valid_from_ts", "version", before).select("key", "status", "price")

    @cached_property
    def snap_prev(self) -> DataFrame:
        return self.snapshot("1998-01-01 00:00:00")

    @cached_property
    def snap_curr(self) -> DataFrame:
        return self.snapshot("1999-01-01 00:00:00").filter("status <> 'F'")


def with_entities(sql: str) -> str:
    """sql with a WITH clause for the entities that it names in braces."""
    named = rf"\{{({'|'.join(ENTITY_SQL)})\}}"
    used = dict.fromkeys(re.findall(named, sql))
    body = re.sub(named, r"\1", sql).strip()
    ctes = ", ".join(f"{n} AS ({ENTITY_SQL[n]})" for n in used)
    if not ctes:
        return body
    if m := re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{ctes}, {body[m.end() :]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name; sql names entities in braces."""

    def register(f: Callable[[Tables], DataFrame]):
        assert name not in _queries, name
        _queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _sql[name] = with_entities(sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
