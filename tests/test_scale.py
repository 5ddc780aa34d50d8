"""Work that must grow with the input and no faster, told by plans, and results that must not depend on how rows are dealt out."""

import contextlib
import io

from pyspark.sql import functions as F

from loomgraph.plans import graph as g


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_starts_are_counted_before_they_are_joined(spark):
    symbols = spark.range(400).selectExpr("'f' AS name", "concat('p', id % 200) AS file_path", "CAST(id AS INT) AS start_line", "id AS sym_id")
    wanted = spark.createDataFrame([("f", None), ("f", "p7"), ("f", "p7"), ("f", "none"), ("g", None), (None, None), (None, "p1")], "name string, file_path string")
    found = g.resolve_start(symbols, wanted)
    got = {(r.name, r.file_path): (r.candidates, r.sym_id, r.status) for r in found.collect()}
    assert got == {
        ("f", None): (400, 0, "ambiguous"), ("f", "p7"): (4, 7, "found"), ("f", "none"): (0, None, "missing"), ("g", None): (0, None, "missing"), (None, None): (0, None, "missing"),
        (None, "p1"): (0, None, "missing"),
    }
    # a join on the name alone with the file as a residual meets every symbol of the name for each of its files
    assert " OR " not in plan(found)


def test_sums_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    import __spark_entry__ as e

    # 0.1 + 0.2 + 0.2 is 0.5 in one order of doubles, more or less in others
    prices = [1.1, 2.2, 3.3, 4.4, 5.5, 6.6, 7.7, 8.8, 9.9, 1000000.7, 333333.3, 0.1, 0.2, 0.2, 1.5]
    assert round(sum(round(p * 100) for p in prices)) % 100 == 50
    seen = set()
    for i in range(len(prices)):
        rows = prices[i:] + prices[:i]
        spark.createDataFrame([(n, 1, "O", p) for n, p in enumerate(rows)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").withColumn(
            "o_orderdate", F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")).coalesce(1).write.parquet(f"{tmp_path}/{i}/orders.parquet")
        seen.add(next(r.delta for r in e.queries()["digest_delta"](spark, f"{tmp_path}/{i}").collect() if r.stat == "symbols"))
    assert seen == {1333386}, seen


def test_names_of_several_files_have_their_importers_once(spark):
    from loomgraph.plans import lookup

    symbols = spark.createDataFrame([("p", "f", 1), ("p", "f", 2), ("p", "g", 2), ("q", "f", 3), ("q", None, 3), (None, "f", 1), (None, "f", 3), ("r", "f", 9)], "file_path string, name string, file_id long")
    imports = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 2), (9, 3), (None, 3), (5, None)], "src long, dst long")
    found = lookup.direct_importers(symbols, imports)
    got = {(r.file_path, r.name): r.importers for r in found.collect()}
    assert got == {("p", "f"): 2, ("p", "g"): 2, ("q", "f"): 1, ("q", None): 1, (None, "f"): 2}


def test_tasks_of_distinct_rows_follow_the_input(spark, sf):
    """Adaptive execution would join partitions into few large ones; those of a number that is asked for stay."""
    import __spark_entry__ as e
    from loomgraph.catalog.registry import Tables
    from loomgraph.storage import ROWS, tasks

    assert (tasks(0), tasks(ROWS), tasks(ROWS + 1), tasks(36_000_000)) == (1, 1, 2, 138)
    assert Tables(spark, sf).parts == 1 and Tables(spark, "/root/testdata/sf0.1").parts == 3
    for name in ("neighbors", "direct_importers", "symbol_lookup", "symbol_callers", "import_types"):
        assert "REPARTITION_BY_NUM" in plan(e.queries()[name](spark, sf)), name


def test_costly_rows_of_a_small_table_are_many_tasks(spark, sf):
    import __spark_entry__ as e
    from loomgraph.catalog.registry import Tables

    big = Tables(spark, "/root/testdata/sf0.1")
    assert big.spread(big.symbols, "sym_id", "part").rdd.getNumPartitions() == 2
    for name in ("file_symbols", "signature_types", "resolve_jvm", "resolution_stats"):
        assert "REPARTITION_BY_NUM" in plan(e.queries()[name](spark, sf)), name


def test_words_are_grouped_where_their_text_is(spark, tmp_path):
    """An index shuffles its postings once: one write of one exchange, and no pass for the bounds of ranges."""
    from loomgraph.operators.search_index import SearchIndex

    rows = spark.createDataFrame([(1, "b a b, a\n\u00c9t\u00e9 b"), (2, ""), (3, "!?"), (4, None), (5, "z")], "id long, text string")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    index = SearchIndex.build(rows, "id", "text", f"file://{tmp_path}/i")
    got = {(r.key, r.term): (r.n, r.words, list(r["at"])) for r in index.postings().collect()}
    assert got == {(1, "a"): (2, 6, [1, 3]), (1, "b"): (3, 6, [0, 2, 5]), (1, "\u00e9t\u00e9"): (1, 6, [4]), (5, "z"): (1, 1, [0])}
    assert index.documents().count() == 4
    tracker = spark.sparkContext.statusTracker()
    stages = [len(tracker.getJobInfo(j).stageIds) for j in set(tracker.getJobIdsForGroup()) - before if tracker.getJobInfo(j)]
    assert max(stages) <= 2, stages


def test_imports_meet_names_that_are_distinct(spark, sf):
    import __spark_entry__ as e

    text = plan(e.queries()["import_types"](spark, sf))
    joined = text[: text.index("Join")]
    assert "Aggregate" not in joined, text


def test_all_exports_are_listed(spark):
    from loomgraph.plans import lookup

    exports = spark.range(120).selectExpr("'p' AS package", "'function' AS kind", "concat('n', id) AS name", "id")
    rows = lookup.exports_by_kind(exports).collect()
    assert len(rows) == 120 and {r.n for r in rows} == {120} and sorted(r.nth for r in rows) == list(range(1, 121))
    assert sorted(r.nth for r in lookup.exports_by_kind(exports, 5, 10).collect()) == list(range(6, 16))


def test_sums_are_those_of_the_rows_in_order(spark, tmp_path):
    import __spark_entry__ as e
    from compare import duckdb

    # these doubles add up to just below 793104.5 in this order, and exactly to it as decimals
    rows = [(n, 1, "O", p) for n, p in enumerate((403115.5, 280973.17, 109015.83))]
    made = spark.createDataFrame(rows[::-1], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").withColumn("o_orderdate", F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"))
    made.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.stat: r.delta for r in e.queries()["digest_delta"](spark, str(tmp_path)).collect()}
    assert got == {"files": 3, "symbols": 793104}
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' ORDER BY o_orderkey")
    assert {r[2]: r[3] for r in con.sql(e.oracle_sql()["digest_delta"]).fetchall()} == got
