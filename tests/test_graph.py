"""Traversal on the small shapes: linear, branching, cyclic."""

from pyspark.sql import functions as F

from loomgraph.plans import graph as g

LINEAR = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")]
BRANCH = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("C", "E"), ("D", "F")]
CYCLE = [("A", "B"), ("B", "C"), ("C", "A")]


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def _start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _paths(spark, rows, depth, **kw):
    return sorted("".join(r.nodes) for r in g.paths(_edges(spark, rows), _start(spark, "A"), depth, **kw).collect())


def test_linear(spark):
    assert _paths(spark, LINEAR, 10) == ["AB", "ABC", "ABCD", "ABCDE"]
    files = spark.createDataFrame([(x, x) for x in "ABCDE"], "id string, file string")
    s = g.tree_stats(g.path_edges(g.paths(_edges(spark, LINEAR), _start(spark, "A"), 10)), _start(spark, "A"), files).first()
    assert (s.n_nodes, s.n_edges, s.n_leaves, s.n_cross_file, s.max_depth) == (5, 4, 1, 4, 4)


def test_branching_shares_a_child(spark):
    tree = {(r.src, r.dst): r.depth for r in g.path_edges(g.paths(_edges(spark, BRANCH), _start(spark, "A"), 5)).collect()}
    assert tree == {("A", "B"): 1, ("A", "C"): 1, ("B", "D"): 2, ("C", "D"): 2, ("C", "E"): 2, ("D", "F"): 3}


def test_cycle_ends_and_is_flagged(spark):
    found = g.paths(_edges(spark, CYCLE), _start(spark, "A"), 15).collect()
    assert sorted(("".join(r.nodes), r.back_edge) for r in found) == [("AB", False), ("ABC", False), ("ABCA", True)]
    assert sorted(r.id for r in g.reachable(_edges(spark, CYCLE), _start(spark, "A")).collect()) == ["A", "B", "C"]


def test_depth_filter_and_direction(spark):
    assert _paths(spark, LINEAR, 2) == ["AB", "ABC"]
    up = g.paths(_edges(spark, LINEAR), _start(spark, "C"), 9, up=True)
    assert sorted("".join(r.nodes) for r in up.collect()) == ["CB", "CBA"]
    assert _paths(spark, BRANCH, 5, node_filter=_start(spark, "B", "D")) == ["AB", "ABD"]


def test_closure_sides(spark):
    side = {r.id: r.side for r in g.closure(_edges(spark, LINEAR), _start(spark, "C")).collect()}
    assert side == {"A": "up", "B": "up", "C": "self", "D": "down", "E": "down"}
    both = {r.id: r.side for r in g.closure(_edges(spark, CYCLE), _start(spark, "A")).collect()}
    assert both == {"A": "self", "B": "both", "C": "both"}


def test_empty_edges(spark):
    none = _edges(spark, [])
    assert g.paths(none, _start(spark, "A"), 3).count() == 0
    assert [r.id for r in g.reachable(none, _start(spark, "A")).collect()] == ["A"]
    assert g.totals(none, _start(spark, "A")).first().n_edges == 0


def test_induced_keeps_other_columns(spark):
    e = _edges(spark, BRANCH).withColumn("line", F.lit(1))
    assert sorted((r.src, r.dst) for r in g.induced(e, _start(spark, "A", "C", "D")).collect()) == [("A", "C"), ("C", "D")]
