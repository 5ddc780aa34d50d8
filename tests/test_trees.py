"""Call trees on the small shapes, and on random graphs against a plain breadth-first walk."""

import random
from collections import Counter

import pytest

from loomgraph.plans import trees

EDGES = "src string, dst string, line int"
BRANCH = [("A", "B", 1), ("A", "C", 2), ("B", "D", 3), ("C", "D", 4), ("C", "E", 5), ("D", "F", 6)]
CYCLE = [("A", "B", 1), ("B", "C", 2), ("C", "A", 3)]


def run(spark, rows, start="A", files=None, schema=EDGES, **kw):
    files = files or {x: x for r in rows for x in r[:2] if x} | {start: start}
    f = spark.createDataFrame(list(files.items()), "id string, file string")
    tree = trees.call_tree(spark.createDataFrame(rows, schema), spark.createDataFrame([(start,)], "id string"), f, **kw)
    return tree, {r.id: r for r in tree.collect()}


def test_linear_and_direction(spark):
    rows = [(a, b, 1) for a, b in zip("ABCD", "BCDE")]
    tree, got = run(spark, rows)
    assert [(r.id, r.parent, r.depth, r.place) for r in sorted(got.values(), key=lambda r: r.place)] == [("A", None, 0, 1)] + [(b, a, i, i + 1) for i, (a, b) in enumerate(zip("ABCD", "BCDE"), 1)]
    assert {i for i, r in got.items() if r.is_end} == {"E"}
    t = trees.tree_totals(tree).first()
    assert (t.nodes, t.ends, t.crossing, t.max_depth, t.truncated) == (5, 1, 4, 4, False)
    _, up = run(spark, rows, "E", up=True)
    assert {i for i, r in up.items() if r.is_end} == {"A"} and up["A"].above == ["E", "D", "C", "B"]


def test_a_shared_callee_stands_once_with_its_first_parent(spark):
    _, got = run(spark, BRANCH)
    assert {(r.id, r.parent, r.line) for r in got.values()} == {("A", None, None), ("B", "A", 1), ("C", "A", 2), ("D", "B", 3), ("E", "C", 5), ("F", "D", 6)}
    assert {i for i, r in got.items() if r.is_end} == {"E", "F"}


def test_cycles_and_loops_end(spark):
    rows = [*CYCLE, ("B", "B", 9)]
    tree, got = run(spark, rows)
    assert set(got) == {"A", "B", "C"} and not any(r.is_end for r in got.values())
    edges = spark.createDataFrame([(*r, "calls", True) for r in rows], EDGES + ", kind string, follow boolean")
    back = {(r.src, r.dst): (r.first, r.back_edge) for r in trees.chain_edges(tree, edges, 15).collect()}
    assert back == {("A", "B"): (True, False), ("B", "C"): (True, False), ("C", "A"): (False, True), ("B", "B"): (False, True)}


def test_budget_depth_and_scope(spark):
    _, got = run(spark, BRANCH, most=3)
    assert sorted(got) == ["A", "B", "C"] and not got["A"].is_end and got["B"].is_end
    _, got = run(spark, BRANCH, max_depth=1)
    assert sorted(got) == ["A", "B", "C"]
    _, got = run(spark, BRANCH, files={x: ("in/" if x in "ABDF" else "out/") + x for x in "ABCDEF"}, scope="in/")
    assert sorted(got) == ["A", "B", "C", "D", "F"] and got["C"].leaves_scope and got["C"].is_end and not got["C"].crosses and got["D"].crosses


def test_calls_across_files_need_an_import(spark):
    files = spark.createDataFrame([("A", "f"), ("B", "f"), ("C", "g"), ("D", "h"), ("E", "h")], "id string, file string")
    calls = spark.createDataFrame([("A", "B", 1), ("B", "C", 2), ("B", "D", 3), ("D", "E", 4), ("A", None, 5), ("A", "X", 6)], EDGES)
    imports = spark.createDataFrame([("f", "g"), ("f", "g")], "src string, dst string")
    edges = trees.resolved_calls(calls, files, imports)
    assert {(r.src, r.dst): r.kind for r in edges.collect()} == {("A", "B"): "calls", ("B", "C"): "imports", ("B", "D"): "dynamic", ("D", "E"): "calls", ("A", None): "dynamic", ("A", "X"): "dynamic"}
    tree = trees.call_tree(edges, spark.createDataFrame([("A",)], "id string"), files)
    assert {r.id: r.open for r in tree.collect()} == {"A": True, "B": True, "C": True, "D": False, "X": False}  # nothing behind a dynamic site
    assert sorted((r.src, r.dst or "-", r.kind, r.depth) for r in trees.chain_edges(tree, edges, 15).collect()) == [
        ("A", "-", "dynamic", 1), ("A", "B", "calls", 1), ("A", "X", "dynamic", 1), ("B", "C", "imports", 2), ("B", "D", "dynamic", 2)]


@pytest.mark.parametrize("most", [40, 1000])
def test_against_a_plain_walk(spark, most):
    rng = random.Random(most)
    rows = [(str(rng.randrange(120)), str(rng.randrange(120)), rng.randrange(9)) for _ in range(260)]
    _, got = run(spark, rows, "7", most=most, max_depth=6)
    line = {}
    for a, b, n in rows:
        line[a, b] = min(n, line.get((a, b), 99))
    seen, level = {"7": (None, 0, None)}, ["7"]
    for depth in range(1, 7):
        met = {}
        for place, a in enumerate(level):
            for (x, b), n in line.items():
                if x == a and b not in seen:
                    met[b] = min(met.get(b, (999,)), (place, n, a))
        level = sorted(met, key=lambda b: (*met[b][:2], b))[: most - len(seen)]
        seen |= {b: (met[b][2], depth, met[b][1]) for b in level}
    assert {i: (r.parent, r.depth, r.line) for i, r in got.items()} == seen
    assert [r.id for r in sorted(got.values(), key=lambda r: r.place)] == list(seen)


def test_empty(spark):
    tree, got = run(spark, [], files={"A": "f"})
    assert got["A"].is_end and Counter(got) == {"A": 1} or set(got) == {"A"}
    none = trees.call_tree(spark.createDataFrame(BRANCH, EDGES), spark.createDataFrame([], "id string"), spark.createDataFrame([], "id string, file string"))
    assert none.count() == 0 and trees.tree_totals(none).first().nodes == 0
