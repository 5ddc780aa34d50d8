"""Traversal of edge tables (src, dst): neighbours, bounded paths, reachability, induced subgraphs.

Two kinds of recursion are kept apart. Paths are enumerated only up to a bound, each level from the last one's frontier, which
is written so that no level is computed twice. Reachability never enumerates paths: a frontier loses what was seen before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


def reversed_edges(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(c).alias(swap.get(c, c)) for c in edges.columns])


def clamp_depth(depth: float, least: int = 1, most: int = 15) -> int:
    return max(least, min(most, round(depth)))


def adjacency(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """node, neighbour: distinct, in both directions. parts: tasks (see storage.tasks); without it, the session's."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    both = both.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour")))
    return (both if parts is None else both.repartition(parts, "node", "neighbour")).distinct()


def paths(edges: DataFrame, starts: DataFrame, max_depth: int, up: bool = False, node_filter: DataFrame | None = None) -> DataFrame:
    """depth, nodes, back_edge of every path from the starts (id) that uses no edge twice, of 1 to max_depth edges.

    up follows edges against their direction. node_filter (id): nodes that may stand after the first; others are not entered.
    back_edge: the last node stands earlier in the path already.
    """
    e = (reversed_edges(edges) if up else edges).select("src", "dst")
    if node_filter is not None:
        e = e.join(node_filter.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    e = written(e.distinct(), "edges")
    at = starts.select(F.col("id").alias("last"), F.array("id").alias("nodes"), F.lit(0).alias("depth"))
    levels = []
    for _ in range(max_depth):
        step = at.join(e, at["last"] == e["src"])
        # an edge is used again if its two nodes stand next to each other in the path
        pairs = F.zip_with(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", 2, F.size("nodes")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
        new = step.filter(~F.exists(pairs, lambda p: (p["src"] == F.col("src")) & (p["dst"] == F.col("dst"))))
        at = written(new.select(F.col("dst").alias("last"), F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("depth") + 1).alias("depth")), "level")
        levels.append(at)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("depth", "nodes", F.array_contains(F.slice("nodes", 1, F.size("nodes") - 1), F.col("last")).alias("back_edge"))


def path_edges(found: DataFrame) -> DataFrame:
    """src, dst, depth: each edge of the paths once, with the least depth at which it stands. Paths hold all their prefixes' edges,
    so that the last edge of each path is enough."""
    last = found.select(F.element_at("nodes", -2).alias("src"), F.element_at("nodes", -1).alias("dst"), "depth")
    return last.groupBy("src", "dst").agg(F.min("depth").alias("depth"))


def tree(edges: DataFrame, starts: DataFrame, max_depth: int, up: bool = False) -> DataFrame:
    """src, dst, depth: what path_edges() of all paths would give, without their enumeration.

    An edge stands first at the end of a shortest path to its source, which no path of its own can shorten.
    """
    near = reachable(edges, starts, up, max_depth - 1).select(F.col("id").alias("src"), "depth")
    e = (reversed_edges(edges) if up else edges).select("src", "dst").distinct()
    return e.join(near, "src").select("src", "dst", (F.col("depth") + 1).alias("depth"))


def tree_stats(tree: DataFrame, starts: DataFrame, node_file: DataFrame) -> DataFrame:
    """One row: nodes, edges, leaves, cross_file (edges between files), max_depth of path_edges(). node_file: id, file."""
    nodes = starts.select("id").unionByName(tree.select(F.col("dst").alias("id"))).distinct()
    leaves = nodes.join(tree.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    f = node_file.select("id", "file")
    crossing = (
        tree.join(f.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
        .agg(F.count("*").alias("n_edges"), F.count_if(F.col("a") != F.col("b")).alias("n_cross_file"), F.max("depth").alias("max_depth"))
    )
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(leaves.agg(F.count("*").alias("n_leaves"))).crossJoin(crossing)


def reachable(edges: DataFrame, starts: DataFrame, up: bool = False, max_depth: int | None = None) -> DataFrame:
    """id, depth of every node that the starts (id) reach, themselves at depth 0; unbounded without max_depth.

    A round costs one join of the frontier with the edges and one anti-join with what was seen, which is read from the rounds before.
    """
    e = written((reversed_edges(edges) if up else edges).select("src", "dst").distinct(), "edges")
    frontier = seen = written(starts.select("id", F.lit(0).alias("depth")).distinct(), "frontier")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(e, frontier["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = written(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """id and where it stands: self, down, up or both, from two independent walks."""
    down, up = (reachable(edges, starts, u).filter("depth > 0").select("id", F.lit(u).alias("up")) for u in (False, True))
    placed = down.unionByName(up).groupBy("id").agg(F.min("up").alias("a"), F.max("up").alias("b"))
    own = starts.select("id", F.lit("self").alias("side")).distinct()
    side = F.when(F.col("a") != F.col("b"), "both").when(F.col("a"), "up").otherwise("down")
    return own.unionByName(placed.join(own, "id", "left_anti").select("id", side.alias("side")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    a = nodes.select(F.col("id").alias("src")).distinct()
    return edges.join(a, "src", "left_semi").join(a.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*edges.columns)


def busiest(edges: DataFrame) -> DataFrame:
    """id of the node with most outgoing edges, the least of several."""
    return edges.groupBy(F.col("src").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def totals(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """One row: nodes reachable, and the edges that leave them."""
    seen = reachable(edges, starts)
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return seen.join(degree, "id", "left").agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"))


def resolve_start(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each wanted name (and file, if not null): how many symbols it names, which is the first, and missing, found or ambiguous."""
    # symbols are counted by name and file, then by name, so that no row of wanted meets the symbols one by one
    here = symbols.groupBy(F.col("name").alias("wanted"), F.col("file_path").alias("wanted_file")).agg(F.count("*").alias("n"), F.min(F.struct("file_path", "start_line", "sym_id")).alias("first"))
    anywhere = here.groupBy("wanted").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    w = wanted.groupBy(F.col("name").alias("wanted"), F.col("file_path").alias("wanted_file")).agg(F.count("*").alias("asked"))
    g = w.filter("wanted_file is null").join(anywhere, "wanted", "left").unionByName(w.filter("wanted_file is not null").join(here, ["wanted", "wanted_file"], "left"))
    g = g.withColumn("candidates", F.coalesce("n", F.lit(0)) * F.col("asked"))
    status = F.when(F.col("candidates") == 0, "missing").when((F.col("candidates") > 1) & F.col("wanted_file").isNull(), "ambiguous").otherwise("found")
    return g.select(F.col("wanted").alias("name"), F.col("wanted_file").alias("file_path"), "candidates", F.col("first.sym_id").alias("sym_id"), status.alias("status"))


def joined(values: Column | str, sep: str = ",") -> Column:
    """A set as text, in order."""
    return F.array_join(F.transform(F.array_sort(values), lambda x: x.cast("string")), sep)
