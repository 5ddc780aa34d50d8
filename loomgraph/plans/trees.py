"""Call chains as trees: breadth first, each node once, where its first parent in order stands; without enumerating paths.

A level is one join of its nodes with the edges and one anti-join with the nodes before. Of a level's new nodes the first ones, as many as the budget leaves,
are kept: by the place of the parent, then the line of the call, then the node. The budget bounds all nodes of the tree, and with them what one task puts in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, written
from .graph import reversed_edges

#: Fixed value: nodes of a tree.
MOST_NODES = 500


def call_tree(edges: DataFrame, starts: DataFrame, files: DataFrame, max_depth: int = 15, up: bool = False, most: int = MOST_NODES, scope: str | None = None) -> DataFrame:
    """id, parent, depth, place, line, file, crosses, leaves_scope, is_end, above of the nodes that the starts (id) reach.

    edges: src, dst, line, and if it has that column, follow: where it is false the edge shows its dst, which is not expanded. files: id, file. place: in the order of the
    tree; line: of the first call that attaches the node; crosses: its parent stands in another file; leaves_scope: its file does not begin with scope, so it is
    not expanded; is_end: no call leads from it to a node of the tree (an entry point upward, a leaf downward); above: its ancestors.
    Edges without a dst attach nothing. Of repeated edges the least line counts. A node without a file crosses nothing and leaves no scope.
    """
    e = reversed_edges(edges) if up else edges
    follow = F.coalesce("follow", F.lit(True)) if "follow" in edges.columns else F.lit(True)
    e = e.filter("dst is not null").groupBy("src", "dst").agg(F.min("line").alias("line"), F.max(follow).alias("follow"))
    e = written(e.join(files.select(F.col("id").alias("dst"), "file"), "dst", "left"), "tree-edges")
    first = Window.partitionBy().orderBy("id")
    outside = (lambda file: F.coalesce(~F.startswith(file, F.lit(scope)), F.lit(False))) if scope is not None else lambda file: F.lit(False)
    root = starts.select("id").distinct().orderBy("id").limit(most).join(files.select("id", "file"), "id", "left").dropDuplicates(["id"])
    level = root.select(
        "id", F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(0).alias("depth"), F.row_number().over(first).alias("place"), F.lit(None).cast(edges.schema["line"].dataType).alias("line"),
        "file", F.lit(False).alias("crosses"), F.lit(False).alias("leaves_scope"), F.lit(True).alias("open"), F.array().cast(f"array<{edges.schema['src'].dataType.simpleString()}>").alias("above"),
    )
    level = nodes = written(level, "tree")
    total, levels = level.count(), [level]
    for depth in range(1, max_depth + 1):
        if total >= most:
            break
        at = level.filter("open").select(F.col("id").alias("src"), "place", F.col("file").alias("parent_file"), "above")
        met = at.join(e, "src").withColumn("id", F.col("dst")).join(nodes.select("id"), "id", "left_anti")
        one = met.groupBy("id").agg(F.min(F.struct((~F.col("follow")).alias("shut"), "place", "line", "src", "parent_file", "above")).alias("f"), F.first("file").alias("file"))
        order = Window.partitionBy().orderBy("f.place", "f.line", "id")
        kept = one.orderBy("f.place", "f.line", "id").limit(most - total)
        out = outside(F.col("file"))
        new = kept.select(
            "id", F.col("f.src").alias("parent"), F.lit(depth).alias("depth"), (F.row_number().over(order) + total).alias("place"), F.col("f.line").alias("line"), "file",
            (F.coalesce(F.col("file") != F.col("f.parent_file"), F.lit(False)) & ~out).alias("crosses"), out.alias("leaves_scope"), (~F.col("f.shut") & ~out).alias("open"),
            F.concat("f.above", F.array("f.src")).alias("above"),
        )
        level = written(new, "tree")
        n = level.count()
        if not n:
            break
        total += n
        levels.append(level)
        nodes = nodes.unionByName(level)
    parents = nodes.filter(F.col("open") & (F.col("depth") < max_depth)).select(F.col("id").alias("src"))
    having = e.select("src", "dst").join(F.broadcast(parents), "src").join(F.broadcast(nodes.select(F.col("id").alias("dst"))), "dst").select(F.col("src").alias("id"), F.lit(True).alias("has")).distinct()
    done = written(nodes.join(having, "id", "left").withColumn("is_end", F.col("has").isNull()).drop("has"), "tree-nodes")
    dropped(e, *levels)
    return done


def tree_totals(tree: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """One row: nodes, ends, crossing, out_of_scope, max_depth, truncated."""
    return tree.agg(
        F.count("*").alias("nodes"), F.count_if("is_end").alias("ends"), F.count_if("crosses").alias("crossing"), F.count_if("leaves_scope").alias("out_of_scope"),
        F.max("depth").alias("max_depth"), (F.count("*") >= most).alias("truncated"),
    )


def resolved_calls(calls: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (src, dst, line) with kind and follow: calls within a file, imports where the caller's file imports the callee's, else dynamic, which is not followed;
    dst is null where a call could not be resolved. imports: src, dst, of files."""
    of = lambda end, name: files.select(F.col("id").alias(end), F.col("file").alias(name))
    known = imports.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.lit(True).alias("_known")).distinct()
    j = calls.join(of("src", "_from"), "src", "left").join(of("dst", "_to"), "dst", "left")
    j = j.join(known, (F.col("_from") == F.col("_a")) & (F.col("_to") == F.col("_b")), "left")
    kind = F.when(F.col("dst").isNull(), "dynamic").when(F.col("_from").eqNullSafe(F.col("_to")), "calls").when(F.col("_known"), "imports").otherwise("dynamic")
    return j.select("src", "dst", "line", kind.alias("kind")).withColumn("follow", F.col("kind") != "dynamic")


def chain_edges(tree: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """src, dst, kind, line, depth, first, back_edge of every edge (src, dst, kind, line, follow) that leaves an expanded node of the tree.

    first: the edge by which its dst stands in the tree; back_edge: its dst is its src or stands above it, so that the chain would go round.
    The tree has a bounded number of nodes and is broadcast.
    """
    at = tree.filter(F.col("open") & (F.col("depth") < max_depth)).select(F.col("id").alias("src"), (F.col("depth") + 1).alias("depth"), "above")
    parent = tree.filter("parent is not null").select(F.col("id").alias("_id"), F.col("parent").alias("_parent"))
    one = edges.groupBy("src", "dst", "kind").agg(F.min("line").alias("line"))
    j = one.join(F.broadcast(at), "src").join(F.broadcast(parent), F.col("dst") == F.col("_id"), "left")
    back = F.coalesce((F.col("dst") == F.col("src")) | F.array_contains("above", F.col("dst")), F.lit(False))
    return j.select("src", "dst", "kind", "line", "depth", F.coalesce(F.col("_parent") == F.col("src"), F.lit(False)).alias("first"), back.alias("back_edge"))
