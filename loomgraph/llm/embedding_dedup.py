"""Near-dedup of embeddings by an epsilon grid order join.

Unit vectors of cosine c or more are at most eps = sqrt(2 - 2 c) apart. They are turned to their principal axes, and those of a
label stand in order of their grid cells of width eps along the leading axes. Consecutive vectors form blocks, consecutive blocks
form intervals, and so on upward; each knows the box that holds its vectors on all axes. The join descends from pairs of whole
labels to pairs of intervals to pairs of blocks, and a pair whose boxes are more than eps apart is skipped with all below it.
Only the remaining pairs of blocks are multiplied out, in double precision, on the vectors as they were.

A pair of blocks yields for each vector the number of its links and a forest of the links, so results grow with the vectors and
not with the links. Equal vectors of a label are one, with a count. Defined cases: a null label or id, a null or zero vector,
one with null or non-finite components are linked with nothing, and vectors of different lengths are not linked; repeated rows of
a vec_id are vectors of their own and get the same component; a null id has no component and is kept; an empty table yields no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .components import components

#: Vectors of a block, blocks of an interval, intervals of the next level, and so on.
BLOCK, FAN = 512, 8
#: Leading axes that the order uses; vectors that the axes are fitted on (any orthogonal axes give right results).
AXES, SAMPLE = 6, 8192
#: Room for rounding in distances that exclude a pair.
SLACK = 1e-9


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (double) of what can link."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.select("vec_id", "label", v.alias("v")).filter("vec_id is not null and label is not null and v is not null")
    return ok.filter(finite).filter(F.exists("v", lambda x: x != 0)).select("vec_id", "label", F.col("v").alias("embedding"))


def _unit(m: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal_axes(distinct: DataFrame, dims: int) -> np.ndarray:
    n = max(1, distinct.count())
    u = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = distinct.filter(u < min(1.0, SAMPLE / n)).select("embedding").limit(2 * SAMPLE).toPandas()
    if len(rows) < 2:
        return np.eye(dims)
    x = _unit(np.stack(rows["embedding"].to_numpy()))
    return np.linalg.eigh(np.cov(x.T).reshape(dims, dims))[1][:, ::-1].copy()


def _placed(distinct: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """distinct with its cell on each leading axis."""
    held = distinct.sparkSession.sparkContext.broadcast(axes[:, :AXES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            cells = np.floor(_unit(_matrix(b.column(b.schema.get_field_index("embedding")))) @ held.value / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    return distinct.mapInArrow(run, f"{_ddl(distinct)}, cells array<int>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _blocks(ordered: DataFrame, axes: np.ndarray, single: bool) -> DataFrame:
    """label, part, nth, ids, counts, data (the vectors), low, high (box on all axes), from rows that stand in order.

    A block is full, or ends with its label or its partition; part and nth number it in that order.
    """
    held = ordered.sparkSession.sparkContext.broadcast(axes)
    kind = ordered.schema["label"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0
        rest: pd.DataFrame | None = None

        def made(f: pd.DataFrame) -> dict:
            nonlocal nth
            m = np.stack(f["embedding"].to_numpy())
            y = _unit(m) @ held.value
            nth += 1
            data = m.astype(np.float32 if single else np.float64).tobytes()
            return {"label": f["label"].iloc[0], "part": part, "nth": nth - 1, "ids": f["rep"].to_numpy(np.int64), "counts": f["n"].to_numpy(np.int64), "data": data, "low": y.min(0), "high": y.max(0)}

        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            out, at = [], 0
            for end in [*(np.flatnonzero(f["label"].to_numpy()[1:] != f["label"].to_numpy()[:-1]) + 1).tolist(), len(f)]:
                while end - at >= BLOCK or at < end < len(f):
                    out.append(made(f.iloc[at : min(end, at + BLOCK)]))
                    at = min(end, at + BLOCK)
            rest = f.iloc[at:]
            if out:
                yield pd.DataFrame(out)
        if rest is not None and len(rest):
            yield pd.DataFrame([made(rest)])

    return ordered.mapInPandas(run, f"label {kind}, part bigint, nth bigint, ids array<bigint>, counts array<bigint>, data binary, low array<double>, high array<double>")


def _box_distance2(a: str, b: str):
    gap = F.zip_with(F.zip_with(f"{a}low", f"{b}high", lambda x, y: x - y), F.zip_with(f"{b}low", f"{a}high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)


def _numbered(blocks: DataFrame) -> DataFrame:
    """blocks with block, a number in their order in which every FAN neighbours of a partition have a parent of their own."""
    most = blocks.agg(F.max("nth")).first()[0] or 0
    room = FAN
    while room <= most:
        room *= FAN
    return blocks.withColumn("block", F.col("part") * room + F.col("nth"))


def _levels(blocks: DataFrame) -> list[DataFrame]:
    """Tables (label, id, parent, low, high) from blocks upward, FAN neighbours of a level making one of the next, up to one for
    a label. Each level has up to an eighth of the rows of the one below."""
    dims = blocks.agg(F.max(F.size("low"))).first()[0]
    level = blocks.select("label", F.col("block").alias("id"), "low", "high")
    levels = []
    while True:
        levels.append(level := level.withColumn("parent", F.floor(F.col("id") / FAN)))
        up = level.groupBy("label", F.col("parent").alias("id")).agg(
            F.array(*[F.min(F.col("low")[i]) for i in range(dims)]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in range(dims)]).alias("high")
        )
        level = written(up, "level")
        if level.agg(F.max("id")).first()[0] == 0:
            levels.append(level)
            return levels


def near_block_pairs(levels: list[DataFrame], eps: float) -> DataFrame:
    """(a, b): the blocks, a <= b in their label's order, whose boxes are near enough, by descent from whole labels."""
    limit = (eps + SLACK) ** 2
    pairs = levels[-1].select("label", F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.select("label", "id", "parent", "low", "high")
        left = child.select("label", F.col("parent").alias("a"), F.col("id").alias("x"), F.col("low").alias("xlow"), F.col("high").alias("xhigh"))
        right = child.select("label", F.col("parent").alias("b"), F.col("id").alias("y"), F.col("low").alias("ylow"), F.col("high").alias("yhigh"))
        j = pairs.join(left, ["label", "a"]).join(right, ["label", "b"]).filter("x <= y").filter(_box_distance2("x", "y") <= limit)
        pairs = written(j.select("label", F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
    return pairs.select(F.col("a").alias("ba"), F.col("b").alias("bb"))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (root, member) that keep what the links (i, j) connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return list(zip(root[at].tolist(), at.tolist()))


def _linked(pairs: DataFrame, least: float, single: bool) -> DataFrame:
    """For each pair of blocks rows (a, b, n): the number n of links of a in it, b null; or an edge a, b of the links' forest, n null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float32 if single else np.float64
        for batch in batches:
            for row in range(len(batch)):
                ba, ids, na, da, bb, jds, nb, db = (c[row].as_py() for c in batch.columns)
                same = ba == bb
                x = _unit(np.frombuffer(da, kind).astype(np.float64).reshape(len(ids), -1))
                y = x if same else _unit(np.frombuffer(db, kind).astype(np.float64).reshape(len(jds), -1))
                near = x @ y.T >= least
                if same:
                    np.fill_diagonal(near, False)
                count = near.astype(np.float64) @ np.array(nb, np.float64)
                edges_n, edges = (len(ids), near) if same else (len(ids) + len(jds), near)
                i, j = np.nonzero(edges)
                names = np.array(ids if same else ids + jds, np.int64)
                forest = _forest(i, j if same else j + len(ids), edges_n)
                a, b, n = [], [], []
                for v in np.flatnonzero(count).tolist():
                    a.append(ids[v]), b.append(None), n.append(int(count[v]))
                if not same:
                    back = np.array(na, np.float64) @ near
                    for v in np.flatnonzero(back).tolist():
                        a.append(jds[v]), b.append(None), n.append(int(back[v]))
                for r, m in forest:
                    a.append(int(names[r])), b.append(int(names[m])), n.append(None)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return pairs.mapInArrow(run, "a bigint, b bigint, n bigint")


def link_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    clean = written(_clean(vectors), "vectors")
    # equal vectors are one; vectors of a label link with those of their own length
    distinct = written(clean.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "distinct")
    member = clean.join(distinct, ["label", "embedding"]).select("vec_id", "label", "rep", "n")
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    counts, edges = [], []
    for d in [r["d"] for r in distinct.select(F.size("embedding").alias("d")).distinct().collect()]:
        own = distinct.filter(F.size("embedding") == d)
        axes = principal_axes(own, d)
        key = [F.col("label"), *[F.col("cells")[i] for i in range(min(AXES, d))], F.col("rep")]
        ordered = _placed(own, axes, eps).repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("cells")
        blocks = _numbered(written(_blocks(ordered, axes, single), "blocks"))
        pairs = near_block_pairs(_levels(blocks), eps)
        left = blocks.select(F.col("block").alias("ba"), F.col("ids").alias("ia"), F.col("counts").alias("na"), F.col("data").alias("da"))
        right = blocks.select(F.col("block").alias("bb"), F.col("ids").alias("ib"), F.col("counts").alias("nb"), F.col("data").alias("db"))
        j = pairs.join(left, "ba").join(right, "bb").select("ba", "ia", "na", "da", "bb", "ib", "nb", "db")
        found = written(_linked(j, least, single), "links")
        counts.append(found.filter("b is null").select("a", "n"))
        edges.append(found.filter("b is not null").select("a", "b"))
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    if not counts:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for more in counts[1:]:
        counts[0] = counts[0].unionByName(more)
    for more in edges[1:]:
        edges[0] = edges[0].unionByName(more)
    n = counts[0].groupBy("a").agg(F.sum("n").alias("links"))
    # copies of a vector link with each other: rep is tied to the ids that share it
    tied = member.filter("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    whole = components(edges[0].unionByName(tied))
    per_row = member.join(n, member["rep"] == n["a"], "left").select("vec_id", "label", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    rows = per_row.groupBy("vec_id", "label", "rep").agg(F.max("links").alias("links"), F.count("*").alias("copies"))
    named = ids.join(distinct, ["label", "embedding"], "left").select("vec_id", "rep")
    out = named.join(rows.groupBy("vec_id", "rep").agg(F.max("links").alias("links")), ["vec_id", "rep"], "left")
    out = out.join(whole.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left")
    c = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("vec_id"), F.lit(True)).alias("kept"))


def op1_grid_order_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


SQL = {"op1_grid_order_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
    m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
    SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN m ON id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON a = vec_id"""}
