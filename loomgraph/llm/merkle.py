"""Merkle manifest of a dataset: a tree of digests for each source, a tree over those, and for each row a proof that leads from its leaf to the root.

H is the lower-case hex sha256 of its inputs, one after the other, digests as hex text. A leaf is H of a row's fields, each `-` if null, else its number of
UTF-8 bytes, `:` and its value. Nodes stand in order; while there are several, every FAN consecutive ones become one, which is their H.

Spark computes the leaves where the rows are, numbers them within their source by a range partitioning and the counts of its parts, and deals them out in
buckets of FAN ** DEPTH consecutive leaves, aligned with the tree. In the tasks DuckDB works on whole buckets that come as Arrow tables: each level is one query with
an ordered string_agg and sha256. Spark combines the roots of the buckets, level by level, up to the sources' roots and the root of all, and gives each bucket
the rest of its proof as one more row; with it DuckDB makes proofs and folds leaves. After the leaves, texts are not touched again. No task holds more than a few
buckets, however large a source is, and nothing but the numbers of levels reaches the driver.

Defined cases: rows of one source and id stand in order of their leaves, null ids first; a null source is a source of its own and comes first; repeated rows are leaves
of their own; a table of one row has its leaf as root and an empty proof; null and empty texts differ; an empty table yields no rows; columns that are not among the
fields count for nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, dropped, table, written

#: Nodes below a node; levels that a bucket holds; leaves that a task works on at once, in whole buckets.
FAN, DEPTH, CHUNK = 16, 3, 8192
SPAN = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<k:int,text:string>>"
#: Low bits of monotonically_increasing_id() that number the rows of a partition.
ROW_BITS = 33


def digest(values: Sequence[Column]) -> Column:
    """H of fields, as 32 bytes."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(v.cast("string")) for v in values]).cast("binary"), 256))


def tree_of(source: Column) -> Column:
    """Bytes that stand for a source and sort as sources do."""
    return F.when(source.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), source.cast("string").cast("binary")))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with pos, from 0 within the group, and n, the group's number of rows. No window holds more than a row for each partition and group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = (group, *order)
    placed = written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", ROW_BITS)
    w = Window.partitionBy("_group").orderBy("_part")
    starts = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_place").alias("_from"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy("_group")))
    joined = placed.join(starts, (F.col(group) == F.col("_group")) & (part == F.col("_part")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_from")).alias("pos"), "n")


def levels(n: int) -> int:
    """Levels above n nodes."""
    k = 0
    while FAN**k < n:
        k += 1
    return k


# -- buckets, in the tasks


def _whole(batches: Iterator[pa.RecordBatch], first: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.Table]:
    """Tables of whole buckets, which come one after the other, with g, their number in the table. first: which rows, by pos, begin a bucket."""

    def numbered(t: pa.Table) -> pa.Table:
        return t.append_column("g", pa.array(np.cumsum(first(t.column("pos").to_numpy()))))

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            t = pa.Table.from_batches(held)
            begins = np.flatnonzero(first(t.column("pos").to_numpy()))
            if begins[-1] > 0:
                yield numbered(t.slice(0, begins[-1]))
                t = t.slice(begins[-1])
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield numbered(pa.Table.from_batches(held))


def _duck(rows: pa.Table):
    """A connection with the leaves as level 0: g, pos, n, d."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.register("input", rows)
    con.execute("CREATE TEMP TABLE level0 AS SELECT g, pos, n, lower(hex(leaf)) AS d FROM input WHERE pos >= 0")
    for k in range(1, DEPTH + 1):
        # a source of one node at this level is done with
        con.execute(f"""CREATE TEMP TABLE level{k} AS SELECT g, up AS pos, n, text, CASE WHEN n > {FAN ** (k - 1)} THEN sha256(text) ELSE text END AS d
            FROM (SELECT g, pos // {FAN} AS up, any_value(n) AS n, string_agg(d, '' ORDER BY pos) AS text FROM level{k - 1} GROUP BY g, up)""")
    return con


def bucket_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole(batches, lambda pos: pos % SPAN == 0):
        with _duck(t) as con:
            out = con.sql(f"""SELECT i.tree, i.pos // {SPAN} AS pos, (i.n + {SPAN - 1}) // {SPAN} AS m, r.d
                FROM input i JOIN level{DEPTH} r USING (g) WHERE i.pos % {SPAN} = 0""").to_arrow_table()
        yield from out.cast(pa.schema([("tree", pa.binary()), ("pos", pa.int64()), ("m", pa.int64()), ("d", pa.string())])).to_batches()


PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def bucket_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's first row, at -1, has its path to the root; the others are its leaves, with what they are claimed to be."""
    step = "substr({t}, 1, 64 * {k})", "substr({t}, 64 * {k} + 65)"
    for t in _whole(batches, lambda pos: pos < 0):
        with _duck(t) as con:
            con.execute("CREATE TEMP TABLE rest AS SELECT g, subroot, root, path FROM input WHERE pos < 0")
            con.execute("CREATE TEMP TABLE s AS SELECT doc_id, g, pos, n, lower(hex(leaf)) AS leaf, lower(hex(coalesce(claimed, leaf))) AS f, '' AS proof FROM input WHERE pos >= 0")
            for k in range(1, DEPTH + 1):
                left, right = (x.format(t="t.text", k=f"(s.pos % {FAN})") for x in step)
                con.execute(f"""CREATE OR REPLACE TEMP TABLE s AS SELECT doc_id, s.g, t.pos, s.n, leaf,
                    CASE WHEN s.n > {FAN ** (k - 1)} THEN sha256({left} || f || {right}) ELSE f END AS f,
                    CASE WHEN s.n > {FAN ** (k - 1)} THEN proof || {left} || {right} ELSE proof END AS proof
                    FROM s JOIN level{k} t ON t.g = s.g AND t.pos = s.pos // {FAN}""")
            for i in range(1, con.execute("SELECT max(len(path)) FROM rest").fetchall()[0][0] + 1):
                left, right = (x.format(t=f"path[{i}].text", k=f"path[{i}].k") for x in step)
                con.execute(f"""CREATE OR REPLACE TEMP TABLE s AS SELECT doc_id, s.g, pos, n, leaf,
                    CASE WHEN len(path) >= {i} THEN sha256({left} || f || {right}) ELSE f END AS f,
                    CASE WHEN len(path) >= {i} THEN proof || {left} || {right} ELSE proof END AS proof FROM s JOIN rest USING (g)""")
            out = con.sql("SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM s JOIN rest USING (g)").to_arrow_table()
        names = out.schema.names
        yield from out.cast(pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in names[1:-1]], ("verified", pa.bool_())])).to_batches()


# -- what is above the buckets, in Spark


def climb(nodes: DataFrame, above: int) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, pos, m of the tree, d) with path, from each to its tree's root; and tree, d of the roots."""
    if not above:
        return nodes.withColumn("path", F.array().cast(PATH)), nodes.select("tree", "d")
    runs = nodes.groupBy("tree", F.expr(f"pos div {FAN}").alias("pos")).agg(F.max("m").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]), "").alias("text"))
    d = F.when(F.col("m") > 1, F.sha2(F.col("text").cast("binary"), 256)).otherwise(F.col("text"))
    parents = written(runs.select("tree", "pos", F.expr(f"(m + {FAN - 1}) div {FAN}").alias("m"), d.alias("d"), "text"), "merkle-level")
    up, top = climb(parents, above - 1)
    up = up.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("text").alias("_text"), F.col("path").alias("_path"))
    own = F.array(F.struct((F.col("pos") % FAN).cast("int").alias("k"), F.col("_text").alias("text")))
    joined = nodes.join(up, (F.col("tree") == F.col("_tree")) & (F.expr(f"pos div {FAN}") == F.col("_pos")))
    return joined.select(*nodes.columns, F.when(F.col("m") > 1, F.concat(own, "_path")).otherwise(F.col("_path")).alias("path")), top


class Manifest:
    """The trees over leaves (doc_id, tree, leaf, claimed): their roots, and the leaves' proofs."""

    def __init__(self, leaves: DataFrame):
        self.parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = written(leaves, "merkle-leaves")  # ranges are found by a pass of their own, which would read and hash all texts once more
        self.leaves = ranked(own, "tree", ("doc_id", "leaf", "claimed"))
        rows = self.leaves.select("tree", "pos", "n", "leaf", F.expr(f"pos div {SPAN}").alias("bucket"))
        roots = written(self._dealt(rows).drop("bucket").mapInArrow(bucket_roots, "tree binary, pos bigint, m bigint, d string"), "merkle-buckets")
        of_buckets, subroots = climb(roots, levels(roots.agg(F.max("m")).first()[0] or 1))
        one = F.lit(b"").alias("one")
        sources = written(ranked(subroots.select(one, F.col("tree").alias("of"), "d"), "one", ("of",)), "merkle-sources")
        of_sources, top = climb(sources.select(F.col("one").alias("tree"), "pos", F.col("n").alias("m"), "d", "of"), levels(sources.count()))
        #: tree (see tree_of), subroot, root, path.
        self.sources = written(of_sources.select(F.col("of").alias("tree"), F.col("d").alias("subroot"), "path").crossJoin(top.select(F.col("d").alias("root"))), "merkle-paths")
        s = self.sources.select(F.col("tree").alias("_tree"), "subroot", "root", F.col("path").alias("_path"))
        self.rest = of_buckets.join(s, F.col("tree") == F.col("_tree")).select("tree", F.col("pos").alias("bucket"), "subroot", "root", F.concat("path", "_path").alias("path"))
        dropped(own)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.parts, "tree", "bucket").sortWithinPartitions("tree", "bucket", "pos")

    def proofs(self) -> DataFrame:
        """For each leaf doc_id, leaf, subroot, root, proof_sha256 (of the siblings), folded_root (of what is claimed, or else the leaf, and the siblings), verified."""
        leaves = self.leaves.select("tree", F.expr(f"pos div {SPAN}").alias("bucket"), "pos", "n", "doc_id", "leaf", "claimed")
        both = leaves.unionByName(self.rest.withColumn("pos", F.lit(-1).cast("bigint")), allowMissingColumns=True)
        return self._dealt(both).drop("tree", "bucket").mapInArrow(bucket_proofs, PROVEN)


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, claimed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf, claimed: the leaf with some fields replaced, where `when` holds, else null."""
    fields = {c: docs[c] for c in FIELDS}
    other = F.when(when, digest([*(fields | (claimed or {})).values()])) if when is not None else F.lit(None).cast("binary")
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), tree_of(docs["source"]).alias("tree"), digest([*fields.values()]).alias("leaf"), other.alias("claimed"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Manifest(leaves(docs, {"text": lowered(docs["text"])}, bucket("doc_id", 5) == 0)).proofs()


_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
#: crc32 of the decimal doc_id, bit by bit.
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_H = lambda text: "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in FIELDS) + ")"
_LEVELS = """SELECT tree, level + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {0}) WHERE c > 1 GROUP BY tree, level, pos // 16"""
_FOLD = """SELECT f.row, f.tree, f.level + 1, f.pos // 16, sha256(substr(r.text, 1, 64 * (f.pos % 16)) || f.d || substr(r.text, 64 * (f.pos % 16) + 65)),
    f.proof || substr(r.text, 1, 64 * (f.pos % 16)) || substr(r.text, 64 * (f.pos % 16) + 65) FROM {0} f JOIN {1} r ON r.tree = f.tree AND r.level = f.level AND r.up = f.pos // 16"""
SQL = {
    "op11_merkle_manifest": f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_H('text')} AS leaf, {_H(_LOWER)} AS other FROM documents),
    leaves AS (SELECT *, CASE WHEN tampered THEN other ELSE leaf END AS claimed, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM (SELECT *, coalesce({_CRC} % 5 = 0, false) AS tampered FROM docs)),
    nodes(tree, level, pos, d) AS (SELECT tree, 0, pos, leaf FROM leaves UNION ALL {_LEVELS.format('nodes')}),
    runs AS (SELECT tree, level, pos // 16 AS up, string_agg(d, '' ORDER BY pos) AS text FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS c FROM nodes) WHERE c > 1 GROUP BY ALL),
    sub AS (SELECT tree AS of, arg_max(d, level) AS d, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes GROUP BY tree),
    above(tree, level, pos, d) AS (SELECT '', 0, pos, d FROM sub UNION ALL {_LEVELS.format('above')}),
    above_runs AS (SELECT tree, level, pos // 16 AS up, string_agg(d, '' ORDER BY pos) AS text FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS c FROM above) WHERE c > 1 GROUP BY ALL),
    inner_fold(row, tree, level, pos, d, proof) AS (SELECT row, tree, 0, pos, claimed, '' FROM leaves UNION ALL {_FOLD.format('inner_fold', 'runs')}),
    half AS (SELECT row, any_value(tree) AS tree, arg_max(d, level) AS d, arg_max(proof, level) AS proof FROM inner_fold GROUP BY row),
    outer_fold(row, tree, level, pos, d, proof) AS (SELECT row, '', 0, s.pos, half.d, proof FROM half JOIN sub s ON s.of = half.tree UNION ALL {_FOLD.format('outer_fold', 'above_runs')}),
    folded AS (SELECT row, arg_max(d, level) AS d, arg_max(proof, level) AS proof FROM outer_fold GROUP BY row), root AS (SELECT arg_max(d, level) AS d FROM above)
    SELECT l.doc_id, l.leaf, sub.d AS subroot, root.d AS root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = root.d AS verified
    FROM leaves l JOIN folded f USING (row) JOIN sub ON sub.of = l.tree CROSS JOIN root"""
}
