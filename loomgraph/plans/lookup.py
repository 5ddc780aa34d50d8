"""Symbol, dependency and type lookups. Branches are aggregated before they are joined, so that no product of branches arises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dependencies(edges: DataFrame, node: str, other: str, parts: int | None = None) -> DataFrame:
    """node, other, n: a row for each distinct edge, with the number of the node's; a hub's neighbours are rows and no list. parts: tasks (see storage.tasks); without it, the session's."""
    one = dealt(edges.select(node, other), parts, node, other).distinct()
    return dealt(one, parts, node).join(one.groupBy(node).agg(F.count("*").alias("n")), node)


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df in that many parts by hash of the keys; None: as it is."""
    return df if parts is None else df.repartition(parts, *keys)


def page(rows: DataFrame, of: Sequence[str], order: Sequence[str], offset: int, limit: int | None) -> DataFrame:
    """Of each group the rows from offset on, at most limit (None: all), in order (which must be total); nth counts from 1."""
    w = Window.partitionBy(*of).orderBy(*order)
    n = rows.withColumn("nth", F.row_number().over(w))
    return n.filter(F.col("nth") > offset if limit is None else F.col("nth").between(offset + 1, offset + limit))


def direct_importers(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """file_path, name, importers: files that import the file of a symbol of that name.

    Importers are counted by file before files meet names; only names that one path has in several files are counted over their imports.
    """
    i = imports.select("src", F.col("dst").alias("file_id"))
    of = i.filter("file_id is not null").groupBy("file_id").agg(F.count_distinct("src").alias("importers"))
    named = symbols.select("file_path", "name", "file_id").distinct().join(of, "file_id")
    files = named.groupBy("file_path", "name").agg(F.count("*").alias("_n"), F.max("importers").alias("importers"))
    several = files.filter("_n > 1").select(F.col("file_path").alias("_p"), F.col("name").alias("_q"))
    same = F.col("file_path").eqNullSafe(F.col("_p")) & F.col("name").eqNullSafe(F.col("_q"))
    counted = named.join(several, same).join(i, "file_id").groupBy("file_path", "name").agg(F.count_distinct("src").alias("importers"))
    return files.filter("_n = 1").select("file_path", "name", "importers").unionByName(counted)


def direct_imports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Upstream: file and the symbols that it imports; downstream: file and the files that import any symbol of it."""
    i = imports.select("src", F.col("dst").alias("file_id"))
    up = symbols.select("file_id", "sym_id").join(i, "file_id").select(F.lit("up").alias("direction"), F.col("src").alias("file_id"), "sym_id")
    down = i.join(symbols.select("file_id"), "file_id", "left_semi").select(F.lit("down").alias("direction"), "file_id", F.col("src").alias("sym_id")).distinct()
    return up.unionByName(down)


def calls_between(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """from_file, to_file, src, dst of the calls that leave their file. functions: id, file."""
    a = functions.select(F.col("id").alias("src"), F.col("file").alias("from_file"))
    b = functions.select(F.col("id").alias("dst"), F.col("file").alias("to_file"))
    return calls.join(a, "src").join(b, "dst").filter("from_file <> to_file").select("from_file", "to_file", "src", "dst")


def usages(symbols: DataFrame, calls: DataFrame, functions: DataFrame, imports: DataFrame, parts: int | None = None) -> DataFrame:
    """Each symbol with the numbers of its callers, of their files, and of the files that import its own. Who they are is for callers() to say, a page at a time.

    parts: tasks (see storage.tasks) for the calls, by their caller; without it, the session's.
    """
    by = dealt(calls, parts, "src").join(functions.select(F.col("id").alias("src"), "file"), "src")
    # a row for each caller and one for each file, so that what is distinct of both is found in tasks of the given number
    kind = dict(by.dtypes)
    pair = F.explode(F.array(F.struct("src", F.lit(None).cast(kind["file"]).alias("file")), F.struct(F.lit(None).cast(kind["src"]).alias("src"), "file")))
    each = by.select(F.col("dst").alias("sym_id"), pair.alias("x")).select("sym_id", "x.src", "x.file")
    c = dealt(each, parts and 2 * parts, "sym_id", "src", "file").distinct().groupBy("sym_id").agg(F.count("src").alias("callers"), F.count("file").alias("caller_files"))
    i = imports.groupBy(F.col("dst").alias("file_id")).agg(F.count_distinct("src").alias("importers"))
    j = symbols.join(c, "sym_id", "left").join(i, "file_id", "left")
    return j.select("name", "sym_id", "kind", "file_path", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("caller_files", F.lit(0)).alias("caller_files"), F.coalesce("importers", F.lit(0)).alias("importers"))


def callers(symbols: DataFrame, calls: DataFrame, functions: DataFrame, offset: int = 0, limit: int = 50, parts: int | None = None) -> DataFrame:
    """sym_id, nth, caller, file: who calls each of the symbols, in order of file and caller, a page at a time. parts: tasks (see storage.tasks); without it, the session's."""
    c = dealt(calls.select(F.col("src").alias("caller"), F.col("dst").alias("sym_id")), parts, "caller").distinct()
    named = c.join(functions.select(F.col("id").alias("caller"), "file"), "caller")
    asked = dealt(named, parts, "sym_id").join(symbols.select("sym_id").distinct(), "sym_id", "left_semi")
    return page(asked, ["sym_id"], ["file", "caller"], offset, limit).select("sym_id", "nth", "caller", "file")


def symbols_by_name(symbols: DataFrame, names: Sequence[str], most: int = 10) -> DataFrame:
    """wanted, sym_id, name, how: symbols of exactly these names, or where there is none, up to `most` whose name contains it.

    The names are a literal of the plan, so one pass over the symbols answers all of them.
    """
    hit = F.filter(F.array(*map(F.lit, names)), lambda w: F.contains(F.lower("name"), F.lower(w)))
    s = symbols.select("sym_id", "name", F.explode(hit).alias("wanted")).withColumn("how", F.when(F.col("name") == F.col("wanted"), "exact").otherwise("fuzzy"))
    exact = s.filter("how = 'exact'")
    w = Window.partitionBy("wanted").orderBy("name", "sym_id")
    fuzzy = s.join(exact.select("wanted").distinct(), "wanted", "left_anti").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return exact.select("wanted", "sym_id", "name", "how").unionByName(fuzzy.select("wanted", "sym_id", "name", "how"))


def with_source(symbols: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """symbols with lines, those of their file from start_line to end_line; the file is found by its whole key."""
    f = files.select(*keys, F.split("content", "\n").alias("_all"))
    j = symbols.join(f, list(keys))
    span = F.slice("_all", F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.greatest("start_line", F.lit(1)) + 1, F.lit(0)))
    return j.select(*symbols.columns, span.alias("lines"))


def type_info(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions and classes with the number of their callers and of calls that do not fit their types."""
    c = calls.groupBy(F.col("dst").alias("sym_id")).agg(F.count_distinct("src").alias("callers"), F.count_if("has_type_mismatch").alias("mismatches"))
    j = symbols.filter(F.col("kind").isin("function", "class")).join(c, "sym_id", "left")
    return j.select("name", "file_path", "kind", "signature", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"))


def exports_by_kind(exports: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """package, kind, n, nth, name: the names of each package and kind in order, or a page of them, with their number; rows without a name are dropped. exports: package, kind, name, id."""
    named = exports.filter("name is not null")
    n = named.groupBy("package", "kind").agg(F.count("*").alias("n"))
    return page(named, ["package", "kind"], ["name", "id"], offset, limit).join(n, ["package", "kind"]).select("package", "kind", "n", "nth", "name")


def graph_nodes(repositories: DataFrame, files: DataFrame, symbols: DataFrame, repo_id: int) -> DataFrame:
    """label, key, display of all nodes of one repository."""
    own = F.col("repo_id") == repo_id
    base = F.element_at(F.split("file_path", "/"), -1)
    return (
        files.filter(own).select(F.lit("File").alias("label"), F.col("file_path").alias("key"), base.alias("display"))
        .unionByName(symbols.filter(own).select(F.lit("Symbol").alias("label"), F.concat("file_path", F.lit("::"), "sym_id").alias("key"), F.coalesce("name", base).alias("display")))
        .unionByName(repositories.filter(own).select(F.lit("Repository").alias("label"), F.col("url").alias("key"), F.col("name").alias("display")))
    )


def flow_counts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """file_id with the numbers of flows that begin and that end in it."""
    o = findings.groupBy(F.col("source_file").alias("file_id")).agg(F.count("*").alias("flows_out"))
    i = findings.groupBy(F.col("sink_file").alias("file_id")).agg(F.count("*").alias("flows_in"))
    j = files.join(o, "file_id", "left").join(i, "file_id", "left")
    return j.select("file_id", F.coalesce("flows_out", F.lit(0)).alias("flows_out"), F.coalesce("flows_in", F.lit(0)).alias("flows_in"))
