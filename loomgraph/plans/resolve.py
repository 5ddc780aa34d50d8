"""Import resolution: candidate paths against the file inventory, barrels, symbols, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import package_name
from ..operators.joins import first_candidate
from ..storage import written

#: Extensions that are tried, in order.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
MAX_HOPS = 10


def normal_path(directory: Column, source: Column) -> Column:
    """directory/source with `.` and `..` taken out."""
    parts = F.filter(F.split(F.concat_ws("/", directory, source), "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(up, "/")


def probes(base: Column) -> Column:
    """The paths that an import may mean, in order: as it is, with an extension, with a script extension exchanged, as a folder's index."""
    bare = F.regexp_replace(base, r"\.(js|mjs|cjs)$", "")
    swapped = F.when(bare != base, F.array(*[F.concat(bare, F.lit(e)) for e in EXTENSIONS])).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS]), swapped, F.array(*[F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS]))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """imports (import_id, from_file, source) with resolved_path, probe, package and resolution_status; dynamic is an import without a source, which is known when it runs.

    aliases: patterns with one star to replacements, tried in order for sources that are not relative.
    """
    directory = F.regexp_replace("from_file", r"/?[^/]*$", "")
    relative = F.startswith("source", F.lit("./")) | F.startswith("source", F.lit("../"))
    target = F.when(relative, normal_path(directory, F.col("source")))
    for pattern, to in (aliases or {}).items():
        head, star, tail = pattern.partition("*")
        fits = F.startswith("source", F.lit(head)) & F.endswith("source", F.lit(tail)) if star else F.col("source") == pattern
        middle = F.substring("source", F.lit(len(head) + 1), F.length("source") - len(head) - len(tail))
        made = F.concat(F.lit(to.partition("*")[0]), middle, F.lit(to.partition("*")[2])) if star else F.lit(to)
        target = F.coalesce(target, F.when(fits, normal_path(F.lit(""), made)))
    i = imports.withColumn("_base", target)
    found = first_candidate(i.filter("_base is not null"), "import_id", probes(F.col("_base")), files, "file_path")
    j = i.join(found, "import_id", "left")
    bare = ~F.startswith("source", F.lit(".")) & ~F.startswith("source", F.lit("/"))
    status = F.when(F.col("source").isNull(), "dynamic").when(F.col("resolved_path").isNotNull(), "resolved").when(bare & F.col("_base").isNull(), "external").otherwise("unresolvable")
    return j.withColumn("resolution_status", status).withColumn("package", F.when(status == "external", package_name(F.col("source")))).drop("_base")


def resolution_stats(resolved: DataFrame, symbols: DataFrame, walks: DataFrame) -> DataFrame:
    """One row: imports in total and by status, by_probe (found by another candidate than the first), packages; symbols that could not be resolved; walks along re-exports that
    went round, and that were too long. resolved: of resolve_imports; symbols: of resolve_symbols; walks: of unwind_barrels."""
    of_imports = resolved.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("resolution_status") == x).alias(x) for x in ("resolved", "external", "unresolvable", "dynamic")],
        F.count_if(F.col("probe") > 0).alias("by_probe"), F.count_distinct("package").alias("packages"),
    )
    of_symbols = symbols.agg(F.count_if(~F.col("resolved")).alias("unresolved_symbols"))
    of_walks = walks.agg(F.count_if(F.col("outcome") == "cycle").alias("barrel_cycles"), F.count_if(F.col("outcome") == "too deep").alias("barrel_depth_exceeded"))
    return of_imports.crossJoin(of_symbols).crossJoin(of_walks)


def unwind_barrels(wanted: DataFrame, reexports: DataFrame, own: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """wanted (import_id, file, name) with file, hops and outcome of the walk along re-exports.

    reexports: file, nth, name (null: wildcard), target. own: file, name of what a file itself exports. A file that exports the
    name ends the walk (found); else the first re-export that names it, or the first wildcard, is followed; none: missing; a
    file met before: cycle; too many hops: too deep. Each hop is one join of what still walks.
    """
    own = written(own.select("file", "name").distinct(), "own")
    # for each file and name the first step: by name, else by wildcard; each hop reads them, so they are written once
    named = written(reexports.filter("name is not null").groupBy("file", "name").agg(F.min_by("target", "nth").alias("by_name")), "named")
    star = written(reexports.filter("name is null").groupBy("file").agg(F.min_by("target", "nth").alias("by_star")), "star")
    at = wanted.select("import_id", "file", "name", F.lit(0).alias("hops"), F.array().cast("array<string>").alias("seen"))
    done = []
    for hop in range(max_hops + 1):
        here = at.join(own.withColumn("_own", F.lit(True)), ["file", "name"], "left").join(named, ["file", "name"], "left").join(star, "file", "left")
        step = F.coalesce("by_name", "by_star")
        outcome = F.when(F.col("_own"), "found").when(F.array_contains("seen", F.col("file")), "cycle").when(step.isNull(), "missing").when(F.lit(hop == max_hops), "too deep")
        here = written(here.select("import_id", "file", "name", "hops", "seen", step.alias("step"), outcome.alias("outcome")), "hop")
        done.append(here.filter("outcome is not null").select("import_id", "name", "file", "hops", "outcome"))
        at = here.filter("outcome is null").select("import_id", F.col("step").alias("file"), "name", (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array("file")).alias("seen"))
        if hop == max_hops or at.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def resolve_symbols(imports: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """import_id, name, target, import_kind, resolved of every imported name.

    imports: import_id, target, names (array), default_name, namespace. A named import needs an export and a symbol of that
    name; a default import needs a default export; a namespace import always holds.
    """
    base = imports.select("import_id", "target", "names", "default_name", "namespace")
    one = lambda kind, c: F.when(c.isNotNull(), F.array(F.struct(F.lit(kind).alias("import_kind"), c.alias("name")))).otherwise(F.array().cast("array<struct<import_kind:string,name:string>>"))
    named = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(F.lit("named").alias("import_kind"), n.alias("name")))
    rows = base.select("import_id", "target", F.explode(F.concat(named, one("default", F.col("default_name")), one("namespace", F.col("namespace")))).alias("x")).select("import_id", "target", "x.*")
    ex = exports.groupBy(F.col("file_path").alias("target"), "name").agg(F.lit(True).alias("_e"))
    sy = symbols.select(F.col("file_path").alias("target"), "name").distinct().withColumn("_s", F.lit(True))
    de = exports.filter("is_default").select(F.col("file_path").alias("target")).distinct().withColumn("_d", F.lit(True))
    j = rows.join(ex, ["target", "name"], "left").join(sy, ["target", "name"], "left").join(de, "target", "left")
    ok = F.when(F.col("import_kind") == "named", F.col("_e") & F.col("_s")).when(F.col("import_kind") == "default", F.col("_d")).otherwise(F.lit(True))
    return j.select("import_id", "name", "target", "import_kind", F.coalesce(ok, F.lit(False)).alias("resolved"))


def import_types(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """imports (file_path, name of what is imported, and more) with kind and signature of the first symbol of that file and name that has a signature, null where none has."""
    first = symbols.filter("signature is not null").groupBy("file_path", "name").agg(F.min_by(F.struct("kind", "signature"), F.struct("start_line", "sym_id")).alias("_first"))
    return imports.join(first, ["file_path", "name"], "left").select(*imports.columns, "_first.kind", "_first.signature")
