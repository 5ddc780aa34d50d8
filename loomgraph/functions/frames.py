"""Stack frames of nine trace formats, by regular expressions in a fixed order; a line counts for the first format that fits."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip_prefix


class Format(NamedTuple):
    """Numbers of the groups that hold path, line, column and function (0: none), and what marks a library's frame."""

    name: str
    pattern: str
    path: int
    line: int
    column: int
    function: int
    library_path: str
    library_function: str = ""


#: Fixed values, in order.
FORMATS = (
    Format("rust", r"at\s+(.+\.rs):(\d+)(?::(\d+))?", 1, 2, 3, 0, r"\.cargo/registry/|\.rustup/|/rustc/"),
    Format("swift", r"(?:at\s+)?(.+\.swift):(\d+)(?::(\d+))?", 1, 2, 3, 0, r"/Xcode\.app/|/usr/lib/swift/"),
    Format("jvm", r"at\s+([a-zA-Z0-9_.]+(?:\$[a-zA-Z0-9_]+)*)\(([^)]+\.(?:java|kt)):(\d+)\)", 2, 3, 0, 1, "", r"^(?:java|javax|sun|jdk|kotlin|kotlinx\.coroutines)\."),
    Format("js", r"at\s+(?:(.+?)\s+\()?(.+?):(\d+)(?::(\d+))?\)?", 2, 3, 4, 1, r"node_modules/|^node:"),
    Format("python", r'File\s+"(.+?)",\s+line\s+(\d+)(?:,\s+in\s+(.+))?', 1, 2, 0, 3, r"site-packages/|^<"),
    Format("go", r"^\s*(.+\.go):(\d+)", 1, 2, 0, 0, r"/pkg/mod/"),
    Format("csharp", r"at\s+([a-zA-Z0-9_.]+)\([^)]*\)\s+in\s+(.+\.cs):line\s+(\d+)", 2, 3, 0, 1, r"/usr/share/dotnet/", r"^(?:System|Microsoft)\."),
    Format("ruby", r"^(.+\.rb):(\d+)(?::in\s+[`'](.+?)'?)?", 1, 2, 0, 3, r"/gems/|/ruby/"),
    Format("php", r"#\d+\s+(.+\.php)\((\d+)\)(?::\s+(.+?)(?:\(|$))?", 1, 2, 0, 3, r"/vendor/"),
)

FRAME = "struct<format:string,file_path:string,line_number:int,column_number:int,function_name:string>"


#: What every line of a format holds besides; cheap to look for before its pattern is tried.
HOLDS = {"rust": (".rs:",), "swift": (".swift:",), "jvm": (".java:", ".kt:"), "js": ("at",), "python": ("File",), "go": (".go:",), "csharp": (".cs:line",), "ruby": (".rb:",), "php": (".php(",)}


def line_frame(line: Column) -> Column:
    """The frame that a line holds, or null, by the first format that fits. Patterns are literals, each compiled once."""
    text = F.trim(line)
    which = F.lit(None).cast("int")
    for i in reversed(range(len(FORMATS))):
        f = FORMATS[i]
        may = F.contains(text, F.lit(HOLDS[f.name][0]))
        for other in HOLDS[f.name][1:]:
            may = may | F.contains(text, F.lit(other))
        which = F.when(may & text.rlike(f.pattern), i).otherwise(which)

    def read(i: Column) -> Column:
        def of(value) -> Column:
            out = F.lit(None).cast("string")
            for n, f in enumerate(FORMATS):
                if (c := value(f)) is not None:
                    out = F.when(i == n, c).otherwise(out)
            return out

        group = lambda name: of(lambda f: F.nullif(F.regexp_extract(text, f.pattern, getattr(f, name)), F.lit("")) if getattr(f, name) else None)
        return F.struct(i.alias("i"), group("path").alias("path"), group("line").alias("line"), group("column").alias("column"), group("function").alias("function"))

    def library(x: Column) -> Column:
        out = F.lit(False)
        for n, f in enumerate(FORMATS):
            for pattern, of in ((f.library_path, "path"), (f.library_function, "function")):
                if pattern:
                    out = out | ((x["i"] == n) & F.coalesce(x[of].rlike(pattern), F.lit(False)))
        return out

    def made(x: Column) -> Column:
        name = F.get(F.array(*[F.lit(f.name) for f in FORMATS]), x["i"])
        path = F.when(name == "jvm", x["path"]).otherwise(strip_prefix(x["path"]))
        return F.struct(name.alias("format"), path.alias("file_path"), x["line"].try_cast("int").alias("line_number"), x["column"].try_cast("int").alias("column_number"), x["function"].alias("function_name"))

    # one-element arrays let the parts be named, so that no expression is written out twice
    parts = F.filter(F.transform(F.filter(F.array(which), lambda i: i.isNotNull()), read), lambda x: ~library(x))
    return F.get(F.transform(parts, made), F.lit(0)).cast(FRAME)


def stack_frames(rows: DataFrame, key: str, trace: str) -> DataFrame:
    """key, nth, and the frame's parts, of every frame in the trace; nth counts the lines from 0."""
    lines = rows.filter(F.col(trace).isNotNull()).select(key, F.posexplode(F.split(trace, "\n")).alias("nth", "_line"))
    found = lines.select(key, "nth", line_frame(F.col("_line")).alias("f")).filter("f is not null")
    return found.select(key, "nth", "f.*")


def top_frames(rows: DataFrame, key: str, trace: str) -> DataFrame:
    """The first frame of each trace."""
    f = stack_frames(rows, key, trace)
    return f.groupBy(key).agg(F.min_by(F.struct("format", "file_path", "line_number", "column_number", "function_name"), "nth").alias("f")).select(key, "f.*")
