"""Import resolution in seven families of languages: an import's candidate paths, in order, against the inventory of files."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import first_candidate
from .resolve import normal_path

#: Where sources of a family begin, and what belongs to its language and is left out.
JVM_ROOTS = ("src/main/java", "src/main/kotlin", "src/test/java", "src/test/kotlin", "app/src/main/java", "app/src/main/kotlin", "src")
JVM_OWN = ("java", "javax", "kotlin", "kotlinx", "android", "dalvik", "sun", "com.sun", "org.xml", "org.w3c")
CSHARP_OWN = ("System", "Microsoft", "Windows")
RUBY_OWN = ("json", "yaml", "csv", "net/http", "uri", "fileutils", "pathname", "set", "ostruct", "date", "time", "digest", "base64", "logger", "erb", "cgi", "socket", "io/console", "stringio", "tempfile")
RUST_OWN = ("std", "core", "alloc", "collections", "proc_macro")
PHP_OWN = ("PDO", "DateTime", "Exception", "stdClass", "ArrayObject", "SplFileInfo", "SplFixedArray", "Closure", "Generator")
PHP_PREFIXES = ("src/", "app/", "")
SWIFT_PREFIXES = ("Sources/", "src/", "")
SWIFT_OWN = ("Foundation", "UIKit", "SwiftUI", "Combine", "CoreData", "CoreGraphics", "CoreLocation", "MapKit", "AVFoundation", "Darwin", "Swift", "ObjectiveC", "Dispatch")
PYTHON_OWN = tuple("""
    builtins sys os io abc copy enum types typing typing_extensions collections functools itertools operator dataclasses contextlib warnings traceback inspect
    string re difflib textwrap unicodedata codecs
    math decimal fractions random statistics
    pathlib glob fnmatch shutil tempfile fileinput stat
    json csv configparser tomllib xml html plistlib
    pickle shelve sqlite3 dbm marshal
    gzip bz2 lzma zipfile tarfile zlib
    hashlib hmac secrets base64
    platform signal subprocess multiprocessing threading concurrent queue sched mmap ctypes
    socket ssl select selectors asyncio http urllib email ftplib smtplib xmlrpc socketserver
    webbrowser cgi wsgiref
    logging pdb profile cProfile timeit time
    unittest doctest
    importlib pkgutil zipimport
    datetime calendar locale gettext zoneinfo
    ast dis code compileall pprint
    array weakref struct heapq bisect
    argparse getpass readline rlcompleter curses atexit sysconfig venv site runpy
    stdlibs
""".split())


class Family(NamedTuple):
    """own: whether the source belongs to the language; local: whether it can only mean a file here; paths: candidates; package: its name if it is external."""

    own: Callable[[Column], Column]
    local: Callable[[Column], Column]
    paths: Callable[[Column, Column], Column]
    package: Callable[[Column], Column]


def _none(source: Column) -> Column:
    return F.lit(False)


def _head(source: Column, sep: str, n: int = 1) -> Column:
    return F.substring_index(source, sep, n)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _paths(*parts) -> Column:
    return F.array_compact(F.array(*parts))


def _shorter(parts: Column, made: Callable[[Column], list[Column]]) -> Column:
    """Candidates of all parts, then of all but the last, and so on."""
    return F.flatten(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array(*made(F.array_join(F.slice(parts, 1, n), "/")))))


def _python(source: Column, from_file: Column) -> Column:
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(source, r"^\.+", ""), r"\.", "/")
    up = F.concat(_directory(from_file), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    base = normal_path(up, rest)
    relative = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    shorter = _shorter(F.split(rest, "/"), lambda p: [F.concat(F.lit(root), p, F.lit(end)) for root in ("", "src/") for end in (".py", "/__init__.py")])
    return F.when(dots > 0, relative).otherwise(shorter)


def _jvm(source: Column, from_file: Column) -> Column:
    parts = F.split(source, r"\.")
    return F.flatten(F.array(*[_shorter(parts, lambda p, root=root: [F.concat(F.lit(f"{root}/"), p, F.lit(end)) for end in (".java", ".kt")]) for root in JVM_ROOTS]))


def _csharp(source: Column, from_file: Column) -> Column:
    path = F.replace(source, F.lit("."), F.lit("/"))
    return F.array(F.concat(path, F.lit(".cs")), F.concat(path, F.lit("/"), F.substring_index(source, ".", -1), F.lit(".cs")))


def _ruby(source: Column, from_file: Column) -> Column:
    near = normal_path(_directory(from_file), source)
    here = F.array(F.concat(near, F.lit(".rb")), near)
    return F.when(F.startswith(source, F.lit(".")), here).otherwise(F.array(*[F.concat(F.lit(root), source, F.lit(".rb")) for root in ("lib/", "app/", "")]))


def _php(source: Column, from_file: Column) -> Column:
    path = F.translate(source, "\\", "/")
    return F.array(*[F.concat(F.lit(p), path, F.lit(".php")) for p in PHP_PREFIXES])


def _swift(source: Column, from_file: Column) -> Column:
    return F.array(*[F.concat(F.lit(p), source) for p in SWIFT_PREFIXES])


def _rust(source: Column, from_file: Column) -> Column:
    parts = F.split(source, "::")
    own_folder = F.regexp_extract(from_file, r"([^/]*)$", 1).isin("mod.rs", "lib.rs", "main.rs")
    folder = _directory(from_file)
    # a module's children stand in a folder of its name, those of mod.rs beside it
    module = F.when(own_folder, folder).otherwise(F.regexp_replace(from_file, r"\.rs$", ""))
    ups = F.size(F.filter(parts, lambda p: p == "super"))
    rest = F.filter(parts, lambda p: ~p.isin("crate", "self", "super"))
    root = F.when(parts[0] == "crate", F.regexp_extract(from_file, r"^(.*?src)/", 1)).when(ups > 0, normal_path(module, F.repeat(F.lit("../"), ups))).otherwise(module)
    return _shorter(rest, lambda p: [normal_path(root, F.concat(p, F.lit(".rs"))), normal_path(root, F.concat(p, F.lit("/mod.rs")))])


FAMILIES = {
    "python": Family(lambda s: _head(s, ".").isin(*PYTHON_OWN), lambda s: F.startswith(s, F.lit(".")), _python, lambda s: _head(s, ".")),
    "jvm": Family(lambda s: _head(s, ".").isin(*JVM_OWN) | _head(s, ".", 2).isin(*JVM_OWN), lambda s: F.endswith(s, F.lit(".*")), _jvm, lambda s: _head(s, ".", 2)),
    "csharp": Family(lambda s: _head(s, ".").isin(*CSHARP_OWN), _none, _csharp, lambda s: s),
    "ruby": Family(lambda s: s.isin(*RUBY_OWN), lambda s: F.startswith(s, F.lit(".")), _ruby, lambda s: _head(s, "/")),
    "php": Family(lambda s: s.isin(*PHP_OWN), _none, _php, lambda s: _head(s, "\\")),
    "swift": Family(lambda s: s.isin(*SWIFT_OWN), _none, _swift, lambda s: s),
    "rust": Family(lambda s: _head(s, "::").isin(*RUST_OWN), lambda s: _head(s, "::").isin("crate", "self", "super"), _rust, lambda s: _head(s, "::")),
}


def folders(files: DataFrame) -> DataFrame:
    """file_path of every folder that holds files, for modules that are folders."""
    parts = F.split("file_path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.filter(F.contains("file_path", F.lit("/"))).select(F.explode(every).alias("file_path")).distinct()


def resolve_imports(imports: DataFrame, files: DataFrame, family: str) -> DataFrame:
    """imports (import_id, from_file, source) with resolved_path, probe, package and resolution_status: resolved, external, unresolvable, or own
    for what comes with the language. files: file_path."""
    f = FAMILIES[family]
    source = F.col("source")
    i = imports.withColumn("_own", f.own(source) & ~f.local(source)).withColumn("_local", f.local(source))
    targets = folders(files) if family == "swift" else files.select("file_path").distinct()
    asked = i.filter("not _own").withColumn("_paths", f.paths(source, F.col("from_file")))
    found = first_candidate(asked, "import_id", F.col("_paths"), targets, "file_path")
    j = i.join(found, "import_id", "left")
    status = F.when(F.col("_own"), "own").when(F.col("resolved_path").isNotNull(), "resolved").when(F.col("_local"), "unresolvable").otherwise("external")
    return j.withColumn("resolution_status", status).withColumn("package", F.when(status == "external", f.package(source))).drop("_own", "_local")
