"""Symbols, imports and exports of source text in eleven languages. Symbols come from a table function over a file's text, which SQL can call too; imports from
line patterns as Spark expressions.

No grammar packages are at hand: declarations are told by the beginning of their statement, and their scopes by braces, `end` or indentation (see declarations).
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.declarations import declarations


class Rule(NamedTuple):
    """The first group of the pattern is the name."""

    languages: tuple[str, ...]
    kind: str
    pattern: str


_JS = ("typescript", "tsx", "javascript")
RULES = (
    Rule(_JS, "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    Rule(_JS, "function", r"^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
    Rule(_JS, "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    Rule(_JS, "type", r"^\s*(?:export\s+)?(?:declare\s+)?(?:interface|type|enum)\s+([A-Za-z_$][\w$]*)"),
    Rule(_JS, "constant", r"^(?:export\s+)?const\s+([A-Za-z_$][\w$]*)"),
    Rule(("python",), "function", r"^\s*(?:async\s+)?def\s+(\w+)"),
    Rule(("python",), "class", r"^\s*class\s+(\w+)"),
    Rule(("python",), "constant", r"^([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?="),
    Rule(("go",), "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    Rule(("go",), "class", r"^type\s+(\w+)\s+struct"),
    Rule(("go",), "type", r"^type\s+(\w+)"),
    Rule(("go",), "constant", r"^(?:const|var)\s+(\w+)"),
    Rule(("rust",), "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"),
    Rule(("rust",), "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"),
    Rule(("rust",), "type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:trait|type)\s+(\w+)"),
    Rule(("rust",), "constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)"),
    Rule(("java", "csharp"), "class", r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial)\s+)*(?:class|record|struct)\s+(\w+)"),
    Rule(("java", "csharp"), "type", r"^\s*(?:(?:public|private|protected|internal|static|sealed)\s+)*(?:interface|enum|@interface)\s+(\w+)"),
    Rule(("java", "csharp"), "constant", r"^\s*(?:public\s+|private\s+|protected\s+|internal\s+)?(?:static\s+final|const)\s+[\w<>\[\]]+\s+(\w+)"),
    Rule(("java", "csharp"), "function", r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized)\s+)+(?:<[^>]+>\s+)?(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\("),
    Rule(("kotlin",), "function", r"^\s*(?:(?:public|private|internal|protected|override|suspend|inline|open)\s+)*fun\s+(?:<[^>]+>\s*)?(?:[\w.<>]+\.)?(\w+)"),
    Rule(("kotlin",), "type", r"^\s*(?:(?:public|private|internal|sealed|enum)\s+)*(?:interface|typealias)\s+(\w+)"),
    Rule(("kotlin",), "class", r"^\s*(?:(?:public|private|internal|data|sealed|open|abstract|enum|annotation)\s+)*(?:class|object)\s+(\w+)"),
    Rule(("kotlin",), "constant", r"^\s*(?:(?:public|private|internal)\s+)*(?:const\s+)?val\s+([A-Z]\w*)"),
    Rule(("ruby",), "function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"),
    Rule(("ruby",), "class", r"^\s*(?:class|module)\s+([A-Z][\w:]*)"),
    Rule(("ruby",), "constant", r"^\s*([A-Z][A-Z0-9_]+)\s*="),
    Rule(("php",), "function", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)"),
    Rule(("php",), "class", r"^\s*(?:(?:final|abstract|readonly)\s+)*class\s+(\w+)"),
    Rule(("php",), "type", r"^\s*(?:interface|trait|enum)\s+(\w+)"),
    Rule(("php",), "constant", r"^\s*(?:public\s+|private\s+)?const\s+(\w+)"),
    Rule(("swift",), "function", r"^\s*(?:(?:public|private|internal|open|static|override|mutating)\s+)*func\s+(\w+)"),
    Rule(("swift",), "class", r"^\s*(?:(?:public|private|internal|open|final)\s+)*(?:class|struct|actor)\s+(\w+)"),
    Rule(("swift",), "type", r"^\s*(?:(?:public|private|internal)\s+)*(?:protocol|enum|typealias)\s+(\w+)"),
)
#: The group is the source of an import.
IMPORTS = (
    (_JS, r"""^\s*(?:import|export)\b.*?\bfrom\s+["']([^"']+)["']"""), (_JS, r"""^\s*import\s+["']([^"']+)["']"""), (("python",), r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"),
    (("go",), r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$"""), (("rust",), r"^\s*(?:pub\s+)?(?:use\s+([\w:]+?)(?:::\{.*|::\w+)?;|mod\s+(\w+);)"), (("java", "kotlin"), r"^\s*import\s+(?:static\s+)?([\w.*]+)"),
    (("csharp",), r"^\s*using\s+(?:static\s+)?([\w.]+);"), (("ruby",), r"""^\s*require(?:_relative)?\s+["']([^"']+)["']"""), (("php",), r"^\s*use\s+([\w\\]+)"), (("swift",), r"^\s*import\s+(\w+)"),
)
_PUBLIC = r"^\s*(?:export\b|pub\b|public\b|open\b)"


def _first(language: Column, rules, value) -> Column:
    out = F.lit(None)
    for languages, *rest in reversed(rules):
        fits, made = value(*rest)
        out = F.when(language.isin(*languages) & fits, made).otherwise(out)
    return out


def _lines(files: DataFrame) -> DataFrame:
    known = files.filter(F.col("language").isin(*{x for r in RULES for x in r.languages}))
    return known.select("file_path", "language", F.size(F.split("content", "\n")).alias("n"), F.posexplode(F.split("content", "\n")).alias("i", "line"))


SYMBOLS = "name string, kind string, signature string, start_line int, end_line int, parent string, depth int, is_exported boolean"


@lru_cache(16)
def _rules(language: str) -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((r.kind, re.compile(r.pattern)) for r in RULES if language in r.languages)


def _exported(language: str, name: str, signature: str) -> bool:
    if language in ("python", "ruby"):
        return not name.startswith("_")
    return name[:1].isupper() if language == "go" else re.match(_PUBLIC, signature) is not None


class FileSymbols:
    """The table function file_symbols(language, content)."""

    def eval(self, language: str, content: str):
        if content and (rules := _rules(language or "")):
            for d in declarations(content, language, rules):
                yield (*d, _exported(language, d.name, d.signature))


file_symbols = udtf(FileSymbols, returnType=SYMBOLS)


def register(spark: SparkSession) -> None:
    """Makes file_symbols a table function of the session's SQL."""
    spark.udtf.register("file_symbols", file_symbols)


def symbols(files: DataFrame) -> DataFrame:
    """file_path, name, kind, signature, start_line, end_line, parent, depth, is_exported. files: file_path, language, content."""
    known = files.filter(F.col("language").isin(*{x for r in RULES for x in r.languages}) & F.col("content").isNotNull()).select("file_path", "language", "content")
    rows = known.lateralJoin(file_symbols(F.col("language").outer(), F.col("content").outer()))
    return rows.select("file_path", "name", "kind", "signature", "start_line", "end_line", "parent", "depth", "is_exported")


def imports(files: DataFrame) -> DataFrame:
    """file_path, line, source of every import."""
    line = F.col("line")
    source = _first(F.col("language"), IMPORTS, lambda p: (line.rlike(p), F.concat(F.regexp_extract(line, p, 1), F.regexp_extract(line, p, 2) if p.count("(") - p.count("(?") > 1 else F.lit(""))))
    return _lines(files).select("file_path", (F.col("i") + 1).alias("line"), source.alias("source")).filter("source is not null and source <> ''")
