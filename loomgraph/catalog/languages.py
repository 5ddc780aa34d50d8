"""Import resolution of seven language families, over imports made of the symbols' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import languages
from .registry import query

_B = "chr(92)"
#: Of each family: where imports stand, files (with n, a file's number) and cases: source, resolved path, probe, package, status.
CASES = {
    "python": ("src/pkg/m.py", ["'src/pkg/f' || n || '.py'"], [
        ("'pkg.f' || n", "'src/pkg/f' || n || '.py'", 2, None, "resolved"), ("'.f' || n", "'src/pkg/f' || n || '.py'", 0, None, "resolved"),
        ("'pkg.f' || n || '.Name'", "'src/pkg/f' || n || '.py'", 6, None, "resolved"), ("'os.path'", None, None, None, "own"),
        ("'numpy.linalg'", None, None, "numpy", "external"), ("'typing_extensions'", None, None, None, "own"), ("'.missing'", None, None, None, "unresolvable"), ("'..pkg.f' || n", "'src/pkg/f' || n || '.py'", 0, None, "resolved")]),
    "jvm": ("src/main/kotlin/com/ex/M.kt", ["'src/main/kotlin/com/ex/F' || n || '.kt'"], [
        ("'com.ex.F' || n", "'src/main/kotlin/com/ex/F' || n || '.kt'", 7, None, "resolved"), ("'com.ex.F' || n || '.Inner'", "'src/main/kotlin/com/ex/F' || n || '.kt'", 11, None, "resolved"),
        ("'java.util.List'", None, None, None, "own"), ("'com.sun.net.X'", None, None, None, "own"), ("'org.lib.Thing'", None, None, "org.lib", "external"), ("'com.ex.*'", None, None, None, "unresolvable")]),
    "csharp": ("Com/M.cs", ["'Com/Ex/F' || n || '.cs'", "'Com/Dir' || n || '/Dir' || n || '.cs'"], [
        ("'Com.Ex.F' || n", "'Com/Ex/F' || n || '.cs'", 0, None, "resolved"), ("'Com.Dir' || n", "'Com/Dir' || n || '/Dir' || n || '.cs'", 1, None, "resolved"),
        ("'System.Text'", None, None, None, "own"), ("'Newtonsoft.Json'", None, None, "Newtonsoft.Json", "external")]),
    "ruby": ("lib/m.rb", ["'lib/f' || n || '.rb'"], [
        ("'f' || n", "'lib/f' || n || '.rb'", 0, None, "resolved"), ("'./f' || n", "'lib/f' || n || '.rb'", 0, None, "resolved"), ("'json'", None, None, None, "own"),
        ("'rails/all'", None, None, "rails", "external"), ("'./missing'", None, None, None, "unresolvable")]),
    "php": ("app/m.php", ["'app/Models/F' || n || '.php'"], [
        (f"'Models' || {_B} || 'F' || n", "'app/Models/F' || n || '.php'", 1, None, "resolved"), ("'Exception'", None, None, None, "own"), ("'Foo'", None, None, "Foo", "external"), (f"'Vendor' || {_B} || 'Lib'", None, None, "Vendor", "external")]),
    "swift": ("Sources/App/m.swift", ["'Sources/Mod' || n || '/a.swift'"], [
        ("'Mod' || n", "'Sources/Mod' || n", 0, None, "resolved"), ("'Foundation'", None, None, None, "own"), ("'Alamofire'", None, None, "Alamofire", "external")]),
    "rust": ("src/a/m.rs", ["'src/a/f' || n || '.rs'", "'src/d' || n || '/mod.rs'"], [
        ("'crate::a::f' || n", "'src/a/f' || n || '.rs'", 0, None, "resolved"), ("'crate::a::f' || n || '::Type'", "'src/a/f' || n || '.rs'", 2, None, "resolved"),
        ("'super::f' || n", "'src/a/f' || n || '.rs'", 0, None, "resolved"), ("'crate::d' || n", "'src/d' || n || '/mod.rs'", 1, None, "resolved"), ("'std::io'", None, None, None, "own"), ("'proc_macro::TokenStream'", None, None, None, "own"),
        ("'tokio::spawn'", None, None, "tokio", "external"), ("'self::nope'", None, None, None, "unresolvable")]),
}


def _case(cases: list, part: int, text: bool = False) -> str:
    """A CASE over the import's id; text: the parts are values, not expressions."""
    value = lambda v: "NULL" if v is None else f"'{v}'" if text else v
    return f"CASE import_id % {len(cases)} " + " ".join(f"WHEN {i} THEN {value(c[part])}" for i, c in enumerate(cases)) + " END"


def _register(family: str) -> None:
    at, files, cases = CASES[family]
    sql = f"""SELECT import_id, {_case(cases, 0)} AS source, CAST({_case(cases, 1)} AS VARCHAR) AS resolved_path, CAST({_case(cases, 2)} AS INTEGER) AS probe,
        CAST({_case(cases, 3, True)} AS VARCHAR) AS package, {_case(cases, 4, True)} AS resolution_status FROM (SELECT sym_id AS import_id, file_id AS n FROM {{symbols}})"""

    @query(f"resolve_{family}", sql)
    def resolved(t):
        s = t.spread(t.symbols.selectExpr("sym_id AS import_id", "file_id AS n"), "import_id", "part")
        imports = s.select("import_id", F.lit(at).alias("from_file"), F.expr(_case(cases, 0)).alias("source"))
        known = s.select("n").distinct().select(F.explode(F.array(*[F.expr(f) for f in files])).alias("file_path"))
        return languages.resolve_imports(imports, known, family).select("import_id", "source", "resolved_path", "probe", "package", "resolution_status")


for _family in CASES:
    _register(_family)
