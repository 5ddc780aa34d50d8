"""Scans, manifests, analysis results, symbols, logs, imports."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.joins import cascade, innermost
from loomgraph.plans import adhoc, flows, resolve
from loomgraph.sources import files as sf, index, manifests, platform_logs, sarif, symbols

MANIFESTS = {
    "Cargo.toml": ('[package]\nname = "x"\n\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.35", features = ["full"] }\nlocal-lib = { path = "../lib" }\n\n[dev-dependencies]\nassert_cmd = "2.0"\n',
                   {("serde", "1.0"), ("tokio", "1.35"), ("local-lib", "path"), ("assert_cmd", "2.0")}),
    "a/pom.xml": ("<project><properties><s.v>5.3</s.v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${s.v}</version></dependency>"
                  "<dependency><groupId>junit</groupId><artifactId>junit</artifactId></dependency></dependencies></project>", {("g:a", "5.3"), ("junit:junit", "*")}),
    "build.gradle": ("dependencies {\n  implementation 'g.b:w:3.0.0'\n  api 'c:d:2.14'\n}", {("g.b:w", "3.0.0"), ("c:d", "2.14")}),
    "build.gradle.kts": ('dependencies {\n  testImplementation("io.m:k:1.13")\n}', {("io.m:k", "1.13")}),
    "My.csproj": ('<PackageReference Include="N.Json" Version="13.0.1" />', {("N.Json", "13.0.1")}),
    "Gemfile": ("gem 'rails', '~> 7.0'\ngem 'puma'\n# gem 'no'\n", {("rails", "~> 7.0"), ("puma", "*")}),
    "composer.json": (json.dumps({"require": {"php": ">=8", "l/f": "^10", "ext-x": "*"}, "require-dev": {"p/u": "^1"}}), {("l/f", "^10"), ("p/u", "^1")}),
    "Package.swift": ('.package(url: "https://h/v/vapor.git", from: "4.77.0"),', {("vapor", "4.77.0")}),
    "package.json": (json.dumps({"dependencies": {"a": "^1"}}), {("a", "^1")}),
    "go.mod": ("module m\nrequire github.com/x/y v1.2.3\n", {("github.com/x/y", "v1.2.3")}),
    "other.txt": ("serde = 1", set()),
}


def test_manifests(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in MANIFESTS.items()] + [("b/Gemfile", None)], "file_path string, content string")
    got: dict = {k: set() for k in MANIFESTS}
    for r in manifests.dependencies(df).collect():
        got[r.file_path].add((r.name, r.version))
    assert got == {k: v[1] for k, v in MANIFESTS.items()}


def test_scan(spark, tmp_path):
    for name, text in {"src/a.ts": "let a", "src/empty.py": "", "node_modules/x.js": "x", "bin.exe": "x", "README": "hi", ".hidden/y.py": "x", "src/big.py": "x" * 600_000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.file_path: (r.language, r.size_bytes, r.content) for r in sf.scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": ("typescript", 5, "let a"), "README": ("unknown", 2, "hi")}


def test_push_commits(spark):
    body = json.dumps({"ref": "refs/heads/main", "after": "n", "commits": [{"id": "abcdef0123", "message": "first\nrest"}, {"id": "", "message": "x"}]})
    df = spark.createDataFrame([(1, body), (2, body.replace("main", "dev")), (3, "junk"), (4, None)], "id int, body string")
    assert [tuple(r) for r in sf.push_commits(df, "id", "main", "old").collect()] == [(1, "abcdef01", "first")]
    assert sf.push_commits(df, "id", "main", "n").count() == 0


def _loc(file, line):
    return {"physicalLocation": {"artifactLocation": {"uri": file}, "region": {"startLine": line}}}


def test_sarif(spark, tmp_path):
    flow = {"ruleId": "r1", "message": {"text": "m"}, "locations": [_loc("z", 9)], "codeFlows": [{"threadFlows": [{"locations": [{"location": _loc("a", 1)}, {"location": _loc("b", 2)}, {"location": _loc("c", 3)}]}]}]}
    plain = {"ruleId": "r2", "level": "none", "message": {"text": "p"}, "locations": [_loc("d", 4)]}
    log = {"runs": [{"tool": {"driver": {"rules": [{"id": "r1", "defaultConfiguration": {"level": "error"}}]}}, "results": [flow, flow, plain, {"ruleId": "r3", "message": {"text": "x"}}]}]}
    (tmp_path / "x.sarif").write_text(json.dumps(log))
    got = sorted((r.query_id, r.severity, r.source_file, r.source_line, r.sink_file, r.sink_line, len(r.path_steps)) for r in sarif.findings(sarif.read(spark, str(tmp_path))).collect())
    assert got == [("r1", "error", "a", 1, "c", 3, 3), ("r2", "note", "d", 4, "d", 4, 1)]


SOURCE = {
    "typescript": ("export function foo() {\n  const x = 1\n}\nclass Bar {\n}\nexport interface Baz {}\nimport { q } from './q'\n", {"foo", "Bar", "Baz"}, {"./q"}),
    "python": ("import os\nfrom a.b import c\nX = 1\nclass K:\n    def m(self):\n        pass\ndef f():\n    pass\n", {"X", "K", "m", "f"}, {"os", "a.b"}),
    "rust": ("use std::collections::HashMap;\npub struct AppConfig {\n}\npub fn process_data() {}\npub const MAX: u32 = 3;\npub trait Ser {}\nmod database;\n", {"AppConfig", "process_data", "MAX", "Ser"}, {"std::collections", "database"}),
    "java": ("import java.util.List;\npublic class Svc {\n  public void run() {\n  }\n}\n", {"Svc", "run"}, {"java.util.List"}),
    "go": ("func (s *S) Do() {}\ntype S struct {\n}\n", {"Do", "S"}, set()),
    "kotlin": ("data class U(val x: Int)\nsuspend fun go() {}\n", {"U", "go"}, set()),
    "ruby": ("require 'json'\nmodule M\n  def run!\n  end\nend\n", {"M", "run!"}, {"json"}),
    "php": ("use App\\Models\\User;\nfinal class C {\n  public function go() {}\n}\n", {"C", "go"}, {"App\\Models\\User"}),
    "swift": ("import UIKit\npublic struct V {\n  func draw() {}\n}\nprotocol P {}\n", {"V", "draw", "P"}, {"UIKit"}),
    "csharp": ("using System.Text;\npublic class A {\n  public async Task Run() { }\n}\n", {"A", "Run"}, {"System.Text"}),
}


def test_symbols_and_imports(spark):
    df = spark.createDataFrame([(k, k, v[0]) for k, v in SOURCE.items()] + [("n", "python", None), ("m", "markdown", "def x():")], "file_path string, language string, content string")
    names: dict = {k: set() for k in SOURCE}
    for r in symbols.symbols(df).collect():
        names[r.file_path].add(r.name)
        assert r.start_line <= r.end_line
    assert names == {k: v[1] for k, v in SOURCE.items()}
    found: dict = {k: set() for k in SOURCE}
    for r in symbols.imports(df).collect():
        found[r.file_path].add(r.source)
    assert found == {k: v[2] for k, v in SOURCE.items()}
    py = {r.name: (r.kind, r.start_line, r.end_line) for r in symbols.symbols(df).filter("file_path = 'python'").collect()}
    assert py["K"] == ("class", 4, 6) and py["m"] == ("function", 5, 6)


def test_index(spark):
    df = spark.createDataFrame([("a.ts", [("s npm . . `b.ts`/f().", [4, 1, 7], 8), ("s npm . . `b.ts`/f().", [1, 0, 2, 5], 1)])], "relative_path string, occurrences array<struct<symbol:string,range:array<int>,symbol_roles:int>>")
    o = index.occurrences(df)
    assert sorted((r.line, r.def_path, r.name) for r in o.collect()) == [(2, "b.ts", "f"), (5, "b.ts", "f")]
    assert [r.line for r in index.references(o).collect()] == [5]


def test_platform_logs(spark, tmp_path):
    rows = [{"id": "1", "timestamp": 1000, "type": "stderr", "message": "x"}, {"id": "2", "timestamp": 999, "type": "log"}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    got = platform_logs.normalized(platform_logs.read(spark, str(tmp_path)), "p1", 999).collect()
    assert [(r.id, r.level, r.ts.second) for r in got] == [("1", "error", 1)]


def test_resolution(spark):
    files = spark.createDataFrame([(x,) for x in ("src/a.ts", "src/lib/index.ts", "src/u.tsx", "src/u.js")], "file_path string")
    rows = [(1, "src/x.ts", "./a"), (2, "src/x.ts", "./lib"), (3, "src/x.ts", "./a.js"), (4, "src/deep/y.ts", "../u"), (5, "src/x.ts", "@/a"), (6, "src/x.ts", "@s/p/q"), (7, "src/x.ts", "./none"), (8, "src/x.ts", "react")]
    r = resolve.resolve_imports(spark.createDataFrame(rows, "import_id int, from_file string, source string"), files, {"@/*": "src/*"})
    got = {x.import_id: (x.resolved_path, x.resolution_status, x.package) for x in r.collect()}
    assert got == {1: ("src/a.ts", "resolved", None), 2: ("src/lib/index.ts", "resolved", None), 3: ("src/a.ts", "resolved", None), 4: ("src/u.tsx", "resolved", None), 5: ("src/a.ts", "resolved", None),
                   6: (None, "external", "@s/p"), 7: (None, "unresolvable", None), 8: (None, "external", "react")}


def test_barrels(spark):
    re = spark.createDataFrame([("a", 0, "x", "b"), ("a", 1, None, "c"), ("c", 0, None, "a"), ("b", 0, None, "d")], "file string, nth int, name string, target string")
    own = spark.createDataFrame([("d", "x")], "file string, name string")
    wanted = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "d", "q")], "import_id int, file string, name string")
    got = {r.import_id: (r.file, r.hops, r.outcome) for r in resolve.unwind_barrels(wanted, re, own).collect()}
    assert got == {1: ("d", 2, "found"), 2: ("a", 2, "cycle"), 3: ("d", 0, "missing")}


def test_innermost_and_cascade(spark):
    spans = spark.createDataFrame([(1, 1, 200, 10), (1, 60, 70, 11), (1, 60, 70, 9), (2, 1, 5, 12)], "f int, a int, b int, n int")
    points = spark.createDataFrame([(1, 65), (1, 65), (1, 190), (2, 6), (1, None)], "f int, at int")
    got = sorted(((r.f, r["at"], r.n) for r in innermost(points, spans, ["f"], "at", "a", "b", "n").collect()), key=str)
    assert got == sorted([(1, 65, 9), (1, 65, 9), (1, 190, 10), (2, 6, None), (1, None, None)], key=str)
    left = spark.createDataFrame([(1, "p", "q"), (2, "z", "q"), (3, "z", None)], "i int, a string, b string")
    right = spark.createDataFrame([("q", 7), ("q", 6), ("p", 9)], "k string, v int")
    assert sorted(map(tuple, cascade(left, right, "i", [F.col("a"), F.col("b")], "k", "v").collect())) == [(1, 9, 1), (2, 6, 2)]


def test_derived_calls(spark):
    syms = spark.createDataFrame([(1, "function", 0, 1, 10), (2, "function", 0, 20, 30), (3, "constant", 0, 40, 41)], "sym_id int, kind string, file_id int, start_line int, end_line int")
    occ = spark.createDataFrame([(0, 5, 2), (0, 5, 2), (0, 5, 1), (0, 25, 3), (0, 99, 1)], "file_id int, line int, target int")
    assert [tuple(r) for r in flows.derive_calls(occ, syms).collect()] == [(1, 2, 5)]


def test_read_only(spark):
    assert adhoc.is_read_only(spark, "SELECT created_at FROM t WHERE x = 'DROP'")
    assert adhoc.is_read_only(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a ORDER BY x LIMIT 1")
    for bad in ("DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE t (x INT)", "SET a = b", "CACHE TABLE t", "CREATE OR REPLACE TEMP VIEW v AS SELECT 1",
                "WITH c AS (SELECT 1) INSERT INTO t SELECT * FROM c", "FROM t INSERT INTO a SELECT x INSERT INTO b SELECT y", "EXECUTE IMMEDIATE 'DROP TABLE t'", "BEGIN DROP TABLE t; END",
                "UNCACHE TABLE t", "COMMENT ON TABLE t IS 'x'", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM t WHERE x IN (SELECT java_method('a', 'b'))", "SELECT * FROM python_udtf(1)"):
        assert not adhoc.is_read_only(spark, bad), bad
    for good in ("SELECT a, count(*) FROM t JOIN u USING (a) GROUP BY a HAVING count(*) > 1", "SELECT * FROM (SELECT 1 AS x UNION ALL SELECT 2) WHERE x IN (SELECT y FROM u)", "SELECT explode(array(1, 2)) AS x",
                 "SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) FROM t LIMIT 3 OFFSET 1", "SELECT * FROM t LATERAL VIEW explode(xs) e AS x", "VALUES (1), (2)", "SELECT * FROM range(3)"):
        assert adhoc.is_read_only(spark, good), good
    spark.range(9).createOrReplaceTempView("n")
    got = adhoc.run_query(spark, "SELECT id FROM n WHERE id > :least", {"n": spark.range(4)}, {"least": 2})
    assert [r.id for r in got.collect()] == [3]
    assert spark.table("n").count() == 9
    with pytest.raises(PermissionError):
        adhoc.run_query(spark, "DROP VIEW n", {})


def test_questions_reach_the_given_views_only(spark, sf):
    spark.range(3).createOrReplaceTempView("secret")
    views = {"N": spark.range(4)}
    for bad in (f"SELECT * FROM parquet.`{sf}/region.parquet`", "SELECT * FROM secret", "SELECT * FROM n WHERE id IN (SELECT id FROM secret)", "WITH a AS (SELECT * FROM secret) SELECT * FROM a",
                "SELECT (SELECT max(id) FROM default.other) FROM n", "SELECT * FROM n JOIN json.`/etc/passwd`"):
        with pytest.raises(PermissionError, match="not among the views"):
            adhoc.run_query(spark, bad, views)
    assert adhoc.run_query(spark, "WITH secret AS (SELECT id FROM n), b AS (SELECT * FROM Secret) SELECT count(*) AS c FROM b WHERE id IN (SELECT id FROM N)", views).first().c == 4
    spark.catalog.dropTempView("n")
