"""Declarations with their scopes."""

import time

import pytest

from loomgraph.sources import symbols as sy
from loomgraph.functions.declarations import declarations


def found(language, text):
    return [(d.name, d.kind, d.start_line, d.end_line, d.parent) for d in declarations(text, language, sy._rules(language))]


CASES = {
    "one line": ("typescript", "export class A { f() { return 1 } }; function g() { function h() {} } const k = (x) => { class B {} }",
                 [("A", "class", 1, 1, None), ("g", "function", 1, 1, None), ("h", "function", 1, 1, "g"), ("k", "function", 1, 1, None), ("B", "class", 1, 1, "k")]),
    "nested": ("javascript", "function a() {\n  if (x) {\n    function b() {\n    }\n  }\n}\n\nfunction c() {}\n", [("a", "function", 1, 6, None), ("b", "function", 3, 4, "a"), ("c", "function", 8, 8, None)]),
    "strings and comments": ("typescript", "// function no() {\n/* class No {\n} */\nconst s = 'function no2() {';\nconst t = `class ${'{'} {`;\nfunction yes() {\n  return \"}\";\n}\n", [("s", "constant", 4, 4, None), ("t", "constant", 5, 5, None), ("yes", "function", 6, 8, None)]),
    "brace below": ("csharp", "public class A\n{\n    public void F()\n    {\n    }\n}\n", [("A", "class", 1, 6, None), ("F", "function", 3, 5, "A")]),
    "python": ("python", "class A:\n    '''def no():'''\n    def f(self):\n        def g(): pass\n        return g\n\n    X = 1\n\ndef h(): return 1\nY = 2\n", [("A", "class", 1, 7, None), ("f", "function", 3, 5, "A"), ("g", "function", 4, 4, "f"), ("h", "function", 9, 9, None), ("Y", "constant", 10, 10, None)]),
    "ruby": ("ruby", "module M\n  class A\n    def f; 1; end\n    def g(x)\n      x.each do |y|\n        puts 'end'\n      end\n    end\n    def h = 1\n  end\nend\n", [("M", "class", 1, 11, None), ("A", "class", 2, 10, "M"), ("f", "function", 3, 3, "A"), ("g", "function", 4, 8, "A"), ("h", "function", 9, 9, "A")]),
    "go": ("go", "type T struct {\n  x int\n}\n\nfunc (t *T) F() {\n\tfor {\n\t}\n}\n", [("T", "class", 1, 3, None), ("F", "function", 5, 8, None)]),
    "rust": ("rust", "pub struct S;\nimpl S {\n    pub fn f<'a>(&'a self) -> char { '}' }\n}\n", [("S", "class", 1, 1, None), ("f", "function", 3, 3, None)]),
    "unclosed": ("java", "public class A {\n  public void f() {\n", [("A", "class", 1, 2, None), ("f", "function", 2, 2, "A")]),
    "too many closed": ("java", "}\n}\npublic class A { }\n", [("A", "class", 3, 3, None)]),
    "nothing": ("typescript", "", []),
}


@pytest.mark.parametrize("case", CASES)
def test_scopes(case):
    language, text, want = CASES[case]
    assert found(language, text) == want


@pytest.mark.parametrize("language", ["typescript", "python"])
def test_linear_in_length(language):
    one = "function f() { if (x) { a() } }\n" if language == "typescript" else "def f():\n    if x: a()\n"

    def took(n):
        began = time.process_time()
        assert len(declarations(one * n, language, sy._rules(language))) == n
        return time.process_time() - began

    took(500)
    assert took(20_000) < 8 * took(5_000) + 0.2


def test_table_function(spark):
    sy.register(spark)
    spark.createDataFrame([("a.ts", "typescript", "class A { }"), ("n", "typescript", None), ("m.md", "markdown", "class A {}")], "path string, language string, content string").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT path, s.name, s.depth FROM sources, LATERAL file_symbols(language, content) s").collect()
    assert [tuple(r) for r in rows] == [("a.ts", "A", 0)]
