"""Index files from real bytes."""

import pytest

from loomgraph.sources import index


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def number(field, n):
    return varint(field << 3) + varint(n)


def text(field, value):
    raw = value if isinstance(value, bytes) else value.encode()
    return varint(field << 3 | 2) + varint(len(raw)) + raw


def occurrence(symbol, place, roles=0, more=b""):
    return text(2, text(1, b"".join(map(varint, place))) + text(2, symbol) + (number(3, roles) if roles else b"") + more)


F_ID, G_ID = "s npm . . `b.ts`/f().", "s npm . . `c.ts`/K#g()."
FILE = (
    text(1, number(1, 7) + text(9, "metadata")) + text(2, text(1, "a.ts") + text(4, "typescript") + occurrence(F_ID, [4, 1, 7], 8) + occurrence(F_ID, [1, 0, 2, 300], 1)
         + occurrence(G_ID, [9, 0, 3], 0, text(6, number(1, 2) + text(2, "TS1") + text(3, "wrong – ü")) + text(6, number(1, -1)))
         + text(3, text(1, F_ID) + text(3, "doc one") + text(3, "doc two") + text(7, text(4, "typescript") + text(5, "function f(): void")) + text(4, text(1, G_ID) + number(3, 1)))
         + varint(90 << 3 | 1) + bytes(8) + varint(91 << 3 | 5) + bytes(4))
    + text(3, text(1, G_ID) + text(7, text(5, "g(x: number)"))) + text(2, text(1, "empty.ts"))
)


def test_read(spark, tmp_path):
    (tmp_path / "one.scip").write_bytes(FILE)
    (tmp_path / "two.scip").write_bytes(b"")
    (tmp_path / "many.scip").write_bytes(b"".join(text(2, text(1, f"m{i}.ts") + occurrence(F_ID, [i, 0, 1])) for i in range(450)))
    d = index.read(spark, str(tmp_path))
    assert d.count() == 1 + 1 + 1 + 450
    own = d.filter("not startswith(relative_path, 'm') or external")
    got = sorted((r.path, r.line, r.roles, r.def_path, r.name) for r in index.occurrences(own).collect())
    assert got == [("a.ts", 2, 1, "b.ts", "f"), ("a.ts", 5, 8, "b.ts", "f"), ("a.ts", 10, 0, "c.ts", "g")]
    assert [r.line for r in index.references(index.occurrences(own)).orderBy("line").collect()] == [5, 10]
    assert sorted((r.line, r.end_line, r.severity, r.code, r.message) for r in index.diagnostics(d).collect()) == [(10, 10, -1, "", ""), (10, 10, 2, "TS1", "wrong – ü")]
    s = {r.symbol: (r.path, r.name, r.signature, r.documentation) for r in index.symbol_table(d).collect()}
    assert s == {F_ID: ("a.ts", "f", "function f(): void", ["doc one", "doc two"]), G_ID: (None, "g", "g(x: number)", [])}
    rel = d.filter("relative_path = 'a.ts'").first().symbols[0].relationships
    assert [(r.symbol, r.is_reference, r.is_implementation) for r in rel] == [(G_ID, False, True)]


def test_a_file_that_breaks_off(spark, tmp_path):
    (tmp_path / "cut.scip").write_bytes(FILE[:-3])
    with pytest.raises(Exception, match="ends within a field"):
        index.read(spark, str(tmp_path)).collect()
