import hashlib
import zlib

import pytest
from compare import connect, differences
from llm.helpers import lowered

from loomgraph.llm import merkle as mk
from loomgraph.llm.common import bucket

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root, and for each node the runs that it is in, level by level, as (nodes of the run, place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for p, i in zip(paths, at):
            p.append((runs[i // 16], i % 16))
        nodes, at = [H(*r) for r in runs], [i // 16 for i in at]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows."""
    of = {}
    for r in rows:
        leaf = H(*map(field, r))
        claimed = H(*map(field, (*r[:4], None if r[4] is None else lowered(r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
        of.setdefault(b"" if r[1] is None else b"s" + r[1].encode(), []).append((r[0] is not None, r[0] or 0, leaf, claimed))
    names = sorted(of)
    subs = {s: tree([x[2] for x in sorted(of[s])]) for s in names}
    root, above = tree([subs[s][0] for s in names])
    out = []
    for s, top in zip(names, above):
        for (known, i, leaf, f), path in zip(sorted(of[s]), subs[s][1]):
            proof = ""
            for run, k in path + top:
                proof += "".join(run[:k] + run[k + 1 :])
                f = H(*run[:k], f, *run[k + 1 :])
            out.append((i if known else None, leaf, subs[s][0], root, H(proof), f, f == root))
    return out


def op(docs):
    return mk.Manifest(mk.leaves(docs, {"text": mk.lowered(docs["text"])}, bucket("doc_id", 5) == 0)).proofs()


def ordered(rows):
    return sorted(rows, key=str)


ODD = [(1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "abd"), (None, "a", None, None, None), (None, None, None, None, ""), (2, None, "en", 0, ""), (5, "ü", "de", 2, "Ä漢🙂Z"),
       (3, "", "x", 1, "X" * 200_000), (-4, "b", "y", 2, "neg"), (10, "z", None, None, "alone")]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[5:6] * 2, [(i, "s%d" % (i % 40 if i % 3 else 0), "en", i, "Text %d" % i) for i in range(1500)]])
def test_against_plain(spark, rows):
    got = op(spark.createDataFrame(rows, COLUMNS)).collect()
    assert ordered(map(tuple, got)) == ordered(plain(rows))


def test_levels_above_buckets(spark):
    """A source of several buckets whose last one has one leaf, and more sources than a run has."""
    n = 16 * mk.SPAN // 8 + 1
    rows = [(i, "hot", "en", 1, "T%d" % i) for i in range(n)] + [(i, "s%d" % i, "en", 1, "x") for i in range(300)]
    got = op(spark.createDataFrame(rows, COLUMNS).repartition(7)).collect()
    assert ordered(map(tuple, got)) == ordered(plain(rows))


def test_query_against_sql(spark, sf):
    assert differences(mk.op11_merkle_manifest(spark, sf), connect(sf), mk.SQL["op11_merkle_manifest"]) == ""


def test_empty_table_and_names(spark):
    assert op(spark.createDataFrame([], COLUMNS)).count() == 0
    more = spark.createDataFrame([(*r, 1, b"x") for r in ODD], COLUMNS + ", pos int, tree binary")
    assert ordered(map(tuple, op(more).collect())) == ordered(plain(ODD))
