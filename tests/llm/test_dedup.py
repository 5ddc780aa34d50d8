import random

import numpy as np
import pytest
from compare import connect, differences
from llm.helpers import EDGES, components, frame, near

from loomgraph.llm import embedding_dedup as em
from loomgraph.llm import minhash as mh
from loomgraph.llm.components import components as spark_components, roots
from loomgraph.llm.wordhash import Words, shingle_sets


@pytest.mark.parametrize("module", [em, mh])
def test_against_sql(spark, sf, module):
    con = connect(sf)
    for name, sql in module.SQL.items():
        assert differences(getattr(module, name)(spark, sf), con, sql) == ""


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        centre = rng.normal(size=8) if i % 7 == 0 else centre
        rows.append((i, (centre + rng.normal(size=8) * rng.choice([0.02, 0.25])).tolist(), int(i // 7 % 3)))
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 8, 0), (1003, [float("nan")] + [1.0] * 7, 0), (1004, [None] + [1.0] * 7, 0), (1005, rows[0][1], None), (1006, [1e300] * 8, 1), (1007, [1e-300] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    good = [(i, np.array(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), lab) for i, v, lab in good]
    links = [(a, b) for n, (a, x, la) in enumerate(unit) for b, y, lb in unit[n + 1 :] if la == lb and x @ y >= 0.93]
    want = components([r[0] for r in rows], links)
    got = {r.vec_id: r for r in em.link_vectors(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {r[0]: sum(r[0] in x for x in links) for r in rows}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert em.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark):
    rows = [(i, [1.0, 0.01 * i, 0.5], 0) for i in range(5)] + [(10 + i, [1.0, 0.01 * i], 0) for i in range(3)] + [(20, [1.0, 0.0], 1), (21, [1.0, 0.0, 0.5], 1)]
    got = {r.vec_id: (r.component_id, r.n_links) for r in em.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {**{i: (0, 4) for i in range(5)}, **{10 + i: (10, 2) for i in range(3)}, 20: (20, 0), 21: (21, 0)}


def _family(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 60, 300]))]
        for j in range(rng.choice([1, 2, 6])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((200 + len(rows), " ".join(t).upper() if j % 2 else "\n".join(t)))
    return rows


def test_texts_against_brute_force(spark):
    rows = _family(random.Random(5)) + EDGES
    want, sizes = near(rows, 4)
    got = {r.doc_id: r for r in mh.near_duplicates(frame(spark, rows, "n_shingles string, component_id string", ("x", "y")).select("doc_id", "text"), k=4).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    # pairs close to the limit may share no band with a probability of 2 in 10**5; none here does
    assert {i: r.component_id for i, r in got.items()} == want


def test_large_group_of_copies(spark):
    base = " ".join(f"a{i}" for i in range(100))
    rows = [(i, base + (f" extra{i % 40}" if i % 2 else "")) for i in range(400)]
    got = mh.near_duplicates(frame(spark, rows), k=5).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_template_family_against_brute_force(spark):
    # all texts share a template, at a similarity of 0.74 to 0.77, and pairs a few words more: what a pair shares, hundreds of others share, too
    k, template, own, common = 5, 240, 34, 10
    rows = []
    for i in range(4000):
        words = [f"t{j}" for j in range(template)] + [f"p{i // 2}x{j}" for j in range(common)] + [f"o{i}x{j}" for j in range(own - i // 2 % 5 * 2)]
        rows.append((i, " ".join(words)))
    index, sets = {}, [[] for _ in rows]
    for i, text in rows:
        w = text.split()
        for j in range(len(w) - k + 1):
            sets[i].append(index.setdefault(tuple(w[j : j + k]), len(index)))
    # shingles of two texts in common: those of the template, and what they have besides
    n = np.array([len(s) for s in sets])
    seen = np.bincount(np.concatenate(sets))
    links = []
    for i, s in enumerate(sets):
        if i % 2 == 0:
            both = len(set(s) & set(sets[i + 1]))
            if 100 * both >= 80 * (n[i] + n[i + 1] - both):
                links.append((i, i + 1))
    # texts of different pairs share the template's shingles only, and are not similar
    assert 100 * int((seen > 2).sum()) < 80 * (2 * int(n.min()) - int((seen > 2).sum())) and len(links) >= 400
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(frame(spark, rows), k=k).collect()}
    assert got == components(got, links)


def test_parities_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, size)) for size in (1, 50, 900, 3000, 2, 0, 50)]
    p = mh.parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    sets = [s for s in sets if len(s)]
    assert len(p) == len(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_keep_one_with_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (4, "")]
    out = sorted(((r.doc_id, r.lang) for r in mh.keep_one(frame(spark, rows, "lang string", ("en",))).collect()), key=str)
    assert out == sorted([(1, "en"), (None, "en"), (None, "en"), (3, "en"), (4, "en")], key=str)
    assert mh.keep_one(frame(spark, rows).limit(0)).count() == 0


def test_shingle_sets_count_distinct_shingles():
    texts = ["a b c d a b c d", "", "x", "x y z", "p q r s t"]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *map(len, texts)])
    sets, at = shingle_sets(Words(np.frombuffer(raw, np.uint8), off), 4)
    assert np.diff(at).tolist() == [4, 0, 1, 1, 2] and len(set(sets.tolist())) == 8


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)]
    got = {r.id: r.component for r in spark_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == components(got, edges)


def test_roots_of_a_forest(spark):
    parents = [(i, i - 1) for i in range(1, 40)] + [(i, 100) for i in range(101, 160)] + [(200, 150)]
    got = {r.id: r.component for r in roots(spark.createDataFrame(parents, "id bigint, parent bigint")).collect()}
    assert got == components(got, parents)
    assert roots(spark.createDataFrame([], "id bigint, parent bigint")).count() == 0 == spark_components(spark.createDataFrame([], "a bigint, b bigint")).count()


def test_blank_texts_only(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (3, "\t")]
    got = mh.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (3, 0, 3, True)]


def test_repeated_ids_tie_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a), (9, b + " more"), (8, "quite another text of more than five words"), (None, a), (None, b)]
    got = mh.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("8", "8", True), ("9", "5", False), ("None", "None", True), ("None", "None", True)]
