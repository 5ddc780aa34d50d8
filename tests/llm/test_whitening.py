import math

import numpy as np
import pytest

from loomgraph.llm import whitening as wh
from loomgraph.llm.common import table


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, x int")


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(rows, vectors, components=16):
    """rows of the operator against the definition, over the vectors by id."""
    usable = {i: whole(v) for i, v in vectors.items() if v is not None and None not in v and np.isfinite(v).all()}
    fit = sorted({tuple(x) for x in usable.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = z.T @ z / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, len(sums))
    by = {(r.vec_id, r.component): r for r in rows}
    assert sorted(by) == [(i, c) for i in sorted(usable) for c in range(1, k + 1)] and len(rows) == len(by)
    for (i, c), r in by.items():
        assert r.n == n and r.deviation == sum((n * x - s) ** 2 for x, s in zip(usable[i], sums))
        assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-8, abs=1e-18) and r.identity_error <= 1e-8
    # projections of the fit list: eigenvectors follow from them, either sign
    one_each = {tuple(x): i for i, x in usable.items()}
    y = np.array([[by[one_each[x], c].whitened for c in range(1, k + 1)] for x in fit])
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-7
    for c in range(k):
        e = values[c]
        axis = z.T @ y[:, c] / n / np.sqrt(e)  # V q / e, which is q for an eigenvector
        assert np.linalg.norm(axis) == pytest.approx(1, rel=1e-7)
        assert np.abs(cov @ axis - e * axis).max() <= 1e-9 * values[0]


def test_against_plain(spark):
    rng = np.random.default_rng(7)
    mixed = rng.normal(size=(400, 20)) * np.geomspace(6, 0.2, 20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    v = [r.tolist() for r in mixed.astype(np.float32)]
    v += [v[0], v[0], None, [None] + [1.0] * 19, [float("nan")] + [1.0] * 19, [float("inf")] + [1.0] * 19, [0.0] * 20]
    got = wh.whiten(p := wh.fixed_points(frame(spark, v).repartition(5)), wh.fit(p)).collect()
    check(got, dict(enumerate(v)))


def test_query(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    check(wh.op12_embedding_whitening(spark, sf).collect(), {r.vec_id: r.embedding for r in rows})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 33])
def test_jacobi(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    scale = np.geomspace(1, 1e-9, n)
    a = scale[:, None] * (q @ q.T + 0.3 * q @ np.diag(rng.random(n)) @ q.T) * scale  # graded: eigenvalues over 18 orders of size
    a = (a + a.T) / 2
    values, vectors = wh.jacobi(a)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13
    from fractions import Fraction

    # the product of the eigenvalues is the determinant, which elimination over fractions gives exactly
    m, det = [[Fraction(float(x)) for x in row] for row in a], Fraction(1)
    for i in range(n):
        det *= m[i][i]
        for j in range(i + 1, n):
            f = m[j][i] / m[i][i]
            m[j] = [x - f * y for x, y in zip(m[j], m[i])]
    assert math.prod(map(Fraction, values.tolist())) / det == pytest.approx(1, rel=1e-10)


def test_odd_tables(spark):
    def run(vectors, ids=None):
        p = wh.fixed_points(frame(spark, vectors, ids))
        return wh.whiten(p, wh.fit(p)).collect()

    assert run([]) == [] and run([None, [None]]) == []
    assert [tuple(r) for r in run([[]])] == [(0, None, None, None, None, None, None)]
    # one point, equal points, and a dimension without variance
    assert [tuple(r) for r in run([[1.0, 2.0]])] == [(0, c, 1, 0, None, 0.0, 0.0) for c in (1, 2)]
    got = run([[0.0, 5.0], [1.0, 5.0], [1.0, 5.0]], [9, None, 9])
    assert sorted((r.component, r.whitened is None, r.deviation) for r in got) == [(1, False, 4096)] * 3 + [(2, True, 4096)] * 3
    assert sum(r.vec_id is None for r in got) == 2 and {r.explained for r in got if r.component == 2} == {0.0}
    # another length than the commonest is kept, without results; entries too large for fixed point are not
    got = run([[0.0], [1.0], [1.0, 2.0], [3e38]])
    assert sorted(tuple(r)[:3] for r in got if r.component) == [(0, 1, 2), (1, 1, 2)] and [tuple(r) for r in got if not r.component] == [(2, *[None] * 6)]
    # deviations that fit a long, and that do not
    got = {r.vec_id: r.deviation for r in run([[0.0], [2.0**24], [2.0**40]]) if r.component == 1}
    sums = 3 * 10**6 + 2**30 + 2**46
    assert got[0] == ((3 * 10**6 - sums) ** 2 if (3 * 10**6 - sums) ** 2 < 2**63 else None) and got[2] is None
