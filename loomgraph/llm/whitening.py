"""Whitening of embeddings: a distributed centred scatter, diagonalised in the driver by cyclic Jacobi rotations, and a projection that gives unit covariance.

Entries become fixed-point whole numbers x, so that sums and the mean are exact. The fit list is each distinct vector once. Tasks centre their vectors on the
mean before they multiply and each sends the rows of its part of the scatter, which are added by row in tasks again; the driver gets one row for each
dimension. It rotates pairs of axes, all pairs once a sweep and disjoint pairs at a time, until no off-diagonal entry matters beside its own two
diagonal entries. As that is judged for each entry by itself and not against the largest, small eigenvalues come out as accurately as large ones. The
matrix that projects, dimensions by components, is then sent to the tasks. Dimensions are at most MAX_DIMENSIONS, which bounds the driver's and the tasks' matrices.

Defined cases: rows whose vector is null or holds null, non-finite or too large entries (2**49 and more, not exact in fixed point) are dropped; repeated rows and null ids
are projected each; the length of vectors is the commonest one (of several, the least), and a row of another length appears once, with its id and all else null; whitened is null for components without variance (e not
above rounding), which identity_error leaves out; deviation is null if it fits no long; an empty table, or one without usable rows, yields no rows; columns besides vec_id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, table, tidy, written

#: X is floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS, MAX_DIMENSIONS = 16, 2048
#: Entries from which x would not be exact.
LIMIT = float(1 << 49)


def fixed_points(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x (array<bigint>) of the rows with a usable vector."""
    v = F.col("v")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint") + OFFSET)
    return vectors.select("vec_id", F.col(column).cast("array<double>").alias("v")).filter(v.isNotNull()).filter(usable).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Centre(NamedTuple):
    """n vectors with sums of x by dimension, as whole numbers of any size."""

    n: int
    sums: list[int]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the whole part exactly, then the rest of the mean."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(whole, np.int64)).astype(float) - np.array(rest, object).astype(float) / self.n

    def deviation(self, x: np.ndarray, z: np.ndarray) -> pa.Array:
        """The sum of (n x - S) ** 2 in 64-bit arithmetic, which is exact where the sum fits; null where it does not."""
        word = (1 << 64) - 1
        y = x.astype(np.uint64) * np.uint64(self.n & word) - np.array([s & word for s in self.sums], np.uint64)
        large = self.n * self.n * (z * z).sum(1) > 0.999 * 2.0**63
        return pa.array((y * y).sum(1, dtype=np.uint64).astype(np.int64), pa.int64(), mask=large)


def _rows_added(parts: DataFrame, width: str) -> list:
    """(i, values) of rows (i, part, values): values added up for each i, part by part in order, so that reruns agree."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(2)):
                row = v.values.to_numpy()
                sums[i] = sums[i] + row if i in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "v"])

    return parts.repartition(n, "i").sortWithinPartitions("i", "part").mapInArrow(add, f"i int, v {width}").collect()


def _parts(distinct: DataFrame, of) -> DataFrame:
    """(i, part, values): the rows of each partition's sum of of(x), a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = of(_matrix(b.column(0)))
                total = m if total is None else total + m
        if total is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([at] * len(total), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part", "v"])

    return distinct.mapInArrow(tidy(run), "i int, part int, v array<double>")


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and, as columns, eigenvectors of a symmetric matrix, by cyclic Jacobi rotations in rounds of disjoint pairs."""
    n = len(a)
    a, v = a.copy(), np.eye(n)
    players = n + n % 2
    for _ in range(sweeps):
        turned = 0
        seats = np.arange(players)
        for _ in range(players - 1):
            p, q = seats[: players // 2], seats[::-1][: players // 2]
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
            there = (p < n) & (q < n)
            p, q = np.minimum(p, q)[there], np.maximum(p, q)[there]
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            matters = np.abs(off) > np.finfo(float).eps / 4 * np.sqrt(np.abs(app * aqq))
            if not matters.any():
                continue
            p, q, off, app, aqq = p[matters], q[matters], off[matters], app[matters], aqq[matters]
            turned += len(p)
            theta = (aqq - app) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
            a[p, q] = a[q, p] = 0.0
            # known to more digits than what the products leave
            a[p, p], a[q, q] = app - t * off, aqq + t * off
            v[:, p], v[:, q] = v[:, p] * c - v[:, q] * s, v[:, p] * s + v[:, q] * c
        if not turned:
            break
    return np.diag(a).copy(), v


class Whitening(NamedTuple):
    """values: all eigenvalues, falling; vectors: their unit eigenvectors as columns; components: how many are used, varied: which of those have variance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    components: int
    varied: np.ndarray
    identity_error: float

    def __call__(self, z: np.ndarray) -> np.ndarray:
        k = self.components
        return (z @ self.vectors[:, :k]) / np.sqrt(np.where(self.varied, self.values[:k], 1.0))


def _centre(distinct: DataFrame, dims: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = _matrix(b.column(0))
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = distinct.mapInArrow(run, "i int, n bigint, high bigint, low bigint").groupBy("i").agg(wide("n"), wide("high"), wide("low")).collect()
    by_dimension = sorted(got, key=lambda r: r.i)
    return Centre(int(by_dimension[0].n), [(int(r.high) << 32) + int(r.low) for r in by_dimension])


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Of points (x); None if there are none of at least one dimension."""
    first = points.groupBy(F.size("x").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), "dims").first()
    if first is None:
        return None
    dims = first.dims
    if dims > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {dims} dimensions; {MAX_DIMENSIONS} are the most")
    distinct = written(points.filter(F.size("x") == dims).select("x").distinct(), "whitening")
    centre = _centre(distinct, dims)

    def products(x: np.ndarray) -> np.ndarray:
        z = centre(x)
        return z.T @ z

    scatter = np.zeros((dims, dims))
    for r in _rows_added(_parts(distinct, products), "array<double>"):
        scatter[r.i] = r.v
    covariance = (scatter + scatter.T) / (2 * centre.n)
    values, vectors = jacobi(covariance)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    largest = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[largest, np.arange(dims)] < 0, -1.0, 1.0)
    k = min(components, dims)
    varied = values[:k] > dims * np.finfo(float).eps * values[0]
    w = Whitening(centre, values, vectors, k, varied, 0.0)

    def white(x: np.ndarray) -> np.ndarray:
        """Sums of the whitened, as the last row, below their products."""
        y = w(centre(x))
        return np.vstack([y.T @ y, y.sum(0)])

    got = np.zeros((k + 1, k))
    for r in _rows_added(_parts(distinct, white), "array<double>"):
        got[r.i] = r.v
    dropped(distinct)
    mean = got[k] / centre.n
    off = np.abs(got[:k] / centre.n - np.outer(mean, mean) - np.eye(k))[np.ix_(varied, varied)]
    return w._replace(identity_error=float(off.max()) if off.size else 0.0)


WHITE = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(points: DataFrame, w: Whitening | None) -> DataFrame:
    """A row for each point and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = points.sparkSession
    schema = WHITE.format(points.schema["vec_id"].dataType.simpleString())
    if w is None:
        return spark.createDataFrame([], schema) if points.isEmpty() else points.selectExpr("vec_id", *(f"cast(null as {t}) {c}" for c, t in (x.split() for x in schema.split(", ")[1:])))
    held = spark.sparkContext.broadcast(w._replace(vectors=w.vectors[:, : w.components]))
    dims = len(w.values)
    total = w.values.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        k = w.components
        share = w.values[:k] / total if total else np.zeros(k)
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            ids, x = b.column(0), b.column(1)
            fits = pa.array(x.value_lengths().to_numpy() == dims)
            own, other = b.filter(fits), ids.filter(pa.compute.invert(fits))
            rows = own.num_rows
            if rows:
                m = _matrix(own.column(1))
                z = w.centre(m)
                y = w(z)
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, w.centre.n, np.int64)),
                        w.centre.deviation(m, z).take(pa.array(each)), pa.array(y.ravel(), mask=np.tile(~w.varied, rows)), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, w.identity_error)),
                    ],
                    names,
                )
            if len(other):
                nothing = [pa.nulls(len(other), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([other, *nothing], names)

    return points.select("vec_id", "x").mapInArrow(tidy(run), schema)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    points = fixed_points(table(spark, sf_dir, "embeddings"))
    return whiten(points, fit(points))
