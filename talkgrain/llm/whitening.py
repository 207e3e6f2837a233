"""Embedding whitening: exact sums, a distributed centred scatter, cyclic Jacobi on the driver.

The entries are made whole numbers, so sums and deviations are exact. Each task adds up the products of
centred vectors; the driver gets one d x d matrix, whatever the number of rows, and rotates pairs of its axes until nothing is left off the
diagonal. Jacobi's rotations keep the relative accuracy of small eigenvalues, which whitening divides by. The matrix of d x 16 goes back to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import Scratch

SCALE, SHIFT = 64, 1_000_000
#: An entry so large that x isn't exact as a double counts as not finite.
LARGEST = float(2**46)
COMPONENTS = 16
#: An eigenvalue of at most so much of the largest is rounding: the vectors don't extend along its axis.
TINY = 1e-13


def usable(v: Column) -> Column:
    """Not null, not empty, and every entry finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))  # NaN is above all


def whole(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + SHIFT)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gaps(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: as longs if they hold it, else as Python's whole numbers."""
    top = max(map(abs, total)) + n * int(np.abs(x).max(initial=0))
    return n * x - np.array(total) if top < 2**63 else n * x.astype(object) - np.array(total, dtype=object)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number and exact sums of the vectors x. A task gives d rows, with high and low halves, which don't overflow."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column("x"))
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & (2**26 - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array([n] * d)], names=["i", "high", "low", "n"])

    got = fit.select("x").mapInArrow(run, "i long, high long, low long, n long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("i").collect()
    return got[0]["n"], [(r["high"] << 26) + r["low"] for r in got]


def scatter(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The sum of (x - S/n)(x - S/n)' over the fit list(x). A task gives d rows; each row of the matrix is summed over the tasks on its own."""
    d = len(total)

    def run(batches):
        out = np.zeros((d, d))
        for b in batches:
            c = (gaps(_matrix(b.column("x")), n, total) / n).astype(np.float64)
            out += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "row"])

    def add(t: pa.Table) -> pa.Table:
        rows = _matrix(t.column("row").combine_chunks())
        rows = rows[np.lexsort(rows.T[::-1])]  # the same order whatever came first
        return pa.table({"i": t.column("i")[:1], "row": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    out = np.zeros((d, d))
    for r in fit.select("x").mapInArrow(run, "i long, row array<double>").groupBy("i").applyInArrow(add, "i long, row array<double>").collect():
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix: rotations in cyclic order by rows, until each entry off the
    diagonal is nothing beside its two diagonal entries. An eigenvector's largest entry is positive."""
    a, v, d = a.copy(), np.eye(len(a)), len(a)
    nothing = 1e-20 * np.abs(np.diag(a)).max(initial=0.0)
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                x = a[p, q]
                if abs(x) <= max(nothing, 1e-17 * np.sqrt(abs(a[p, p] * a[q, q]))):
                    a[p, q] = a[q, p] = 0.0
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                low, high = a[p, p] - t * x, a[q, q] + t * x
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                vp = v[:, p].copy()
                v[:, p], v[:, q] = c * vp - s * v[:, q], s * vp + c * v[:, q]
        if not turned:
            break
    else:
        raise RuntimeError("rotations did not settle")
    order = np.argsort(-np.diag(a), kind="stable")
    value, v = np.diag(a)[order], v[:, order]
    v = v / np.sqrt((v * v).sum(axis=0))
    return value, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitener:
    """n and S of the fit list, unit axes as columns, their variances and their shares of the whole."""

    n: int
    total: list[int]
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of x projected and scaled; NaN along an axis on which the fit list has no extent."""
        flat = self.variance <= TINY * max(self.variance.max(initial=0.0), 0.0)
        return np.where(flat, np.nan, (gaps(x, self.n, self.total) / self.n).astype(np.float64) @ self.axes / np.sqrt(np.where(flat, 1.0, self.variance)))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitener:
    """The whitener of the vectors x of a table, all of one length. The driver gets d sums and d x d products."""
    d = distinct.select(F.size("x").alias("d")).first()["d"]
    n, total = sums(distinct, d)
    v = scatter(distinct, n, total) / n
    value, axes = jacobi(v)
    k = min(components, d)
    whole_variance = float(np.trace(v))
    return Whitener(n, total, axes[:, :k], np.maximum(value[:k], 0.0), value[:k] / whole_variance if whole_variance > 0 else np.full(k, np.nan))


def identity_error(distinct: DataFrame, w: Whitener) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list less the identity, along axes on which it has extent.

    Each task centres its whitened vectors on their own mean; means and products of two parts are merged as Chan, Golub and LeVeque do.
    """
    live = w.variance > TINY * max(w.variance.max(initial=0.0), 0.0)
    k = int(live.sum())
    if not k:
        return None

    def merged(a, b):
        (n, m, p), (o, r, q) = a, b
        gap = r - m
        return n + o, m + gap * o / (n + o), p + q + np.outer(gap, gap) * n * o / (n + o)

    def row(part):
        return pa.RecordBatch.from_arrays([pa.array([part[0]], pa.int64()), pa.array([list(part[1])], pa.list_(pa.float64())), pa.array([list(part[2].ravel())], pa.list_(pa.float64()))], names=["n", "m", "p"])

    def run(batches):
        part = None
        for b in batches:
            y = w(_matrix(b.column("x")))[:, live]
            if len(y):
                m = y.mean(axis=0)
                new = (len(y), m, (y - m).T @ (y - m))
                part = new if part is None else merged(part, new)
        if part is not None:
            yield row(part)

    def again(batches):
        part = None
        for b in batches:
            for n, m, p in zip(b.column("n").to_pylist(), b.column("m").to_pylist(), b.column("p").to_pylist(), strict=True):
                new = (n, np.array(m), np.array(p).reshape(k, k))
                part = new if part is None else merged(part, new)
        if part is not None:
            yield row(part)

    kinds = "n long, m array<double>, p array<double>"
    parts = distinct.select("x").mapInArrow(run, kinds)  # 16 x 16 numbers a task
    parts = parts.repartition(64).mapInArrow(again, kinds).collect()  # 64 rows
    part = None
    for r in parts:
        new = (r["n"], np.array(r["m"]), np.array(r["p"]).reshape(k, k))
        part = new if part is None else merged(part, new)
    return float(np.abs(part[2] / part[0] - np.eye(k)).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    vectors: vec_id, embedding; other columns are ignored. Rows whose vector is null, empty or holds null, non-finite or too large (LARGEST)
    entries go. Only vectors of one length have a covariance: of several lengths that of most distinct vectors counts, of equally many the
    greater, and rows of other lengths go, too. Rows that repeat a vec_id, or have none, are vectors of their own. whitened is null along an axis on
    which the fit list has no extent, explained where it has none at all; deviation is null where it exceeds a long. An empty table gives an empty result.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    rows = scratch.write(vectors.filter(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("x")), "rows")
    distinct = scratch.write(rows.select("x").distinct(), "distinct")
    size = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"vec_id {kind}, {RESULT}"
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    one_length = F.size("x") == size["d"]
    w = fit(distinct.filter(one_length), components)
    error = identity_error(distinct.filter(one_length), w)
    k = w.axes.shape[1]

    def deviations(x: np.ndarray) -> pa.Array:
        gap = gaps(x, w.n, w.total)
        if float(np.abs(gap).max(initial=0)) ** 2 * gap.shape[1] < 2.0**62:
            return pa.array((gap * gap).sum(axis=1).astype(np.int64))
        exact = [sum(g * g for g in r) for r in gap.tolist()]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = _matrix(part.column("x"))
                y, m = w(x).ravel(), len(x)
                of = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(of),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, w.n)),
                        deviations(x).take(of),
                        pa.array(y, mask=np.isnan(y)),
                        pa.array(np.tile(w.explained, m), mask=np.tile(np.isnan(w.explained), m)),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.filter(one_length).mapInArrow(run, schema)
