"""Embedding whitening by cyclic Jacobi.

The distinct vectors are staged once. A pass sums them, a second one gathers the centred
scatter: whole numbers, so that both are exact and don't depend on the order of tasks. The
driver holds one matrix of dims x dims and turns it by symmetric rotations until nothing is
left beside the diagonal; the whitening matrix, a few columns, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import MOST, by_length, largest, products, totals, whole_vectors

SCALE, OFFSET = 64, 1_000_000
EPS = float(np.finfo(np.float64).eps)


def jacobi(matrix: np.ndarray, sweeps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, the largest entry positive) of a symmetric matrix.

    A sweep turns every pair of coordinates once, in the order of a round-robin tournament, whose
    rounds hold disjoint pairs and are done at one go. A pair is turned while its entry is above the
    rounding of its two diagonal entries, which keeps small eigenvalues accurate.
    """
    a, d = matrix.astype(np.float64).copy(), len(matrix)
    v, seats = np.eye(d), np.arange(d + d % 2)
    floor = EPS * EPS * max(float(np.abs(a).max(initial=0.0)), np.finfo(np.float64).tiny)
    for _ in range(sweeps):
        turned = 0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < d], q[q < d]
            off = a[p, q]
            far = np.abs(off) > EPS * np.sqrt(np.abs(a[p, p] * a[q, q])) + floor
            p, q, off = p[far], q[far], off[far]
            if not len(p):
                continue
            turned += len(p)
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(1.0, theta))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            for m in (a, v):
                mp, mq = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
            ap, aq = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * ap - s[:, None] * aq, s[:, None] * ap + c[:, None] * aq
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    e = np.diagonal(a)
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    sign = np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0) if d else 1.0
    return e[order], v * sign


class Whitening(NamedTuple):
    """What a task needs for vectors of one length."""

    n: int
    centre: np.ndarray  # whole part of the means
    rest: np.ndarray  # n times what the means have besides, 0 to n - 1
    axes: np.ndarray  # dims x components, over the root of the eigenvalue; zero where there is no variance
    explained: np.ndarray
    used: np.ndarray  # components with variance

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        y = x - self.centre
        wide = self.n * (largest(y) + 1) >= 1 << 62
        return (y.astype(object) if wide else y) * self.n - self.rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x).astype(np.float64) / self.n) @ self.axes


def fit(vectors: DataFrame, components: int = 16) -> dict[int, Whitening]:
    """The whitening of each length of vectors x, each vector given once."""
    known = totals(vectors, lambda d, x: np.append(x.astype(object).sum(0), len(x)))
    n_of = {d: int(t[-1]) for d, t in known.items()}
    centres = {d: np.array([int(v) // n_of[d] for v in t[:-1]], np.int64) for d, t in known.items()}

    def scatter(d: int, x: np.ndarray) -> np.ndarray:
        y = x - centres[d]
        return products(y.T, y)[np.triu_indices(d)]

    out = {}
    for d, upper in totals(vectors, scatter).items():
        n = n_of[d]
        rest = [int(s) - n * int(c) for s, c in zip(known[d][:-1], centres[d], strict=True)]
        v = np.zeros((d, d))
        for i, j, m in zip(*np.triu_indices(d), upper, strict=True):
            v[i, j] = v[j, i] = float(Fraction(n * int(m) - rest[i] * rest[j], n * n))
        e, axes = jacobi(v)
        e, axes, trace = np.maximum(e[:components], 0.0), axes[:, :components], float(np.trace(v))
        used = e > trace * d * EPS
        scale = np.where(used, 1 / np.sqrt(np.where(used, e, 1.0)), 0.0)
        rest = np.array(rest, np.int64 if n < 1 << 62 else object)
        out[d] = Whitening(n, centres[d], rest, axes * scale, e / trace if trace > 0 else np.zeros(len(e)), used)
    return out


def identity_errors(vectors: DataFrame, models: dict[int, Whitening]) -> dict[int, float | None]:
    """For each length: how far the covariance of the whitened vectors, measured over all of them, is from the identity; None without a component."""
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def moments(d: int, x: np.ndarray) -> np.ndarray:
        w = sent.value[d].project(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    out: dict[int, float | None] = {}
    for d, t in totals(vectors, moments, exact=False).items():
        m, k = models[d], len(models[d].used)
        mean = t[:k] / m.n
        off = np.abs(t[k:].reshape(k, k) / m.n - np.outer(mean, mean) - np.eye(k))[m.used][:, m.used]
        out[d] = float(off.max()) if off.size else None
    return out


def whiten(df: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: key, component, n, deviation (decimal), whitened, explained, identity_error.

    x is floor(64 * entry) + 1000000; means, covariance and components are those of the distinct
    vectors. Rows whose vector is null, empty or holds null or non-finite entries give no rows;
    repeated rows and null keys keep rows of their own. Vectors of different lengths are fitted
    length by length. A component without variance (fewer distinct vectors than components, or
    constant entries) has whitened null and explained 0; identity_error is null where no component
    has variance. An empty table gives an empty result; other columns are ignored.
    """
    rows = whole_vectors(df.select(key, vector), SCALE, vector).select(F.col(key).alias("key"), F.transform("x", lambda c: c + F.lit(OFFSET)).alias("x"))
    distinct = stage(rows.select("x").distinct(), "fit-list")
    models = fit(distinct, components)
    errors = identity_errors(distinct, models)
    sent = df.sparkSession.sparkContext.broadcast((models, errors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = sent.value
        for batch in batches:
            for d, at, x in by_length(batch.column(1)):
                m = models[d]
                k, apart, n = len(m.used), m.spread(x), len(x)
                if largest(apart) ** 2 * d < 1 << 62:
                    deviation = pa.array((apart * apart).sum(1).astype(np.int64)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([Decimal(min(int(v), MOST)) for v in (apart.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
                each = np.repeat(np.arange(n), k)
                yield pa.record_batch({
                    "key": batch.column(0).take(pa.array(at[each])),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    "n": pa.array(np.full(n * k, m.n, np.int64)),
                    "deviation": deviation.take(pa.array(each)),
                    "whitened": pa.array(m.project(x).ravel(), mask=np.tile(~m.used, n)),
                    "explained": pa.array(np.tile(m.explained, n)),
                    "identity_error": pa.array([errors[d]] * (n * k), pa.float64()),
                })

    schema = f"key {rows.schema['key'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.mapInArrow(work, schema).withColumnRenamed("key", key)
