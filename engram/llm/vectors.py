"""Vectors as whole numbers, and exact sums over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums of products of doubles are exact below this.
EXACT = 1 << 53
MOST = 10**38 - 1


def whole_vectors(df: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is neither null nor holds null or non-finite entries, with x: floor(scale * entry), in doubles.

    Entries beyond a long are the nearest long.
    """
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return df.where(F.col(vector).isNotNull() & finite).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))))


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, row numbers, matrix) of the vectors of each length; vectors without an entry are left out."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        if d:
            rows = np.flatnonzero(sizes == d)
            yield d, rows, flat.reshape(-1, d) if len(rows) == len(sizes) else flat[ends[rows][:, None] + np.arange(d)]


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers, exactly: in doubles, in longs, or in Python's numbers where the entries ask for it."""
    most = largest(a) * largest(b) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b if most < 1 << 62 else a.astype(object) @ b.astype(object)


def totals(rows: DataFrame, of: Callable[[int, np.ndarray], np.ndarray], exact: bool = True) -> dict[int, np.ndarray]:
    """The sums of of(dims, matrix), an array of one size for each length of vectors, over all vectors x; a task sends one array a length.

    Exact sums are Python's numbers, up to 38 digits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                t = of(d, x)
                held[d] = held.get(d, 0) + (t.astype(object) if exact else t)
        for d, t in held.items():
            n = len(t)
            total = pa.array([Decimal(int(v)) for v in t], pa.decimal128(38, 0)) if exact else pa.array(t, pa.float64())
            yield pa.record_batch({"dims": pa.array([d] * n, pa.int32()), "place": pa.array(range(n), pa.int32()), "total": total})

    sums = rows.select("x").mapInArrow(work, f"dims int, place int, total {'decimal(38,0)' if exact else 'double'}")
    out: dict[int, dict] = {}
    for d, place, total in sums.groupBy("dims", "place").agg(F.sum("total")).collect():  # one number for each place
        out.setdefault(d, {})[place] = int(total) if exact else total
    return {d: np.array([t[i] for i in range(len(t))], object if exact else np.float64) for d, t in out.items()}
