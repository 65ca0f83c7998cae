"""Embedding whitening by sums of centred products for every pair of dimensions.

Entries become whole numbers, so that sums are exact in any order: an entry c is
x = floor(64 * c) + 1000000.  One aggregation over the distinct vectors gives
counts, sums and extremes of each dimension; a second one holds a generated
``sum((x_i - m_i) * (x_j - m_j))`` for every pair of the upper triangle, m being
the mean rounded to a whole number.  What rounding left of the mean is taken out
of the assembled matrix in whole numbers too, which LAPACK then decomposes.
Only those sums reach the driver: their number depends on the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tidied

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
PAIRS = 8_400  # sums of one aggregation, those of 129 dimensions; a larger triangle takes several over the stored list
FARTHEST = 1 << 52  # entries are held to this range, beyond which a double has no whole steps
FLAT = 1e-12  # of the trace: a component with a smaller eigenvalue cannot be scaled


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of x, by dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, one a row
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)[:, None]


def whole(embedding: Column) -> Column:
    """The array of whole numbers of a vector; null where the vector or an entry of it is null or not finite."""
    number = embedding.cast("array<double>")
    finite = F.forall(number, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is the largest of all
    held = lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(FARTHEST)), F.lit(-FARTHEST))
    return F.when(finite, F.transform(number, lambda c: held(c) + F.lit(OFFSET)))


def triangle_sums(df: DataFrame, cols: list[str], most: int = PAIRS) -> np.ndarray:
    """Sums of products of every two columns, exact for longs: an object array of Python numbers, symmetric.

    Columns that cannot be null make for much shorter generated code.
    """
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d), object)
    for start in range(0, len(pairs), most):
        part = pairs[start : start + most]
        row = df.selectExpr(*[f"sum({cols[i]} * {cols[j]}) as p{i}_{j}" for i, j in part]).first()
        for (i, j), v in zip(part, row, strict=True):
            out[i, j] = out[j, i] = 0 if v is None else v
    return out


def prepared(df: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and x of the rows that remain.

    Dropped: a vector that is null or holds a null or an entry that is not
    finite.  Whitening has one number of dimensions: the most frequent one, the
    larger of two; other vectors, and those without entries, are dropped too.
    """
    x = df.select(F.col(key).alias("vec_id"), whole(F.col(vec)).alias("x")).where(F.size("x") > 0)
    widths = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = widths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()[0]
    return x.where(F.size("x") == F.lit(best or 0))


def fitted(rows: DataFrame, components: int = COMPONENTS, most: int = PAIRS) -> tuple[DataFrame, Whitening | None]:
    """The stored list of distinct vectors and what was learned from it; None if no direction varies."""
    listed = stored(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "vectors")
    first = listed.select(F.size("x").alias("d")).first()
    if first is None:
        return listed, None
    d = first.d
    at = [F.get("x", F.lit(i)) for i in range(d)]
    told = listed.agg(F.count(F.lit(1)), *[f(a) for f in (F.sum, F.min, F.max) for a in at]).first()
    n, sums, low, high = told[0], *(list(told[1 + k * d : 1 + (k + 1) * d]) for k in range(3))
    mean = [round(s / n) for s in sums]
    reach = max(max(h - m, m - x) for h, m, x in zip(high, mean, low, strict=True))
    exact = n * reach * reach < 1 << 62  # beyond, products are added as doubles
    kind = "long" if exact else "double"
    cols = [f"y{i}" for i in range(d)]
    centred = listed.selectExpr(*[f"cast(coalesce(x[{i}], 0L) - {m}L as {kind}) as {c}" for i, (m, c) in enumerate(zip(mean, cols, strict=True))])
    s2 = triangle_sums(centred, cols, most)
    left = [s - n * m for s, m in zip(sums, mean, strict=True)]
    cov = np.array([[(n * s2[i, j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)], float)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    trace = float(np.trace(cov))
    order = [k for k in order[:components] if trace > 0 and values[k] > FLAT * trace]
    return listed, Whitening(n, sums, values[order], vectors[:, order].T.copy(), trace) if order else None


def _centred(col: pa.ListArray, d: int, net: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S of a batch, and (x - S / n) as doubles.

    Both are exact before the last rounding, as differences from the mean's whole part.
    """
    x = np.asarray(col.flatten(), np.int64).reshape(-1, d)
    base = np.array([s // net.n for s in net.sums], np.int64)
    part = np.array([s % net.n for s in net.sums], np.int64)
    y = x - base
    return y, y - part / net.n


def _deviation(y: np.ndarray, net: Whitening) -> pa.Array:
    """Sum of (n * x - S)^2; null where it is beyond a long."""
    part = [s % net.n for s in net.sums]
    near = (np.square(y.astype(float) * net.n).sum(1) < 1e17) & (np.abs(y).max(1, initial=0) * float(net.n) < 2e9)
    fast = np.square(y * net.n - np.array(part, np.int64)).sum(1)
    out = [int(f) if ok else sum((int(v) * net.n - p) ** 2 for v, p in zip(row, part, strict=True)) for f, ok, row in zip(fast, near, y, strict=True)]
    return pa.array([v if v < 1 << 63 else None for v in out], pa.int64())


def _projector(net: Whitening):
    k, d = net.vectors.shape
    scaled = net.scaled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, real = _centred(batch.column("x"), d, net)
                flat = pa.array((real @ scaled.T).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _deviation(y, net), lists], names=["vec_id", "deviation", "white"])

    return run


def projected(rows: DataFrame, net: Whitening) -> DataFrame:
    """vec_id, deviation and ``white`` (the whitened vector) of rows with vec_id and x."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(tidied(_projector(net)), f"vec_id {kind}, deviation long, white array<double>")


def identity_error(listed: DataFrame, net: Whitening) -> float:
    """Largest absolute entry of the measured covariance of the whitened list minus the identity."""
    k = len(net.values)
    white = projected(listed.select(F.lit(None).cast("long").alias("vec_id"), "x"), net)
    cols = [f"w{i}" for i in range(k)]
    means = white.agg(*[F.avg(F.get("white", F.lit(i))) for i in range(k)]).first()
    centred = white.selectExpr(*[f"coalesce(white[{i}], 0D) - {m!r}D as {c}" for i, (m, c) in enumerate(zip(means, cols, strict=True))])
    return float(np.abs(triangle_sums(centred, cols).astype(float) / net.n - np.eye(k)).max())


def whitened(df: DataFrame, vec: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``prepared`` says which rows remain.  Repeated rows and null ids are given
    as often as they occur; equal vectors count once in the fit.  Components
    whose eigenvalue is zero (fewer distinct vectors than dimensions, constant
    dimensions) have no scale and are left out, so one distinct vector, or an
    empty table, gives an empty table.  ``deviation`` is null where it does not
    fit in a long.  Extra columns are ignored.
    """
    rows = prepared(df, vec, key)
    listed, net = fitted(rows, components)
    if net is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(listed, net)
    share = F.array(*[F.lit(float(v / net.trace)) for v in net.values])
    out = projected(rows, net).select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(net.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
