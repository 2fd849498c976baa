"""Whitening of embeddings on the leading principal components of their integer grid.

Sums and covariances are sums of whole numbers: tasks multiply centred grid values in
blocks whose products double precision holds exactly, and Spark adds the blocks up as
decimals, so no order of tasks changes a digit.  Only matrices of dimension times
dimension come to the driver, where contour integration finds the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored
from .feast import leading_pairs

SCALE, SHIFT = 64, 1_000_000
#: Grid values further out are taken as this: beyond any embedding, and small enough for exact sums over 2 ** 40 rows.
OUTERMOST = 1 << 40
#: Dimensions that the driver takes: its matrices have the square of it.
MOST = 4096
#: Rows multiplied at a time, and the largest value whose products they hold exactly: 2 ** 13 * (2 ** 20) ** 2 = 2 ** 53.
ROWS, EXACT = 1 << 13, 1 << 20
SUMS = "i int, j int, value string"
WHITE = "struct<deviation: bigint, whitened: array<double>>"


def on_grid(vector: Column) -> Column:
    """Entries as whole numbers floor(64 * c) + 1000000, 64 * c up to 2 ** 40 either way; null for a null vector or one with a null or non-finite entry."""
    double = vector.cast("array<double>")
    bad = F.exists(double, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(double, lambda c: F.floor(F.greatest(F.lit(-float(OUTERMOST)), F.least(F.lit(float(OUTERMOST)), c * SCALE))) + SHIFT))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten(), np.int64).reshape(-1, size)


def _blocks(y: np.ndarray) -> Iterator[np.ndarray]:
    """Sums of products of the columns of ``y``, exact, as matrices of whole numbers."""
    small = np.abs(y).max(axis=1) < EXACT if len(y) else np.zeros(0, bool)
    for k in range(0, int(small.sum()), ROWS):
        part = y[small][k : k + ROWS].astype(np.float64)
        yield (part.T @ part).astype(np.int64).astype(object)
    if (~small).any():  # entries far away from the mean: whole numbers of any size
        far = y[~small].astype(object)
        yield far.T @ far


def grid_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows of fit(x) and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            n += len(x)
            total += (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & 0xFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([*range(size), -1], pa.int32()), pa.array([0] * (size + 1), pa.int32()), pa.array([*map(str, total.tolist()), str(n)])], ["i", "j", "value"])

    rows = fit.mapInArrow(run, SUMS).groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.i: int(r.v) for r in rows}
    return found.get(-1, 0), [found.get(k, 0) for k in range(size)]


def _products(fit: DataFrame, size: int, centre: list[int]) -> list[list[int]]:
    """Exact sums of products of fit(x) less a whole number per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            for block in _blocks(_matrix(batch.column(0), size) - np.array(centre, np.int64)):
                total = total + block
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([*map(str, total[i, j].tolist())])], ["i", "j", "value"])

    cells = fit.mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
    out = [[0] * size for _ in range(size)]
    for c in cells:
        out[c.i][c.j] = out[c.j][c.i] = int(c.v)
    return out


def covariance(fit: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of fit(x), divisor n: exact but for the last rounding.

    Values are centred by their rounded mean before they are multiplied; what is left
    of the mean, half a unit at most, is taken out of the exact sums.
    """
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = _products(fit, size, centre)
    return np.array([[float(Fraction(n * products[i][j] - rest[i] * rest[j], n * n)) for j in range(size)] for i in range(size)])


def whitened(x: Column, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> Column:
    """Struct of the exact squared deviation sum((n * x - S) ** 2) and the whitened components."""
    size = len(sums)

    @F.arrow_udf(WHITE)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        whole = [s // n for s in sums]
        left = np.array([float(Fraction(s - n * w, n)) for s, w in zip(sums, whole)])
        rest = np.array([s - n * w for s, w in zip(sums, whole)], object)
        for column in columns:
            y = _matrix(column, size) - np.array(whole, np.int64)
            far = int(np.abs(y).max(initial=0)) + 1
            # n * x - S = n * y - rest, in 64 bits where they hold it.
            if (n * far) ** 2 * size < 1 << 63:
                d = n * y - rest.astype(np.int64)
                deviation = (d * d).sum(axis=1)
            else:
                d = y.astype(object) * n - rest
                deviation = (d * d).sum(axis=1)
            scores = (y - left) @ vectors / np.sqrt(values)
            bounds = pa.array(np.arange(len(y) + 1) * len(values), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(scores.ravel(), pa.float64()))
            fits = [int(v) if v < 1 << 63 else None for v in deviation.tolist()]
            yield pa.StructArray.from_arrays([pa.array(fits, pa.int64()), lists], ["deviation", "whitened"])

    return run(x)


def identity_error(fit: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray) -> float:
    """Largest absolute entry of the covariance of whitened fit(x) less the identity, from the whitened values themselves."""
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([float(Fraction(s, n)) for s in sums])
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = (_matrix(batch.column(0), len(sums)) - mean) @ vectors / np.sqrt(values)
            total += z.sum(axis=0)
            square += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], ["total", "square"])

    # One row a task; each cell is added up by Spark, in the order of the values.
    rows = fit.mapInArrow(run, "total array<double>, square array<double>")
    cells = rows.select(F.posexplode(F.concat("total", "square")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = np.zeros(k + k * k)
    for c in cells:
        found[c.i] = c.v
    mean = found[:k] / n
    # The mean of whitened values is zero but for rounding, so they are centred already; what is left goes here.
    return float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, vector: str = "embedding", leading: int = 16) -> DataFrame:
    """``rows`` without ``vector``, one row for each of up to ``leading`` principal components.

    Adds component (from 1, by falling variance), n (distinct grid vectors, on which all
    is fitted), deviation (exact sum of squares of n * x - S; null if no 64 bits hold
    it), whitened, explained (part of the total variance) and identity_error (one value
    for all).  Columns of these names are replaced.  Rows whose vector is null, empty or
    holds a null or non-finite entry are dropped; so are those of another length than
    most have (ties: the longer), as no sum with them exists.  Repeated rows each get
    their results but count once in the fit.  Components that rounding cannot tell from no variance
    are left out, so a table whose rows are all equal has no rows, as an empty one.
    """
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    others = [c for c in rows.columns if c not in (vector, *names)]
    grid = rows.select(*others, on_grid(F.col(vector)).alias("_x")).where(F.size("_x") > 0)
    lengths = grid.groupBy(F.size("_x").alias("l")).agg(F.count("*").alias("k")).agg(F.max_by("l", F.struct("k", "l")).alias("l")).first()
    size = lengths["l"] or 1
    if size > MOST:
        raise ValueError(f"{size} dimensions are more than {MOST}")
    grid = grid.where(F.size("_x") == size)
    fit = stored(grid.select(F.col("_x").alias("x")).distinct(), "fit")
    n, sums = grid_sums(fit, size)
    matrix = covariance(fit, size, n, sums) if n else np.zeros((size, size))
    values, vectors = leading_pairs(matrix, leading)
    error = identity_error(fit, n, sums, vectors, values) if len(values) else 0.0
    dropped(fit)
    trace = float(np.trace(matrix))
    parts = F.array(*(F.lit(float(v / trace)) for v in values)).cast("array<double>")
    white = grid.select(*others, whitened(F.col("_x"), n, sums, vectors, values).alias("_w")) if len(values) else grid.select(*others, F.lit(None).cast(WHITE).alias("_w"))
    long = white.select(*others, F.col("_w.deviation").alias("deviation"), F.posexplode("_w.whitened").alias("_k", "whitened"))
    return long.select(*others, (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(parts, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error"))
