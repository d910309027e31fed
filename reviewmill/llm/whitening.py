"""Whitening of embeddings in two passes: exact integer sums give the mean, then centred outer products the covariance.

Entries count as whole numbers, x = floor(SCALE * c) + SHIFT, so that sums are exact and don't depend on their order.
A task multiplies its centred rows by NumPy (one product a batch), treeAggregate() merges the tasks' matrices, and
the driver gets one matrix, of the square of the dimension, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

SCALE, SHIFT = 1024, 100_000
#: Whole numbers beyond this aren't all doubles: an entry that is counts as not finite.
LARGEST = 2**53

Batches = Iterator[pa.RecordBatch]


@dataclass
class Whitening:
    """n vectors with per-dimension sums; falling eigenvalues of their covariance with a row of axes each; its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def spread(self) -> np.ndarray:
        """Which components have variance, rounding aside."""
        return self.values > self.values.max(initial=0.0) * len(self.sums) * np.finfo(float).eps

    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]


def whole_numbers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and their entries as whole numbers: those of dims entries, all of them finite."""
    fits = pc.equal(pc.list_value_length(column), dims).fill_null(False)
    some = column.filter(fits)
    entries = some.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(some), dims)  # a null is NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * entries)
        finite = (np.abs(x) < LARGEST).all(axis=1)
    take = fits.to_numpy(zero_copy_only=False).astype(bool)
    take[take] = finite
    return take, x[finite].astype(np.int64) + SHIFT


def _exact(x: np.ndarray, n: int) -> np.ndarray:
    """x as Python's whole numbers if n times its entries leave 64 bits."""
    return x if int(np.abs(x).max(initial=0)) * n < 2**62 else x.astype(object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact."""
    x = _exact(x, 2 * n)
    return x * n - np.array(sums, x.dtype)


def squares(y: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    top = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if top * top * y.shape[1] < 2**63:
        return (y * y).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in y.tolist()]


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest number of entries, of equal ones the largest; 0 if no vector has any."""
    sizes = vectors.select(F.size(column).alias("d")).filter("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return first.d if first else 0


def exact_sums(vectors: DataFrame, column: str, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sums of their whole numbers, a row a task and dimension merged by Spark."""

    def run(batches: Batches) -> Batches:
        n, total = 0, [0] * dims
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, _exact(x, len(x) + 1).sum(axis=0))]
        decimals = pa.array([[Decimal(v) for v in total]], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), decimals], ["n", "sums"])

    parts = vectors.select(column).mapInArrow(run, "n long, sums array<decimal(38,0)>").filter("n > 0").select("n", F.posexplode("sums"))
    rows = {r.pos: r for r in parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()}
    return (rows[0].n, [int(rows[i].total) for i in range(dims)]) if rows else (0, [0] * dims)


def added(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the tasks' arrays (one column of their bytes), merged in a tree."""
    arrays = parts.rdd.map(lambda r: np.frombuffer(r[0], np.float64).reshape(shape))
    return arrays.treeAggregate(np.zeros(shape), np.add, np.add)


def _summed(vectors: DataFrame, value: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of value(batch) over all batches."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(shape)
        for batch in batches:
            total += value(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return added(vectors.mapInArrow(run, "part binary"), shape)


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening:
    """Mean and principal axes of the vectors in column (array of numbers).

    A vector takes no part if it is null, has a null or non-finite entry, or isn't of the commonest length. Axes are unit
    vectors whose largest entry is positive; there are never more of them than dimensions. A table without vectors gives none.
    """
    ship(vectors.sparkSession)
    dims = dimension(vectors, column)
    n, sums = exact_sums(vectors, column, dims) if dims else (0, [])
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(whole_numbers(batch.column(0), dims)[1], n, sums).astype(np.float64) / n
        return y.T @ y

    covariance = _summed(vectors.select(column), products, (dims, dims)) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes.T[::-1][:components]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Whitening(n, sums, values, axes, float(np.trace(covariance)))


def project(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Each vector that counts: key, deviation (decimal, exact; null beyond 38 digits), whitened (array, a component each).

    A component without variance has a null. Rows of null or repeated keys stay as they are.
    """
    spark = vectors.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        m: Whitening = known.value
        spread, dims = m.spread, len(m.sums)
        scaled = np.where(spread[:, None], m.axes, 0) / np.sqrt(np.where(spread, m.values, 1))[:, None]
        for batch in batches:
            take, x = whole_numbers(batch.column(1), dims)
            y = centred(x, m.n, m.sums)
            white = (y.astype(np.float64) / m.n) @ scaled.T
            nulls = np.broadcast_to(~spread, white.shape)
            flat = pa.array(white.ravel(), mask=nulls.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(spread)), flat)
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in squares(y)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(take)), exact, lists], [key, "deviation", "whitened"])

    kind = vectors.schema[key].dataType.simpleString()
    if not model.n:
        return spark.createDataFrame([], f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")
    return vectors.select(key, column).mapInArrow(run, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """Largest entry by which the covariance of the whitened vectors misses the identity, over components with variance."""
    spread = model.spread
    k = len(spread)
    if not spread.any():
        return 0.0
    rows = projected.select("whitened")
    values = lambda batch: batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[:, spread]
    used = int(spread.sum())
    mean = _summed(rows, lambda b: values(b).sum(axis=0), (used,)) / model.n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = values(batch) - mean
        return z.T @ z

    return float(np.abs(_summed(rows, products, (used, used)) / model.n - np.eye(used)).max())


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    deviation: sum over dimensions of (n * x - S)^2. explained: the component's share of all variance, 0 if there is none.
    An empty table, or one without a vector that counts, gives an empty one; other columns are not read.
    """
    model = fit(vectors, column, components)
    rows = materialise(project(vectors, model, key, column), "whitened")
    shares = F.array(*[F.lit(v) for v in model.explained()]) if model.n else F.array().cast("array<double>")
    return rows.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(identity_error(rows, model)).alias("identity_error"),
    )
