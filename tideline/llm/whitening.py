"""Embedding whitening by hierarchical merging of singular value decompositions.

Entries become whole numbers, so counts, sums and deviations are exact. Each partition centres its rows on their own
mean, in whole numbers before the division, and keeps (rows, sums, singular values, right vectors), at full rank: a
factor F of at most ``dim`` rows with F'F = the scatter about the mean. Two such states merge into one by stacking both
factors and one further row, sqrt(n m / (n + m)) times the difference of the means, and decomposing the stack again;
this loses nothing, as no dimension is cut. Within a partition batches merge so as they come; partitions merge over
levels of ``FAN`` to one, so no task holds more than one state and a batch. The last state is one row of dim * dim
numbers: the singular values give the variances, the vectors the components.

A component's sign is that which makes its largest entry positive. The whitened values' own covariance is then measured
over all rows in the same way, centred on its own mean: ``identity_error``.

Defined results: rows whose vector is null or holds null or non-finite entries take no part, nor do those whose length
is not the commonest (of equally common ones the smallest); repeated rows count each; a null id stays null; entries
beyond ``WIDEST`` count as that, so that sums stay whole numbers; a deviation that no long can hold is null; components
whose singular value is not over ``SMALLEST`` of the largest have no variance and are left out, so one row alone, or
equal rows, give no components; an empty table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import partitions, spark_arrow

COMPONENTS, SCALE, OFFSET, SMALLEST, FAN = 32, 64, 1_000_000, 1e-10, 32
#: Entries are cut off at +-WIDEST before scaling; rows that a state takes in at a time.
WIDEST, BATCH = float(1 << 40), 4096
#: A state as a row; sums are whole numbers of any size, or doubles, as texts.
STATE = "n long, sums array<string>, factor array<double>"


def finite(vector: str) -> Column:
    """True where the vector has entries and all are finite numbers."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64()), np.float64).reshape(len(column), dim)


def whole(x: np.ndarray) -> np.ndarray:
    """The whole numbers of entries."""
    return np.floor(SCALE * np.clip(x, -WIDEST, WIDEST)).astype(np.int64) + OFFSET


def times_minus(n: int, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in longs where these hold it, else in whole numbers of any size."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max((abs(int(s)) for s in sums), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)[None, :]
    return n * x.astype(object) - sums[None, :]


def factor_of(stack: np.ndarray) -> np.ndarray:
    """The stack's singular values times right vectors: at most as many rows as columns, with the same scatter."""
    _, values, rows = np.linalg.svd(stack, full_matrices=False)
    return values[:, None] * rows


@dataclass
class Scatter:
    """Rows of whole numbers: their count, exact sums (Python numbers), and a factor of their scatter about the mean."""

    n: int
    sums: np.ndarray
    factor: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Scatter:
        sums = x.sum(0).astype(object)
        return Scatter(len(x), sums, factor_of((times_minus(len(x), x, sums) / len(x)).astype(np.float64)))

    def merged(self, other: Scatter) -> Scatter:
        n, m = self.n, other.n
        apart = np.array([float(a * m - b * n) for a, b in zip(self.sums, other.sums, strict=True)]) / (float(n) * m)  # whole numbers before the division
        return Scatter(n + m, self.sums + other.sums, factor_of(np.concatenate([self.factor, other.factor, (np.sqrt(float(n) * m / (n + m)) * apart)[None, :]])))

    def cells(self) -> tuple[int, list[str], list[float]]:
        return self.n, [str(v) for v in self.sums], self.factor.ravel().tolist()

    @staticmethod
    def read(n: int, sums: list[str], factor: list[float]) -> Scatter:
        return Scatter(n, np.array([int(v) for v in sums], object), np.array(factor).reshape(-1, len(sums)))


@dataclass
class Moments:
    """Rows of doubles: their count, mean, and products about the mean."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        mean = z.mean(0)
        return Moments(len(z), mean, (z - mean).T @ (z - mean))

    def merged(self, other: Moments) -> Moments:
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.products + other.products + np.outer(d, d) * (self.n * (other.n / n)))

    def cells(self) -> tuple[int, list[str], list[float]]:
        return self.n, [repr(float(v)) for v in self.mean], self.products.ravel().tolist()

    @staticmethod
    def read(n: int, mean: list[str], products: list[float]) -> Moments:
        return Moments(n, np.array([float(v) for v in mean]), np.array(products).reshape(len(mean), -1))


def hierarchy(vectors: DataFrame, dim: int, kind: type, prepare: Callable[[np.ndarray], np.ndarray]) -> Any:
    """The one state of all rows of a column of vectors, each batch prepared first; None without rows."""
    target = spark_arrow(vectors.sparkSession, STATE)

    def row(state: Any) -> Iterator[pa.RecordBatch]:
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(state.cells(), target, strict=True)], schema=target)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for at in range(0, len(b), BATCH):
                one = kind.of(prepare(matrix(b.column(0).slice(at, BATCH), dim)))
                held = one if held is None else held.merged(one)
        yield from row(held)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[Any]:
        for b in batches:
            for k in range(len(b)):
                yield kind.read(*(b.column(j)[k].as_py() for j in range(3)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for one in read(batches):
            held = one if held is None else held.merged(one)
        yield from row(held)

    states, width = vectors.mapInArrow(build, STATE), partitions(vectors.sparkSession)
    while width > 1:
        width = -(-width // FAN)
        states = states.repartition(width).mapInArrow(merge, STATE)
    return next(read(states.toArrow().to_batches()), None)  # one row


@dataclass
class Whitening:
    """Rows and exact sums of the fit, variances and unit components, largest first, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.variances / self.trace).tolist()

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - sums, whitened values) of whole rows."""
        apart = times_minus(self.n, x, self.sums)
        return apart, (apart / self.n).astype(np.float64) @ self.axes.T / np.sqrt(self.variances)


def vectors_of(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their length; 0 without any."""
    taken = rows.filter(finite(vector)).select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    commonest = taken.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (taken.filter(F.size("v") == commonest["d"]), int(commonest["d"])) if commonest else (taken, 0)


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """Fits on the column ``v`` of every row; None where no component has variance."""
    state = hierarchy(vectors.select("v"), dim, Scatter, whole) if dim else None
    if state is None:
        return None
    _, values, axes = np.linalg.svd(state.factor, full_matrices=False)
    trace = float((values * values).sum()) / state.n
    kept = int((values > SMALLEST * values[0]).sum()) if values[0] > 0 else 0
    kept = min(components, kept)
    if not kept:
        return None
    axes = axes[:kept]
    axes = axes * np.sign(axes[np.arange(kept), np.abs(axes).argmax(1)])[:, None]
    return Whitening(state.n, state.sums, values[:kept] ** 2 / state.n, axes, trace)


def identity_error(vectors: DataFrame, dim: int, model: Whitening) -> float:
    """The largest entry of the whitened values' covariance less the identity, over every row of ``v``."""
    found = hierarchy(vectors.select("v"), dim, Moments, lambda v: model.parts(whole(v))[1])
    return float(np.abs(found.products / found.n - np.eye(len(found.mean))).max())


def whiten(vectors: DataFrame, dim: int, model: Whitening) -> DataFrame:
    """id, deviation (of all entries from their sums, exact) and the whitened values of every row."""
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"
    target = spark_arrow(vectors.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.slice(at, BATCH)
                apart, z = model.parts(whole(matrix(part.column(1), dim)))
                if apart.dtype == object or dim * float(np.abs(apart).max(initial=0)) ** 2 >= 2.0**62:
                    apart = apart.astype(object)
                squares = [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(1)]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(squares, pa.int64()), values.cast(target.field(2).type)], schema=target)

    return vectors.select("id", "v").mapInArrow(work, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors, dim = vectors_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    model = fit(vectors, dim)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whiten(vectors, dim, model).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, model.explained))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(identity_error(vectors, dim, model)).alias("identity_error"))
