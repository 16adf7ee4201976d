"""Linear and logistic regression by mini-batch gradient descent, prediction, metrics.

A step over a large batch is one job: tasks add up their rows' parts of the gradient with numpy, and
a row for each task reaches the driver. Small batches come to the driver in order, as many at a
time as a parameter allows, as a job for each would cost more than the step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import piecewise as P
from ..functions.scalar import _c
from ..operators.agg import accuracy, argmax, mean_squared_error
from ..operators.order import permutation


def weights(w: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in w))


def dot(a, b) -> Column:
    """Dot product of two arrays of doubles."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pred_linear(x, w: Sequence[float]) -> Column:
    return dot(x, weights(w))


def pred_logistic(x, w: Sequence[float]) -> Column:
    """1 where x.w is positive."""
    return (dot(x, weights(w)) > 0).cast("int")


def layer(x, matrix: Sequence[Sequence[float]]) -> Column:
    """x times a matrix of one row per feature, as an array of its columns."""
    return F.array(*(dot(x, weights(col)) for col in zip(*matrix)))


def pred_neural(x, layers: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Layers with max(0, .) between them; the index of the largest output, the first of ties."""
    out = _c(x)
    for i, m in enumerate(layers):
        out = layer(out, m)
        if i < len(layers) - 1:
            out = F.transform(out, lambda v: F.greatest(v, F.lit(0.0)))
    return argmax(out)


#: Numbers (rows times features) of the batches that the driver takes at a time.
LOCAL_CELLS = 1 << 22


def _identity(z: np.ndarray) -> np.ndarray:
    return z


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _logistic_pw(z: np.ndarray) -> np.ndarray:
    return np.clip(z + 0.5, 0, 1)


def _matrix(table: pa.Table | pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (a row per row) and targets of columns x and y."""
    x, y = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("x"), table.column("y")))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(table), d), y.to_numpy(zero_copy_only=False)


def _gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, activation: Callable) -> np.ndarray:
    return x.T @ (activation(x @ w) - y)


def _descend(df: DataFrame, features: str, target: str, activation: Callable[[np.ndarray], np.ndarray], w: Sequence[float], *, batch: int, rate: float, iterations: int, ordinal: str, seed: int, local_cells: int) -> list[float]:
    n, d = df.count(), len(w)
    if not 0 < batch <= n:
        raise ValueError("a batch has 1 to all rows")
    step = 2.0 ** -math.floor(math.log2(batch / rate))
    w, each, taken = np.array(w, float), max(1, n // batch), max(1, local_cells // (batch * d))
    small = batch * d <= local_cells
    rows = df.select(ordinal, F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    rows = rows.withColumn("_batch", F.lit(0)).persist() if each == 1 else rows
    for begin in range(0, iterations, each):  # all batches of a pass come from one permutation
        drawn = permutation(rows, ordinal, seed + begin // each, "_pi").withColumn("_batch", F.floor(F.col("_pi") / batch)).persist() if each > 1 else rows
        turns = min(each, iterations - begin)
        for k in range(0, turns, taken if small else 1):
            if small:
                some = drawn.where((F.col("_batch") >= k) & (F.col("_batch") < min(turns, k + taken))).select("_batch", "x", "y").toArrow().sort_by("_batch")
                (x, y), own = _matrix(some, d), some.column("_batch").to_numpy()
                ends = np.searchsorted(own, np.arange(k, min(turns, k + taken) + 1))
                for a, b in zip(ends, ends[1:]):
                    w = w - step * _gradient(x[a:b], y[a:b], w, activation)
            else:
                now = w

                def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    total = np.zeros(d)
                    for own in batches:
                        total += _gradient(*_matrix(own, d), now, activation)
                    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["g"])

                parts = drawn.where(F.col("_batch") == k).select("x", "y").mapInArrow(part, "g array<double>").collect()
                w = w - step * np.sum([r["g"] for r in parts], axis=0)
        if each > 1:
            drawn.unpersist()
    rows.unpersist()
    return w.tolist()


def sgd_linear(df: DataFrame, features: str, target: str, w: Sequence[float], *, batch: int, rate: float, iterations: int, ordinal: str, seed: int = 1, local_cells: int = LOCAL_CELLS) -> list[float]:
    """w -= 2^-floor(log2(batch / rate)) X'(Xw - y) for each batch."""
    return _descend(df, features, target, _identity, w, batch=batch, rate=rate, iterations=iterations, ordinal=ordinal, seed=seed, local_cells=local_cells)


def sgd_logistic(df: DataFrame, features: str, target: str, w: Sequence[float], *, batch: int, rate: float, iterations: int, ordinal: str, seed: int = 1, exact: bool = True, local_cells: int = LOCAL_CELLS) -> list[float]:
    """The same for the logistic function of Xw: exact, or its piecewise linear stand-in."""
    return _descend(df, features, target, _sigmoid if exact else _logistic_pw, w, batch=batch, rate=rate, iterations=iterations, ordinal=ordinal, seed=seed, local_cells=local_cells)


def test_linear(df: DataFrame, features: str, target: str, w: Sequence[float]) -> float:
    """Mean squared error."""
    return df.agg(mean_squared_error(pred_linear(features, w), target).alias("e")).first()["e"]


def test_logistic(df: DataFrame, features: str, target: str, w: Sequence[float], exact: bool = True) -> float:
    """Share of rows predicted right."""
    f = P.sigmoid if exact else P.logistic_pw
    return df.agg(accuracy(f(pred_linear(features, w)), target).alias("a")).first()["a"]


test_linear.__test__ = test_logistic.__test__ = False  # not tests of ours


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of matrices held as rows (i, j, v): join on the inner index, then add up."""
    x = a.select(F.col("i"), F.col("j").alias("_k"), F.col("v").alias("_x"))
    y = b.select(F.col("i").alias("_k"), F.col("j"), F.col("v").alias("_y"))
    return x.join(y, "_k").groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_y")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row(a: DataFrame, i: int) -> DataFrame:
    return a.where(F.col("i") == i).select("j", "v")


def column(a: DataFrame, j: int) -> DataFrame:
    return a.where(F.col("j") == j).select("i", "v")


def same_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether all entries are equal."""
    both = a.select("i", "j", F.col("v").alias("_x")).join(b.select("i", "j", F.col("v").alias("_y")), ["i", "j"], "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("_x") == F.col("_y"), F.lit(False))), F.lit(True)).alias("same"))
