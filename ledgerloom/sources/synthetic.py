"""Random tables and samples for regression, made by the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ml.regression import pred_linear


def random_table(spark: SparkSession, rows: int, columns: Sequence[str], seed: int) -> DataFrame:
    """An ordinal and columns of random 64-bit numbers."""
    return spark.range(rows).select("id", *(F.xxhash64("id", F.lit(seed), F.lit(c)).alias(c) for c in columns))


def constants(spark: SparkSession, rows: int, value: int, name: str = "value") -> DataFrame:
    return spark.range(rows).select("id", F.lit(value).cast("bigint").alias(name))


def linear_model(features: int, seed: int) -> list[float]:
    """Weights: whole numbers below 10 for the first ten features, 0 for others."""
    import random

    draw = random.Random(seed)
    return [float(draw.randrange(10)) if j < 10 else 0.0 for j in range(features)]


def _samples(spark: SparkSession, rows: int, w: Sequence[float], mean: float, spread: float, seed: int) -> DataFrame:
    normal = lambda k: F.randn(seed * 10_007 + k) * spread + mean
    x = F.array(*(normal(j) for j in range(len(w))))
    return spark.range(rows).select("id", x.alias("x"), normal(len(w)).alias("noise"))


def linear_samples(spark: SparkSession, rows: int, w: Sequence[float], *, mean: float = 0.0, spread: float = 1.0, seed: int = 1) -> DataFrame:
    """id, x (N(mean, spread) features) and y = x.w + noise. Use other seeds for training and test."""
    return _samples(spark, rows, w, mean, spread, seed).select("id", "x", (pred_linear("x", w) + F.col("noise")).alias("y"))


def logistic_samples(spark: SparkSession, rows: int, w: Sequence[float], *, mean: float = 0.0, spread: float = 1.0, seed: int = 1) -> DataFrame:
    """id, x and y = 1 where x.w + noise is positive."""
    return _samples(spark, rows, w, mean, spread, seed).select("id", "x", (pred_linear("x", w) + F.col("noise") > 0).cast("double").alias("y"))
