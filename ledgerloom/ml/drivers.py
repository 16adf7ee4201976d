"""Whole experiments: sample a model, train on its samples, test on others."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import synthetic
from . import regression as R


def linear(spark: SparkSession, *, rows: int = 10_000, features: int = 1_000, batch: int = 128, iterations: int = 10_000, test_rows: int = 1_000, rate: float = 2**-10, mean: float = 0.0, spread: float = 1.0, seed: int = 1) -> dict:
    """Weights and mean squared error of a linear regression. Training and test use different seeds."""
    w = synthetic.linear_model(features, seed)
    train = synthetic.linear_samples(spark, rows, w, mean=mean, spread=spread, seed=seed + 1).persist()
    got = R.sgd_linear(train, "x", "y", [0.0] * features, batch=batch, rate=rate, iterations=iterations, ordinal="id", seed=seed)
    train.unpersist()
    test = synthetic.linear_samples(spark, test_rows, w, mean=mean, spread=spread, seed=seed + 2)
    return {"model": w, "weights": got, "error": R.test_linear(test, "x", "y", got)}


def logistic(spark: SparkSession, *, rows: int = 10_000, features: int = 1_000, batch: int = 128, iterations: int = 10_000, test_rows: int = 1_000, rate: float = 2**-3, mean: float = 0.0, spread: float = 1.0, seed: int = 1, exact: bool = True) -> dict:
    """Weights and accuracy of a logistic regression, by the exact function or its linear stand-in."""
    w = synthetic.linear_model(features, seed)
    train = synthetic.logistic_samples(spark, rows, w, mean=mean, spread=spread, seed=seed + 1).persist()
    got = R.sgd_logistic(train, "x", "y", [0.0] * features, batch=batch, rate=rate, iterations=iterations, ordinal="id", seed=seed, exact=exact)
    train.unpersist()
    test = synthetic.logistic_samples(spark, test_rows, w, mean=mean, spread=spread, seed=seed + 2)
    return {"model": w, "weights": got, "accuracy": R.test_logistic(test, "x", "y", got, exact)}
