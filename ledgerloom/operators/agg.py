"""Aggregates of whole columns. Spark adds up within each task first, so only partial results move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import _WIDE, _c, wrap
from . import joins


def _wide_sum(x: Column) -> Column:
    return F.sum(x.cast(_WIDE))


def total(x) -> Column:
    """Sum modulo 2^64."""
    return wrap(F.coalesce(_wide_sum(_c(x)), F.lit(0).cast(_WIDE)))


def aggregate(df: DataFrame, column: str, func: str, name: str = "value") -> DataFrame:
    """ADD (modulo 2^64), OR, AND (bitwise, or logical for flags), MIN, MAX over all rows."""
    flag = df.schema[column].dataType.typeName() == "boolean"
    c = F.col(column)
    kinds = {
        "ADD": lambda: total(c.cast("bigint") if flag else c),
        "OR": lambda: F.bool_or(c) if flag else F.bit_or(c),
        "AND": lambda: F.bool_and(c) if flag else F.bit_and(c),
        "MIN": lambda: F.min(c),
        "MAX": lambda: F.max(c),
    }
    if func not in kinds:
        raise ValueError(f"no such aggregate: {func}")
    return df.agg(kinds[func]().alias(name))


def xor_dot(a, b) -> Column:
    """XOR over all rows of a AND b."""
    return F.bit_xor(_c(a).bitwiseAND(_c(b)))


def block_select(flag, x) -> Column:
    """XOR of the x whose flag is set (grouped by the place within a block: x of the chosen block)."""
    return F.bit_xor(F.when(_c(flag), _c(x)).otherwise(F.lit(0).cast("bigint")))


def cardinality(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "n") -> DataFrame:
    """How many different keys both sides hold."""
    return joins.semi(left.select(left_key), right, left_key, right_key).distinct().agg(F.count("*").alias(name))


def flagged_count(flag) -> Column:
    return F.count(F.when(_c(flag), True))


def flagged_sum(flag, x) -> Column:
    """Sum of x where the flag is set, modulo 2^64."""
    return total(F.when(_c(flag), _c(x)))


def flagged_min(flag, x) -> Column:
    return F.min(F.when(_c(flag), _c(x)))


def flagged_max(flag, x) -> Column:
    return F.max(F.when(_c(flag), _c(x)))


def argmax(array) -> Column:
    """Index of an array's largest entry; the first one of ties."""
    a = _c(array)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def mean_squared_error(predicted, actual) -> Column:
    return F.avg(F.pow(_c(predicted) - _c(actual), F.lit(2)))


def accuracy(predicted, actual) -> Column:
    """Share of rows where both lie on the same side of 1/2."""
    return F.avg(((_c(predicted) > 0.5) == (_c(actual) > 0.5)).cast("double"))
