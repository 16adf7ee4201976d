"""Set operations on tables by key. Union columns must agree in number and type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins


def _checked(left: DataFrame, right: DataFrame) -> None:
    a, b = ([f.dataType for f in df.schema] for df in (left, right))
    if a != b:
        raise ValueError(f"union columns differ: {a} and {b}")


def right_union(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """All right rows, then the left rows whose key the right has not; names come from the left."""
    a = joins.anti(left, right, left_key, right_key).select(*left_columns)
    b = right.select(*right_columns)
    _checked(a, b)
    return b.toDF(*left_columns).unionByName(a)


def left_union(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_columns: Sequence[str], right_columns: Sequence[str]) -> DataFrame:
    """All left rows, then the right rows whose key the left has not; names come from the left."""
    a = left.select(*left_columns)
    b = joins.anti(right, left, right_key, left_key).select(*right_columns)
    _checked(a, b)
    return a.unionByName(b.toDF(*left_columns))


def minus(left: DataFrame, right: DataFrame, left_key: joins.Keys, right_key: joins.Keys) -> DataFrame:
    """Left rows whose key the right has not."""
    return joins.anti(left, right, left_key, right_key)


def union_many(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of tables with the same columns; of a key that several have, the first table's rows.

    One aggregate in place of a chain of joins: the first table that has a key is found
    for all keys at once, whatever the number of tables.
    """
    for t in tables[1:]:
        _checked(tables[0], t)
    names = tables[0].columns
    rows = None
    for i, t in enumerate(tables):
        own = t.toDF(*names).withColumn("_from", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy(key).agg(F.min("_from").alias("_first")).withColumnRenamed(key, "_key")
    return rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).where("_from = _first").select(*names)


def at_least_k(tables: Sequence[DataFrame], key: str, k: int, count: str = "n_sources") -> DataFrame:
    """Keys that occur in k tables or more, and in how many. Null keys count for nothing.

    Each table is a bit, so that one aggregate, which tasks begin before the shuffle, tells
    the number of tables for each key; 63 tables make a word.
    """
    rows, words = None, -(-len(tables) // 63)
    for i, t in enumerate(tables):
        bits = [F.lit(1 << i % 63 if i // 63 == w else 0).cast("long").alias(f"_bit{w}") for w in range(words)]
        own = t.select(F.col(key).alias(key), *bits).where(F.col(key).isNotNull())
        rows = own if rows is None else rows.unionByName(own)
    found = rows.groupBy(key).agg(*(F.bit_or(f"_bit{w}").alias(f"_bit{w}") for w in range(words)))
    number = F.bit_count("_bit0").cast("long")
    for w in range(1, words):
        number = number + F.bit_count(f"_bit{w}")
    return found.select(key, number.alias(count)).where(F.col(count) >= k)


def sources_per_key(rows: DataFrame, key: str, source: str, count: str = "n_sources") -> DataFrame:
    """In how many sources each key occurs; each pair counts once."""
    return rows.select(key, source).distinct().groupBy(key).agg(F.count("*").alias(count))
