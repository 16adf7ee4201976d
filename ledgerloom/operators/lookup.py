"""Reads by index: an equi-join of requests with the table, or an array's entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import _c
from . import joins


def access(table: DataFrame, index: str, requests: DataFrame, request: str) -> DataFrame:
    """A row per request: the request and the columns of the row at that index (null if there is none)."""
    joins.check_unique(table, index)
    own = table.select(F.col(index).alias("_i"), *(c for c in table.columns if c != index))
    asked = requests.select(F.col(request).alias(request))
    return asked.join(own, asked[request] == own["_i"], "left").drop("_i")


def position_map(positions: DataFrame, index: str, position: str, requests: DataFrame, request: str) -> DataFrame:
    """A row per request: its physical position."""
    return access(positions.select(index, position), index, requests, request)


def linear(array, index) -> Column:
    """Entry `index` (from 0) of an array; null outside it."""
    return F.get(_c(array), _c(index).cast("int"))
