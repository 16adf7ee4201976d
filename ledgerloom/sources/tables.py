"""Tables in and results out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import zero_of


def int_type(bits: int) -> T.DataType:
    """The column type for signed numbers of so many bits: a flag, a long, a decimal, or bytes."""
    if bits < 1:
        raise ValueError("a number has 1 bit or more")
    return T.BooleanType() if bits == 1 else T.LongType() if bits <= 64 else T.DecimalType(38, 0) if bits <= 126 else T.BinaryType()


def string_type(bits: int) -> T.DataType:
    """The column type for texts of a fixed width; it must be whole bytes."""
    if bits % 8:
        raise ValueError("the width of a text is a multiple of 8 bits")
    return T.StringType()


def check_width(df: DataFrame, column: str, bits: int) -> DataFrame:
    """df, or an error if a text has another width."""
    if df.where(F.octet_length(column) * 8 != bits).limit(1).count():
        raise ValueError(f"{column} holds texts that are not {bits} bits wide")
    return df


def from_rows(spark: SparkSession, rows: Iterable[Sequence], columns: Sequence[tuple[str, str, int]]) -> DataFrame:
    """A table of given rows; columns are (name, "int" or "string", bits)."""
    schema = T.StructType([T.StructField(n, int_type(b) if k == "int" else string_type(b)) for n, k, b in columns])
    put = {T.DecimalType: Decimal, T.BinaryType: lambda v: v if isinstance(v, bytes) else v.to_bytes(-(-max(v.bit_length() + 1, 1) // 8), "big", signed=True)}
    made = [put.get(type(f.dataType), lambda v: v) for f in schema]
    return spark.createDataFrame([tuple(v if v is None else m(v) for m, v in zip(made, r)) for r in rows], schema)


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only `columns` are scanned."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def column(df: DataFrame, name: str | int):
    """A column by name (the first that matches) or place; KeyError if there is none."""
    if isinstance(name, int):
        return df[df.columns[name]]
    if name not in df.columns:
        raise KeyError(name)
    return df[name]


def masked(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """Rows without the flag read as zero in the given columns, so that they tell nothing."""
    return df.select(*(F.when(F.col(flag), F.col(c)).otherwise(zero_of(df.schema[c].dataType)).alias(c) if c in columns else F.col(c) for c in df.columns))


def in_random_order(df: DataFrame, seed: int) -> DataFrame:
    """df sorted by a random key: ranges of it are files, so neither files nor rows keep the input's order."""
    return df.orderBy(F.rand(seed))


def reveal(df: DataFrame, path: str, *, seed: int | None = None) -> None:
    """Writes the result as Parquet; with a seed, in an order that tells nothing of the input's."""
    (df if seed is None else in_random_order(df, seed)).write.parquet(path)
