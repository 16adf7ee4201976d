"""Sum-product networks from text: a line per node, `key=value` fields parted by blanks.

id, type (Sum, Product, IdentityNumericLeaf, Categorical), children (parted by |), weights
(parted by commas or |), scope, buckets, bin_values, and bin_bitmaps (buckets parted by ;,
their ids by |) or the same in hexadecimal, 16 digits for 64 ids, after `hex:` or `0x`.
Lines without an id are headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _list(text: Column, kind: str) -> Column:
    parts = F.split(text, r"[|,]")
    return F.when(text.isNull() | (text == ""), F.array().cast(f"array<{kind}>")).otherwise(F.transform(parts, lambda x: F.trim(x).cast(kind)))


def _ids(text: Column) -> Column:
    buckets = F.split(text, ";")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<array<int>>")).otherwise(F.transform(buckets, lambda b: F.transform(F.filter(F.split(b, r"\|"), lambda x: x != ""), lambda x: x.cast("int"))))


def hex_ids(text: Column) -> Column:
    """Numbers of the set bits: each 16 digits are 64 bits, the lowest the first."""
    digits = F.regexp_replace(text, "^(hex:|0x)", "")
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(digits) + 15) / 16).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("at"), F.substring(digits, i * 16 + 1, F.lit(16)).alias("hex")))
    each = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.length(w["hex"]) * 4 - 1), lambda b: F.when(F.substring(F.lpad(F.conv(w["hex"], 16, 2), 64, "0"), F.lit(64) - b, F.lit(1)) == "1", w["at"] * 64 + b))))
    return F.array_compact(each)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """A row per node: id, type, children, weights, scope, buckets, bin_values, bin_bitmaps."""
    fields = F.str_to_map(F.trim(F.col(column)), F.lit(r"\s+"), F.lit("="))
    rows = lines.where(F.col(column).rlike(r"(^|\s)id=")).select(fields.alias("f"))
    get = lambda k: F.element_at("f", k)
    bitmaps = get("bin_bitmaps")
    return rows.select(
        get("id").cast("int").alias("id"),
        get("type").alias("type"),
        _list(get("children"), "int").alias("children"),
        _list(get("weights"), "double").alias("weights"),
        _list(get("scope"), "int").alias("scope"),
        _list(get("buckets"), "double").alias("buckets"),
        _list(get("bin_values"), "double").alias("bin_values"),
        F.when(bitmaps.rlike("^(hex:|0x)"), F.transform(F.split(bitmaps, ";"), hex_ids)).otherwise(_ids(bitmaps)).alias("bin_bitmaps"),
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def scaled_weights(nodes: DataFrame, by: int = 10_000) -> DataFrame:
    """The weights as whole numbers: times `by`, cut off toward zero."""
    return nodes.withColumn("weights", F.transform("weights", lambda w: (w * by).cast("bigint")))
