"""Sorting, merging, permuting and indexing. Rows have no order in Spark: order is a column.

Global ranks never bring all rows to one task. Rows are dealt into ranges of the sort key,
whose bounds come from a sample of bounded size; each range is ranked by itself and begins
where the counts of those before it end. Ties are broken by the last columns of the key,
so a value that fills a third of the table still spreads over many ranges.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import _c

#: Sampled rows for each range.
SAMPLED = 20


def _dealt(df: DataFrame, keys: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """df and the number of each row's range of the keys (nulls in the first). Bounds are those of
    a sample; a row is compared with every tenth or so of them, then with those in between."""
    n = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = [tuple(r) for r in df.select(*keys).orderBy(F.xxhash64(*keys)).limit(n * SAMPLED).collect()]
    sample = sorted((r for r in sample if None not in r))[SAMPLED // 2 :: SAMPLED]
    if not sample:
        return df.withColumn(name, F.lit(0))
    kinds = [df.schema[c].dataType for c in keys]
    struct = lambda b: F.struct(*(F.lit(v).cast(k).alias(f"k{i}") for i, (v, k) in enumerate(zip(b, kinds))))
    row = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)))
    below = lambda array: F.size(F.filter(array, lambda b: b <= row))
    step = math.isqrt(len(sample) - 1) + 1
    blocks = [sample[i : i + step] for i in range(0, len(sample), step)]
    block = below(F.array(*(struct(b[0]) for b in blocks)))  # 0: before the first bound of all
    within = below(F.element_at(F.array(*(F.array(*map(struct, b)) for b in blocks)), F.greatest(block, F.lit(1))))
    return df.withColumn(name, F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + within))


def with_rank(df: DataFrame, order: Sequence[str], name: str = "rank", *, partition: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """df and each row's place from 0 in ascending order of `order` (nulls first).

    `order` should end in columns that tell rows apart; rows that are equal in all of them
    get different places in no set order. With `partition`, places count within each value
    of it, and the ranges are of (partition, order).
    """
    dealt = _dealt(df, [*partition, *order], "_range", ranges)
    counts = dealt.groupBy("_range", *partition).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if partition else None
    if partition:
        offsets = counts.select("_range", *(F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")).withColumnRenamed("_range", "_r")
        on = F.col("_range") == F.col("_r")
        for i, c in enumerate(partition):
            on = on & F.col(c).eqNullSafe(F.col(f"_p{i}"))
        dealt = dealt.join(offsets, on)
        offset = F.col("_offset")
    else:  # a number for each range
        rows = sorted((r["_range"], r["_n"]) for r in counts.collect())
        sums = itertools.accumulate((k for _, k in rows), initial=0)
        offset = F.element_at(F.create_map(*(F.lit(x) for (r, _), s in zip(rows, sums) for x in (r, int(s)))), F.col("_range")) if rows else F.lit(0)
    own = F.row_number().over(Window.partitionBy("_range", *partition).orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return dealt.select(*df.columns, (offset + own - 1).cast("bigint").alias(name))


def stable_sort(df: DataFrame, value: str, ordinal: str, name: str = "rank") -> DataFrame:
    """Places in ascending order of value; equal values keep the order of `ordinal`."""
    return with_rank(df, [value, ordinal], name)


def interval_sort(df: DataFrame, value: str, ordinal: str, bounds: Sequence[tuple[int, int]], name: str = "position") -> DataFrame:
    """Sorts the rows with low <= ordinal < high of each interval among themselves; the rest stay."""
    low = F.lit(None).cast("bigint")
    for a, b in bounds:
        low = F.when((F.col(ordinal) >= a) & (F.col(ordinal) < b), F.lit(a).cast("bigint")).otherwise(low)
    rows = df.withColumn("_low", low)
    inside = with_rank(rows.where("_low IS NOT NULL"), [value, ordinal], "_at", partition=["_low"])
    moved = inside.select(*df.columns, (F.col("_low") + F.col("_at")).alias(name))
    return moved.unionByName(rows.where("_low IS NULL").select(*df.columns, F.col(ordinal).cast("bigint").alias(name)))


def merge(tables: Sequence[DataFrame], value: str, name: str = "rank") -> DataFrame:
    """The rows of k sorted tables in one order: value, source (the number of its table), place."""
    rows = None
    for i, t in enumerate(tables):
        own = t.select(F.col(value).alias(value), F.lit(i).alias("source"))
        rows = own if rows is None else rows.unionByName(own)
    return with_rank(rows, [value, "source"], name)


def merge_arrays(*arrays) -> Column:
    """Sorted arrays merged into one, row by row."""
    return F.array_sort(F.concat(*map(_c, arrays)))


def tag_append(value, ordinal, bits: int) -> Column:
    """value << bits | ordinal: makes values distinct and their sort stable. Bits of the ordinal above
    `bits` fall on the value and cannot be told from it: tag_place leaves them out."""
    return F.shiftleft(_c(value).cast("bigint"), bits).bitwiseOR(_c(ordinal).cast("bigint"))


def tag_place(ordinal, bits: int) -> Column:
    """The ordinal's place in its block of 2^bits rows (0 for null): a tag that fits, distinct within the
    block, whatever the size of the table."""
    return F.coalesce(_c(ordinal).cast("bigint"), F.lit(0)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def tag_remove(tagged, bits: int) -> Column:
    return F.shiftright(_c(tagged), bits)


def permutation(df: DataFrame, ordinal: str, seed: int, name: str = "pi") -> DataFrame:
    """A random permutation of the rows: each one's new place. The seed and the ordinal decide it."""
    keyed = df.withColumn("_key", F.xxhash64(F.lit(seed), F.col(ordinal)))
    return with_rank(keyed, ["_key", ordinal], name).drop("_key")


def shuffle(df: DataFrame, ordinal: str, seed: int) -> DataFrame:
    """df with `ordinal` permuted at random."""
    return permutation(df, ordinal, seed, "_pi").drop(ordinal).withColumnRenamed("_pi", ordinal).select(*df.columns)


def inverse(mapping: DataFrame, source: str, target: str) -> DataFrame:
    return mapping.select(F.col(target).alias(source), F.col(source).alias(target))


def compose(first: DataFrame, second: DataFrame, source: str, target: str) -> DataFrame:
    """source to second(first(source))."""
    return first.select(F.col(source).alias("_s"), F.col(target).alias("_m")).join(second.select(F.col(source).alias("_m"), F.col(target).alias("_t")), "_m").select(F.col("_s").alias(source), F.col("_t").alias(target))


def scatter(df: DataFrame, ordinal: str, mapping: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Row i goes to mapping(i); rows without a target, or with a negative one, are dropped."""
    m = mapping.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_t >= 0")
    return df.join(m, df[ordinal] == m["_s"]).select(*(F.col("_t").alias(c) if c == ordinal else df[c] for c in df.columns))


def gather(df: DataFrame, ordinal: str, mapping: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Place `target` gets row `source`; rows may be used repeatedly or not at all."""
    m = mapping.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
    return m.join(df, df[ordinal] == m["_s"]).select(*(F.col("_t").alias(c) if c == ordinal else df[c] for c in df.columns))


def duplicate_forward(df: DataFrame, ordinal: str, flag: str, columns: Sequence[str]) -> DataFrame:
    """Where flag is set, a row takes the values of the nearest row before it without one.

    Rows are dealt into ranges of the ordinal and look back within theirs. What the ranges before
    leave behind, their last row without a flag, is a row for each range: few, whatever
    the size of the table, so that no window and no array spans it.
    """
    dealt = _dealt(df, [ordinal], "_range")
    head = F.when(~F.col(flag), F.struct(*(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns))))
    left = dealt.groupBy("_range").agg(F.max(F.when(~F.col(flag), F.struct(F.col(ordinal).alias("_o"), head.alias("_h")))).alias("_m"))
    carry = left.select(F.col("_range").alias("_r"), F.last(F.col("_m")["_h"], ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    own = F.last(head, ignorenulls=True).over(Window.partitionBy("_range").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = dealt.withColumn("_own", own).join(F.broadcast(carry), F.col("_range") == F.col("_r"), "left")
    got = F.coalesce("_own", "_carry")
    put = {c: got[f"_v{i}"] for i, c in enumerate(columns)}
    return rows.select(*(F.when(F.col(flag), put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in df.columns))


def argwhere(df: DataFrame, ordinal: str, column: str, target) -> DataFrame:
    """Ordinals of the rows that hold the target."""
    return df.where(F.col(column) == F.lit(target)).select(ordinal)


def argwhere_array(array, target) -> Column:
    """Index of the first entry equal to target; 0 if none is."""
    return F.greatest(F.array_position(_c(array), F.lit(target)) - 1, F.lit(0)).cast("bigint")


def first_false(df: DataFrame, ordinal: str, flag: str, name: str = "mask") -> DataFrame:
    """A mark on the first row whose flag is false; on none if all are true. Null counts as true."""
    least = df.where(~F.col(flag)).agg(F.min(ordinal).alias("_first"))
    return df.crossJoin(F.broadcast(least)).select(*df.columns, F.coalesce(F.col(ordinal) == F.col("_first"), F.lit(False)).alias(name))  # one row


def tile(df: DataFrame, ordinal: str, times: int) -> DataFrame:
    """The whole table `times` over: ordinals go on where a copy ends."""
    n = df.count()
    return df.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(*((F.col("_t") * n + F.col(ordinal)).cast("bigint").alias(c) if c == ordinal else F.col(c) for c in df.columns))


def repeat(df: DataFrame, ordinal: str, times: int) -> DataFrame:
    """Each row `times` over."""
    return df.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(*((F.col(ordinal) * times + F.col("_t")).cast("bigint").alias(c) if c == ordinal else F.col(c) for c in df.columns))


def subset(df: DataFrame, ordinal: str, size: int, turn: int, seed: int) -> DataFrame:
    """The turn-th mini-batch: each pass over the table is a new permutation, without repeats."""
    n = df.count()
    if not 0 < size <= n:
        raise ValueError("a batch has 1 to all rows")
    each = n // size
    drawn = permutation(df, ordinal, seed + turn // each, "_pi")
    at = turn % each
    return drawn.where((F.col("_pi") >= at * size) & (F.col("_pi") < (at + 1) * size)).drop("_pi")
