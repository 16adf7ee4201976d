import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import lookup as L
from ledgerloom.operators import order as O


def by(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=60))
def test_stable_sort(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert by(O.stable_sort(df, "v", "i"), "rank", "i") == list(enumerate(order))


def test_rank_spreads_one_hot_value(spark):
    df = spark.range(5000).select((F.col("id") % 3 * 0).alias("v"), "id")
    ranked = O.with_rank(df, ["v", "id"], ranges=8)
    assert by(ranked, "id", "rank") == [(i, i) for i in range(5000)]


def test_intervals(spark):
    df = spark.createDataFrame([(9 - i, i) for i in range(10)], "v long, i long")
    assert [v for _, v in by(O.interval_sort(df, "v", "i", [(0, 5), (5, 10)]), "position", "v")] == [5, 6, 7, 8, 9, 0, 1, 2, 3, 4]
    assert [v for _, v in by(O.interval_sort(df, "v", "i", [(1, 3), (3, 5), (5, 8), (8, 10)]), "position", "v")] == [9, 7, 8, 5, 6, 2, 3, 4, 0, 1]


def test_merges(spark):
    parts = [[10 * (k + 1) + i for i in range(n)] for k, n in enumerate((50, 98, 50, 98))]
    dfs = [spark.createDataFrame([(v,) for v in p], "v long") for p in parts]
    assert [v for _, v in by(O.merge(dfs, "v"), "rank", "v")] == sorted(sum(parts, []))
    row = spark.createDataFrame([([1, 4], [2, 3, 9], [0])], "a array<int>, b array<int>, c array<int>")
    assert row.select(O.merge_arrays("a", "b", "c").alias("m")).first().m == [0, 1, 2, 3, 4, 9]


def test_permutations(spark):
    n = 100
    df = spark.createDataFrame([(i, f"r{i}") for i in range(n)], "i long, v string")
    perm = list(range(n))
    random.Random(3).shuffle(perm)
    mapping = spark.createDataFrame(list(enumerate(perm)), "source long, target long")
    assert by(O.scatter(df, "i", mapping), "i", "v") == sorted((perm[i], f"r{i}") for i in range(n))
    assert by(O.gather(O.scatter(df, "i", mapping), "i", O.inverse(mapping, "source", "target")), "i", "v") == by(df, "i", "v")
    some = mapping.withColumn("target", F.when(F.col("source") % 2 == 0, F.col("target")).otherwise(-1))
    assert len(by(O.scatter(df, "i", some), "i")) == 50
    again = spark.createDataFrame([(i % 7, i) for i in range(20)], "source long, target long")
    assert by(O.gather(df, "i", again), "i", "v") == [(i, f"r{i % 7}") for i in range(20)]
    pi = O.permutation(df, "i", 5)
    assert sorted(r.pi for r in pi.collect()) == list(range(n)) and by(pi, "i", "pi") != [(i, i) for i in range(n)]
    assert by(O.shuffle(df, "i", 5), "i") == [(i,) for i in range(n)]


def test_one_head_before_many(spark):
    """The values of one row reach all ranges after it."""
    df = spark.range(20000).select("id", (F.col("id") + 7).alias("v"), ((F.col("id") != 3) & (F.col("id") != 15000)).alias("f"))
    got = O.duplicate_forward(df, "id", "f", ["v"]).collect()
    assert all(r.v == (15007 if r.id >= 15000 else 10 if r.id >= 3 else None) for r in got) and len(got) == 20000


def test_ranges_are_found_by_blocks(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") * 7919 % 3001).alias("v"))
    for n in (1, 2, 7, 60):
        ranked = sorted((r["rank"], r.v if r.v is not None else -1, r.id) for r in O.with_rank(df, ["v", "id"], ranges=n).collect())
        assert [r[0] for r in ranked] == list(range(3000)) and [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)


def test_small_ones(spark):
    df = spark.createDataFrame([(i, i * i, i % 3 != 0) for i in range(10)], "i long, v long, f boolean")
    assert by(O.duplicate_forward(df, "i", "f", ["v"]), "i", "v") == [(i, (i // 3 * 3) ** 2) for i in range(10)]
    assert by(O.argwhere(df, "i", "v", 49), "i") == [(7,)]
    assert by(O.first_false(df.where("i > 0"), "i", "f"), "i", "mask") == [(i, i == 3) for i in range(1, 10)]
    assert not any(m for _, m in by(O.first_false(df.where("f"), "i", "f"), "i", "mask"))
    assert by(O.tile(df, "i", 2), "i", "v") == [(i, (i % 10) ** 2) for i in range(20)]
    assert by(O.repeat(df, "i", 2), "i", "v") == [(i, (i // 2) ** 2) for i in range(20)]
    tagged = df.select("i", O.tag_append("v", "i", 4).alias("t")).select("i", O.tag_remove("t", 4).alias("v"))
    assert by(tagged, "i", "v") == [(i, i * i) for i in range(10)]
    drawn = [by(O.subset(df, "i", 5, k, 1), "i") for k in range(4)]
    assert sorted(drawn[0] + drawn[1]) == sorted(drawn[2] + drawn[3]) == [(i,) for i in range(10)]
    with pytest.raises(ValueError):
        O.subset(df, "i", 11, 0, 1)
    asked = spark.createDataFrame([(3,), (12,), (3,)], "q long")
    assert [(q, v) for q, v in sorted((r.q, r.v) for r in L.access(df, "i", asked, "q").collect() if r.v)] == [(3, 9), (3, 9)]
