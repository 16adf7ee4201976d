"""Scalars, fixed point, piecewise functions and aggregates on 16-row fixtures."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import fixed as X
from ledgerloom.functions import piecewise as P
from ledgerloom.functions import scalar as S
from ledgerloom.operators import agg as A
from ledgerloom.operators import lookup as L

WORD = st.integers(-(2**63), 2**63 - 1)


def wrap(v, bits=64):
    return (v + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))


@pytest.fixture(scope="module")
def sixteen(spark):
    return spark.createDataFrame([(i, 16 - i, -i, -1 if i == 5 else 0) for i in range(16)], "x long, y long, z long, mask long")


def test_bits(sixteen):
    got = sixteen.select("x", "y", S.xor("x", "y").alias("xor"), S.or_("x", "y").alias("or"), S.and_("x", "y").alias("and"), S.gt("x", "y").alias("gt"), S.eq("x", "y").alias("eq"), S.add("x", "y").alias("add"), S.not_("x").alias("not"), S.shift("z", -5).alias("sr"), S.split_at("x", 5).alias("split"), S.max_min_split("x", "y").alias("mm"), S.bits_of("x", 4).alias("bits")).collect()
    for r in got:
        x, y = r.x, r.y
        assert (r["xor"], r["or"], r["and"], r.gt, r.eq, r["add"], r["not"], r.sr) == (x ^ y, x | y, x & y, x > y, x == y, 16, ~x, -x >> 5)
        assert tuple(r.split) == (x >> 5, x & 31) and tuple(r.mm) == (max(x, y), min(x, y)) and r.bits == [x >> i & 1 for i in range(4)]
    assert sixteen.agg(A.xor_dot("x", "mask").alias("d")).first().d == 5
    assert sixteen.agg(A.block_select(F.col("mask") != 0, "y").alias("d")).first().d == 11


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(WORD, WORD), min_size=1, max_size=30))
def test_arithmetic_wraps(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", S.add("a", "b").alias("p"), S.sub("a", "b").alias("m"), S.mul("a", "b").alias("t"), S.mul("a", "b", 16).alias("t16")).collect():
        assert (r.p, r.m, r.t, r.t16) == (wrap(r.a + r.b), wrap(r.a - r.b), wrap(r.a * r.b), wrap(r.a * r.b, 16))
    assert A.aggregate(df, "a", "ADD").first().value == wrap(sum(a for a, _ in pairs))


@pytest.mark.parametrize("d", [8, 16, 32])
def test_fixed(spark, d):
    vals = [(a / 128.0, b / 128.0) for a, b in ((-32768, 32767), (-1, 1), (300, -7), (0, 5), (-12345, 321), (77, 77))]
    df = spark.createDataFrame(vals, "a double, b double").select(X.to_fixed("a", d).alias("a"), X.to_fixed("b", d).alias("b"))
    for (a, b), r in zip(vals, df.select("a", "b", X.fixed_mul("a", "b", d).alias("cut"), X.fixed_mul_floor("a", "b", d).alias("floor"), X.from_fixed("a", d).alias("back")).collect()):
        assert r.a == math.trunc(a * 2**d) and r.back == r.a / 2**d
        assert r.cut == wrap(abs(r.a * r.b) // 2**d * (1 if r.a * r.b >= 0 else -1)) and r.floor == wrap(r.a * r.b >> d)
    with pytest.raises(ValueError):
        X.to_fixed("a", 7)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(WORD, WORD), min_size=1, max_size=30))
def test_fixed_products_of_any_size(spark, pairs):
    pairs = [*pairs, (2**62 + 12345, 2**62 + 999), (-(2**63), -(2**63)), (-(2**63), 2**63 - 1), (-1, 1), (0, -5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for d, shift in ((0, 0), (8, 0), (16, 3), (32, 0), (32, 40)):
        for r in df.select("a", "b", X.fixed_mul("a", "b", d, shift).alias("cut"), X.fixed_mul_floor("a", "b", d, shift).alias("floor")).collect():
            p, k = r.a * r.b, d + shift
            assert r.cut == wrap((abs(p) >> k) * (1 if p >= 0 else -1)) and r.floor == wrap(p >> k)


def test_arithmetic_under_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        df = spark.createDataFrame([(2**63 - 1, 2**63 - 1), (-(2**63), -1)], "a long, b long")
        got = df.select("a", "b", S.add("a", "b").alias("p"), S.sub("b", "a").alias("m"), S.mul("a", "b").alias("t"), X.fixed_mul("a", "b", 16).alias("x"), S.add("a", "b", 8).alias("p8")).collect()
        assert all((r.p, r.m, r.t, r.p8) == (wrap(r.a + r.b), wrap(r.b - r.a), wrap(r.a * r.b), wrap(r.a + r.b, 8)) for r in got)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "false")


def test_piecewise(spark):
    xs = [-3.0, -0.5, -0.25, 0.0, 0.4999, 0.5, 2.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", P.relu("x").alias("relu"), P.logistic_pw("x").alias("pw"), P.sigmoid("x").alias("s"), P.regions("x", (-0.5, 0.5)).alias("r"), P.piecewise("x", (0,), ((1, 2, 3), ())).alias("sq")).collect():
        assert r.relu == max(0, r.x) and r.pw == min(max(r.x + 0.5, 0), 1) and math.isclose(r.s, 1 / (1 + math.exp(-r.x)))
        assert r.r == [r.x < -0.5, -0.5 <= r.x < 0.5, r.x >= 0.5] and r.sq == (1 + 2 * r.x + 3 * r.x**2 if r.x < 0 else 0)
    for bad in (((1, 0), ((), (), ())), ((0,), ((),))):
        with pytest.raises(ValueError):
            P.piecewise("x", *bad)
    with pytest.raises(ValueError):
        P.piecewise("x", (0,), ((), (0, 0.5)), linear=True)


def test_aggregates(spark, sixteen):
    flags = spark.createDataFrame([(True,), (False,), (True,)], "f boolean")
    assert [A.aggregate(flags, "f", k).first().value for k in ("ADD", "OR", "AND")] == [2, True, False]
    assert [A.aggregate(sixteen, "x", k).first().value for k in ("ADD", "OR", "AND", "MIN", "MAX")] == [120, 15, 0, 0, 15]
    with pytest.raises(ValueError):
        A.aggregate(sixteen, "x", "XOR")
    assert A.aggregate(sixteen.where("false"), "x", "ADD").first().value == 0
    arrays = spark.createDataFrame([([1.0, 5.0, 5.0],), ([7.0],)], "a array<double>")
    assert [r.i for r in arrays.select(A.argmax("a").alias("i")).collect()] == [1, 0]
    assert [r.v for r in arrays.select(L.linear("a", F.lit(2)).alias("v")).collect()] == [5.0, None]
    assert A.cardinality(sixteen, sixteen, "x", "y").first().n == 15
