"""Join and union fixtures: half-overlapping keys, both sides small, unmatched cells read as zero."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import joins as J
from ledgerloom.operators import setops as U
from ledgerloom.operators.query import JoinQuery
from ledgerloom.plans import apps


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module", params=[(64, 64), (8, 64), (64, 8)])
def pair(request, spark):
    n, m = request.param
    match = (min(n, m) + 1) // 2
    a = spark.createDataFrame([(i + 1, i * 3) for i in range(n)], "key long, data3 int")
    b = spark.createDataFrame([(i + 1 if i < match else i + 1 + n, i * 5, i * 7) for i in range(m)], "key long, data long, data2 long")
    return a, b, match


def test_inner(pair):
    a, b, match = pair
    got = rows(J.join(a, b, "key", "key", ["key", "data3"], ["data", "data2"]))
    assert got == [(i + 1, i * 3, i * 5, i * 7) for i in range(match)]


def test_left_reads_zero_and_left_key(pair):
    a, b, match = pair
    got = rows(J.left_join(a, b.withColumnRenamed("key", "k2"), "key", "k2", ["data3"], ["k2", "data"], flag="f"))
    assert got == sorted((i * 3, i + 1, i * 5 if i < match else 0, i < match) for i in range(a.count()))


def test_expressions_see_the_zeros(pair):
    a, b, match = pair
    q = JoinQuery()
    key = q.join_on(a, "key", b, "key")
    q.output("key", key)
    q.output("sum", q.input("right", "data") + q.input("right", "data2"))
    q.no_reveal("f")
    assert rows(q.run()) == sorted((i + 1, i * 12 if i < match else 0, i < match) for i in range(a.count()))


def test_duplicates(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k long, v string")
    assert rows(J.intersect(left, right)) == [(1,), (1,)]
    assert rows(J.join(left, right, "k", "k", ["k"], ["v"])) == [(1, "x"), (1, "x")]
    twice = right.unionByName(right)
    with pytest.raises(J.DuplicateKeyError):
        J.join(left, twice, "k", "k", ["k"], ["v"])
    assert len(rows(J.join(left, twice, "k", "k", ["k"], ["v"], unique=False))) == 4
    assert rows(J.left_join(left.where("k IS NULL"), right, "k", "k", ["k"], ["v"], flag="f")) == [(None, "", False)]


def test_right_join_of_columns_with_one_name(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string")
    got = J.right_join(a, b, "k", "k", ["v"], ["k", "v"], flag="f")
    assert got.columns == ["v", "k", "v", "f"] and rows(got) == [("", 3, "c", False), ("y", 2, "b", True)]


def test_keys_that_the_plan_makes_unique_are_not_counted(spark):
    a = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k long, v long")
    assert J._known_unique(a.groupBy("k").count(), ["k"]) and J._known_unique(a.select("k").distinct(), ["k", "v"])
    assert not J._known_unique(a, ["k"]) and not J._known_unique(a.distinct(), ["k"])
    assert rows(J.join(a, a.groupBy("k").count(), "k", "k", ["v"], ["count"])) == [(2, 2), (3, 2), (4, 1)]


def test_builder_expressions(spark):
    a = spark.createDataFrame([(1, 5), (2, 9), (3, 0)], "k long, x long")
    b = spark.createDataFrame([(1, 5), (2, None)], "k long, y long")
    q = JoinQuery()
    q.join_on(a, "k", b, "k")
    x, y, has = q.input("left", "x"), q.input("right", "y"), q.is_not_null("right", "y")
    q.output("x", x)
    q.output("same", x == y)
    q.output("differ", x != y)
    q.output("has", has)
    q.output("case", q.case((has, y), (x == q.constant(9), q.constant(-9)), otherwise=q.constant(0)))
    q.output("mine", x.apply(lambda c: c * 2 + 1, bits=64) + q.constant(1))
    q.no_reveal("f")
    assert rows(q.run()) == [(0, True, False, False, 0, 2, False), (5, True, False, True, 5, 12, True), (9, None, None, False, -9, 20, True)]


def test_builder_errors(spark):
    a = spark.createDataFrame([(1, 2, True)], "k long, x int, f boolean")
    q = JoinQuery()
    with pytest.raises(ValueError):
        q.input("left", "x")
    q.join_on(a, "k", a, "k")
    with pytest.raises(ValueError):
        q.join_on(a, "k", a, "k")
    x, f = q.input("left", "x"), q.input("left", "f")
    with pytest.raises(ValueError):
        x | f
    q.output("x", x)
    with pytest.raises(ValueError):
        q.output("x", x)


def test_filter_unmatches(spark):
    a = spark.createDataFrame([(1, 5), (2, 9)], "k long, x long")
    for flagged in (False, True):
        q = JoinQuery()
        key = q.join_on(a, "k", a, "k")
        q.output("k", key)
        q.filter(q.input("left", "x") < q.constant(7))
        if flagged:
            q.no_reveal("f")
        assert rows(q.run()) == ([(1, True), (2, False)] if flagged else [(1,)])


def test_unions(spark):
    a = spark.createDataFrame([(i, 3 * i) for i in range(129, 177)], "key long, data long")
    b = spark.createDataFrame([(i, 2 * i) for i in range(1, 161)], "key long, data long")
    cols = ["key", "data"]
    right = rows(U.right_union(a, b, "key", "key", cols, cols))
    assert right == [(i, 2 * i if i <= 160 else 3 * i) for i in range(1, 177)]
    left = rows(U.left_union(a, b, "key", "key", cols, cols))
    assert left == [(i, 2 * i if i < 129 else 3 * i) for i in range(1, 177)]
    assert rows(U.minus(a, b, "key", "key")) == [(i, 3 * i) for i in range(161, 177)]
    assert rows(U.union_many([a, b], "key")) == left
    assert right_count(a, b) == b.count() + J.anti(a, b, "key", "key").count()
    with pytest.raises(ValueError):
        U.right_union(a, b.selectExpr("key", "cast(data as string) data"), "key", "key", cols, cols)


def right_count(a, b):
    return U.right_union(a, b, "key", "key", ["key"], ["key"]).count()


def test_at_least_k(spark):
    sets = [spark.createDataFrame([(i,) for i in s], "key long") for s in ([1, 2, 3, 3], [2, 3], [3, None])]
    assert rows(apps.threat_log(sets, "key", 2)) == [(2, 2), (3, 3)]
    many = [spark.range(i, i + 2).withColumnRenamed("id", "key") for i in range(70)]
    assert rows(U.at_least_k(many, "key", 2)) == [(i, 2) for i in range(1, 70)]
    assert rows(U.at_least_k([sets[0]] * 70, "key", 70)) == [(1, 70), (2, 70), (3, 70)]


def test_full(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k long, x long")
    b = spark.createDataFrame([(2, 200), (3, 300)], "k long, y long")
    assert rows(J.full_join(a, b, "k", "k", ["x"], ["y"], zero_fill=True)) == [(1, 10, 0, True, False), (2, 20, 200, True, True), (3, 0, 300, False, True)]


def test_voter_audit(spark):
    lic = "dl long, na long, ssn long, ad long"
    one = apps.registered(spark.createDataFrame([(1, 11, 100, 5), (2, 12, 101, 9), (3, 13, 102, 1), (4, 14, 103, 2)], lic), spark.createDataFrame([(1,), (2,), (4,)], "dl long"))
    two = apps.registered(spark.createDataFrame([(7, 21, 100, 8), (8, 22, 101, 3), (9, 23, 102, 4)], lic), spark.createDataFrame([(7,), (9,)], "dl long"))
    got = rows(apps.voter_audit(one, two))
    # registered in both; here only, with the newer address; there only, with the newer address; no match
    assert got == [(100, 11, 21, 5, 8, True), (101, 0, 0, 9, 3, True), (102, 0, 0, 1, 4, True), (103, 0, 0, 2, 0, False)]


def test_rows_of_few_keys_are_made_by_many_tasks(spark):
    """One key, in one file on both sides: no task makes more than its share."""
    a = spark.range(0, 3000, 1, 1).selectExpr("id AS a", "1 AS k")
    b = spark.range(0, 3000, 1, 1).selectExpr("id AS b", "1L AS k")
    made = [r["count"] for r in J.join(a, b, "k", "k", ["a"], ["b"], unique=False).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 9_000_000 and max(made) < 6_000_000


@pytest.mark.parametrize("made", [5000, 1 << 22])
def test_repeated_keys_copies_and_nulls(spark, made):
    left = [(1, "x", 5)] * 300 + [(1, "x", None)] * 3 + [(i % 4, None if i % 3 else "y", i) for i in range(200)] + [(None, "x", 1), (2, None, 2)]
    right = [(1, "x", 7)] * 150 + [(i % 5, "y", None if i % 2 else i) for i in range(40)] + [(None, "x", 1), (9, "x", 1)]
    a, b = spark.createDataFrame(left, "k int, s string, v long"), spark.createDataFrame(right, "k long, s string, v long")
    as_text = lambda rows: Counter(map(repr, map(tuple, rows)))
    pairs = [(x, y) for x in left for y in right if x[0] is not None and x[0] == y[0]]
    both = [(x, y) for x, y in pairs if x[1] is not None and x[1] == y[1]]
    assert as_text(J.expand(a, b, ["k", "s"], ["k", "s"], ["v", "k"], ["v"], made).collect()) == as_text((x[2], x[0], y[2]) for x, y in both)
    assert as_text(J.expand(a, b, "k", "k", ["s"], ["s", "v"], made).collect()) == as_text((x[1], y[1], y[2]) for x, y in pairs)
    assert as_text(J.expand(a, b, "k", "k", ["v"], [], made).collect()) == as_text((x[2],) for x, _ in pairs)
    assert J.expand(a, b.where("k = 9"), "k", "k", ["v"], ["v"], made).count() == 0 == J.expand(a.where("false"), b, "k", "k", ["v"], ["v"], made).count()
    assert J.expand(a.withColumn("m", F.create_map("k", "v")), a, "k", "k", ["m"], ["v"], made).count() == sum(x[0] is not None and x[0] == y[0] for x in left for y in left)
