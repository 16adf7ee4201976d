"""The registered queries: some against SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = "join_inner join_hidden join_expressions full_join right_union union_priority at_least_k flagged_aggregates stable_sort_rank interval_sort scatter duplicate_forward scalar_arith fixed_mul_d16 piecewise lookup pred_neural_small matmul voter_audit threat_log".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    got, want = entry.queries()[name](spark, FOLDER), con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())


def differing(spark, tmp_path, name, **tables):
    """Runs a query on the given tables; its rows that SQL does not have, and the reverse."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = Counter(tuple(r[c] for c in cols) for r in got.collect()), Counter(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall())
    return sorted((a - b).elements(), key=repr), sorted((b - a).elements(), key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_arrays_of_any_length_and_products_at_a_half(spark, tmp_path, kind):
    half = -0.13349999487400055  # a float whose product with 1000 is -133.5 as a float only
    arrays = [[half, -half, 0.3154999911785126], [i / 7 for i in range(300, 0, -1)], [], None, [None], [2.0, None, -1.5], [None] * 120 + [1.0]]
    df = spark.createDataFrame(list(enumerate(arrays)), f"vec_id long, embedding array<{kind}>")
    assert differing(spark, tmp_path, "merge_arrays", embeddings=df) == ([], [])


def test_tags_of_keys_wider_than_the_tag(spark, tmp_path):
    keys = [0, 1, (1 << 20) - 1, 1 << 20, (1 << 20) + 5, 9_000_001, (1 << 43) + 3, -7, None]
    values = [0, 1, 3, 899_999, (1 << 43) - 1, None]
    df = spark.createDataFrame([(k, v) for k in keys for v in values], "o_orderkey long, o_custkey long")
    assert differing(spark, tmp_path, "tag_roundtrip", orders=df) == ([], [])
