import math

from ledgerloom.ml import regression as R
from ledgerloom.sources import spn, synthetic, tables


def test_linear_converges(spark):
    w = [3.0, 1.0, 4.0, 0.0]
    df = synthetic.linear_samples(spark, 200, w, spread=0.5, seed=3).cache()
    got = R.sgd_linear(df, "x", "y", [0.0] * 4, batch=50, rate=0.5, iterations=40, ordinal="id")
    assert all(abs(a - b) < 0.5 for a, b in zip(got, w))
    assert R.test_linear(synthetic.linear_samples(spark, 200, w, spread=0.5, seed=4), "x", "y", got) < 0.6


def test_logistic_predicts(spark):
    w = [3.0, -2.0]
    df = synthetic.logistic_samples(spark, 200, w, spread=1.0, seed=5).cache()
    for exact in (True, False):
        got = R.sgd_logistic(df, "x", "y", [0.0] * 2, batch=50, rate=1.0, iterations=20, ordinal="id", exact=exact)
        assert R.test_logistic(df, "x", "y", got, exact) > 0.85


def test_steps_on_the_driver_and_in_tasks_are_the_same(spark):
    df = synthetic.linear_samples(spark, 300, [1.0, -2.0, 0.5], seed=3).cache()
    for kind in (R.sgd_linear, R.sgd_logistic):
        for batch in (300, 70):
            a, b = (kind(df, "x", "y", [0.1] * 3, batch=batch, rate=0.5, iterations=6, ordinal="id", local_cells=n) for n in (1 << 20, 1))
            assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b))


def test_predictions(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([0.5, 3.0],)], "x array<double>")
    layers = [[[1, -1], [1, 2]], [[1, 0, 0], [0, 1, 1]]]
    for r in df.select("x", R.pred_linear("x", [2, 1]).alias("lin"), R.pred_logistic("x", [2, 1]).alias("log"), R.pred_neural("x", layers).alias("nn")).collect():
        a, b = r.x
        h = [max(0, a + b), max(0, -a + 2 * b)]
        out = [h[0], h[1], h[1]]
        assert math.isclose(r.lin, 2 * a + b) and r.log == int(2 * a + b > 0) and r.nn == out.index(max(out))


def test_matrices(spark):
    a = spark.createDataFrame([(i, j, i + 2 * j) for i in range(3) for j in range(2)], "i long, j long, v long")
    got = {(r.i, r.j): r.v for r in R.matmul(a, R.transpose(a)).collect()}
    assert got == {(i, k): sum((i + 2 * j) * (k + 2 * j) for j in range(2)) for i in range(3) for k in range(3)}
    assert R.same_matrix(a, R.transpose(R.transpose(a))).first().same and not R.same_matrix(a, R.transpose(a)).first().same


def test_spn(spark, tmp_path):
    text = "# nodes\nid=0 type=Sum children=1|2 weights=0.25,0.75 scope=0|1\nid=1 type=Categorical scope=0 buckets=0|1 bin_values=0.5|0.5 bin_bitmaps=1|2;3\nid=2 type=Categorical scope=1 bin_bitmaps=hex:0000000000000005\n"
    (tmp_path / "n.txt").write_text(text)
    got = {r.id: r for r in spn.scaled_weights(spn.load(spark, str(tmp_path / "n.txt"))).collect()}
    assert got[0].children == [1, 2] and got[0].weights == [2500, 7500] and got[0].scope == [0, 1]
    assert got[1].bin_bitmaps == [[1, 2], [3]] and got[2].bin_bitmaps == [[0, 2]] and got[1].bin_values == [0.5, 0.5]


def test_tables(spark):
    df = tables.from_rows(spark, [(1, "ab", True)], [("k", "int", 80), ("s", "string", 16), ("f", "int", 1)])
    assert [t for _, t in df.dtypes] == ["decimal(38,0)", "string", "boolean"]
    tables.check_width(df, "s", 16)
    assert tuple(tables.masked(df.selectExpr("k", "s", "not f f"), "f", ["k", "s"]).first()) == (0, "", False)
    for bad in (lambda: tables.check_width(df, "s", 24), lambda: tables.string_type(7), lambda: tables.int_type(0), lambda: tables.column(df, "none")):
        try:
            bad()
        except (ValueError, KeyError):
            continue
        raise AssertionError


def test_reveal(spark, tmp_path):
    df = spark.range(2000)
    for seed in (None, 4):
        tables.reveal(df, f"{tmp_path}/{seed}", seed=seed)
    plain, mixed = ([r.id for r in spark.read.parquet(f"{tmp_path}/{seed}").collect()] for seed in (None, 4))
    assert sorted(plain) == sorted(mixed) == list(range(2000)) and plain != mixed
    assert sum(abs(a - b) for a, b in zip(mixed, mixed[1:])) > 2000 * 300  # neighbours are far apart


def test_drivers(spark):
    from ledgerloom.ml import drivers

    sizes = dict(rows=200, features=4, batch=50, iterations=16, test_rows=100)
    assert drivers.linear(spark, rate=0.5, **sizes)["error"] < 2.0
    assert drivers.logistic(spark, rate=1.0, **sizes)["accuracy"] > 0.8
