import numpy as np
import pytest

from tablewright.operators import rank as RK


def _np_type7(x, p):
    return float(np.percentile(np.asarray(x, dtype=float), p * 100, method="linear"))


@pytest.fixture
def tiny_buckets(monkeypatch):
    # force the bucketed path (several buckets, parallel windows) on tiny inputs
    monkeypatch.setattr(RK, "TARGET_BUCKET_ROWS", 7)


def _data(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    vals = np.round(rng.exponential(10, n), 1)  # many ties
    grp = rng.choice(["a", "b", None], n)
    rows = [(float(v) if i % 17 else None, g) for i, (v, g) in enumerate(zip(vals, grp))]
    return spark.createDataFrame(rows, "x double, g string"), rows


@pytest.mark.parametrize("bucketed", [False, True])
def test_ranked_counts_match_numpy(spark, request, bucketed):
    if bucketed:
        request.getfixturevalue("tiny_buckets")
    df, rows = _data(spark)
    got = {(r["g"], r["value"]): (r["cnt"], r["before"], r["total"])
           for r in RK.ranked_counts(df, "x", by=["g"]).collect()}
    for g in ("a", "b", None):
        xs = np.array([x for x, gg in rows if gg == g and x is not None])
        for v in np.unique(xs):
            assert got[(g, float(v))] == (int((xs == v).sum()), int((xs < v).sum()), len(xs))


@pytest.mark.parametrize("bucketed", [False, True])
def test_quantiles_type7(spark, request, bucketed):
    if bucketed:
        request.getfixturevalue("tiny_buckets")
    df, rows = _data(spark, seed=2)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r for r in RK.quantiles_long(df, ["x"], probs, by=["g"]).collect()}
    for g in ("a", "b", None):
        xs = [x for x, gg in rows if gg == g and x is not None]
        for i, p in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(_np_type7(xs, p), rel=1e-12)


def test_median_midpoint_and_partition_invariance(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert RK.quantile_map(df, ["x"], [0.5])["x"] == [1.5]
    big = spark.createDataFrame([(float(i % 37),) for i in range(500)], "x double")
    base = RK.quantile_map(big, ["x"], [0.1, 0.5, 0.9])
    for parts in (1, 4, 17):
        assert RK.quantile_map(big.repartition(parts), ["x"], [0.1, 0.5, 0.9]) == base


def test_positions_unique(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long")
    pos = sorted(r["_pos"] for r in RK.positions(df, "k").collect())
    assert pos == list(range(1, 102))


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz", "date", "string", "decimal(20,4)", "bigint", "double", "boolean"])
def test_many_buckets_rank_every_type(spark, dtype):
    """The same ranks in one bucket and in many, whatever the type; equal to a plain window's."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ids = spark.range(400).select(((F.col("id") * 7919) % 173).alias("v"))
    base = {"timestamp": F.timestamp_seconds(F.col("v") * 1801 + 1698500000),
            "timestamp_ntz": F.timestamp_seconds(F.col("v") * 1801 + 1698500000).cast("timestamp_ntz"),
            "date": F.date_add(F.lit("1969-06-01").cast("date"), F.col("v").cast("int") * 3),
            "string": F.concat(F.lit("common prefix "), F.repeat(F.lit("é"), F.pmod(F.col("v"), F.lit(3)).cast("int")), F.hex("v")),
            "boolean": F.col("v") % 2 == 0}.get(dtype, (F.col("v") - 80).cast(dtype))
    df = ids.select(base.alias("x"))
    w = Window.orderBy("x")
    want = {r["x"]: r["b"] for r in df.select("x", (F.rank().over(w) - 1).alias("b")).distinct().collect()}
    for target in (10_000, 9):
        got = {r["value"]: r["before"] for r in RK.ranked_counts(df, "x", target_rows=target).collect()}
        assert got == want
