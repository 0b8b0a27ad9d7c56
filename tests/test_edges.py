"""Cases on which an operator once failed or answered wrongly."""

import csv
import glob
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import special as SP
from tablewright.functions.rounding import round_dp
from tablewright.operators import clean as C
from tablewright.operators import correlate as K
from tablewright.operators import explore as E
from tablewright.operators import features as D
from tablewright.operators import fit as Fi
from tablewright.operators import moments as M
from tablewright.operators import profile as P
from tablewright.operators import regress as G
from tablewright.operators import spectrum as T
from tablewright.sources import readers as R


def test_round_dp_keeps_large_values_and_drops_nan(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 1e17), (2, float("inf")), (3, -1e16), (4, 0.125), (5, None)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(round_dp(F.col("x"), 2)).collect()]
    assert got == [None, 1e17, float("inf"), -1e16, 0.13, None]


def test_full_leverage_and_perfect_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), float(rng.normal()), 1.0 if i == 7 else 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, y double, x double, d double")
    m = G.ols_fit(df, "y", ["x", "d"])
    row = {r["i"]: r for r in G.influence(df, m, ["i"]).collect()}[7]
    assert row["leverage"] == 1.0 and row["cooks_distance"] is None and row["std_residual"] is None and row["dffits"] is None
    assert not row["influential"] and row["high_leverage"] and row["status"] == G.STATUS_LEVERAGE
    assert 7 in [r["i"] for r in G.remove_influential(df, m).select("i").collect()]
    exact = spark.createDataFrame([(i, 2.0 * i, float(i)) for i in range(20)], "i long, y double, x double")
    got = G.influence(exact, G.ols_fit(exact, "y", ["x"]), ["i"]).collect()
    assert len(got) == 20


def test_differently_scaled_predictors(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.uniform(0, 5e9, 500), rng.uniform(0, 0.1, 500)])
    y = 3 + x @ np.array([1e-9, 20.0]) + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = G.ols_fit(df, "y", ["a", "b"])
    want = np.linalg.lstsq(np.column_stack([np.ones(500), x[:, 0] / 1e9, x[:, 1]]), y, rcond=None)[0]
    assert m.coef[0] == pytest.approx(want[1] / 1e9, rel=1e-6) and m.coef[1] == pytest.approx(want[2], rel=1e-6)
    # a predictor that depends on those before it is left out and shown without values
    same = G.ols_fit(df.withColumn("c", F.col("a") * 2), "y", ["a", "c", "b"])
    assert same.predictors == ["a", "b"] and same.coef == pytest.approx(m.coef, rel=1e-9)
    table = same.coef_table()
    assert [r[0] for r in table] == ["(Intercept)", "a", "c", "b"] and table[2][1:] == (None,) * 4
    assert [table[i][1:] for i in (0, 1, 3)] == [pytest.approx(r[1:], rel=1e-8) for r in m.coef_table()]


def test_formula_overflow_nan_and_nested_aggregates(spark):
    df = spark.createDataFrame([(2_000_000_000, 2_000_000_000, 2**60 + 1, -1.0), (1, 0, 5, 4.0)], "a int, b int, big long, x double")
    before = spark.conf.get("spark.sql.ansi.enabled")
    got = D.formula(df, "p", "a * b").orderBy("a").collect()
    assert [r["p"] for r in got] == [0.0, 4e18] and [r["big"] for r in got] == [5, 2**60 + 1]
    assert [r["s"] for r in D.formula(df, "s", "sqrt(x)").orderBy("a").collect()] == [2.0, None]
    assert [r["q"] for r in D.formula(df, "q", "a / b").orderBy("a").collect()] == [None, 1.0]
    assert D.formula(df, "m", "mean(abs(x - mean(x)))").first()["m"] == 2.5
    assert D.formula(df, "a", "a + median(x)").orderBy("b").first()["a"] == 2.5
    assert spark.conf.get("spark.sql.ansi.enabled") == before and D.formula(df, "p", "a * b").join(df, "a").count() == 2


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", ' {"k": "v"} ', "plain", "a\\b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    path = f"{tmp_path}/t.csv"
    R.write_csv(df.coalesce(1), path)
    back = R.load(spark, path, multi_line=True)
    assert [r["t"] for r in back.orderBy("i").collect()] == texts
    with open(glob.glob(f"{path}/part-*.csv")[0], newline="") as f:
        assert [r[1] for r in csv.reader(f)][1:] == texts


def test_json_array_files(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert {(r["a"], r["b"]) for r in R.load(spark, str(path)).collect()} == {(1, "x"), (2, None)}


def test_profile_counts_typed_values_at_any_width(spark):
    df = spark.createDataFrame([(["a, b"], 1.0), (["a", "b"], 1.5), (None, -0.0), (None, 0.0)], "v array<string>, x double")
    narrow = {r["column"]: r["n_unique"] for r in P.column_profile(df).collect()}
    wide = df.select("*", *[F.lit(k).alias(f"c{k}") for k in range(25)])
    assert narrow == {"v": 3, "x": 3}
    assert {r["column"]: r["n_unique"] for r in P.column_profile(wide).collect() if r["column"] in narrow} == narrow
    auto = spark.sql("SELECT explode(array(timestamp'2023-11-05 05:30:00Z', timestamp'2023-11-05 06:30:00Z')) AS t")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert P.column_profile(auto).first()["n_unique"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("kind", ["bigint", "timestamp_ntz", "date", "string"])
def test_missing_map_keeps_rows_without_an_order_value(spark, kind):
    value = {"bigint": F.col("id"), "timestamp_ntz": F.timestamp_seconds("id").cast("timestamp_ntz"),
             "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "string": F.lpad(F.col("id").cast("string"), 6, "0")}[kind]
    df = spark.range(50).select(F.when(F.col("id") < 40, value).alias("k"), F.when(F.col("id") >= 5, 1).alias("v"))
    got = {(r["block"], r["column"]): r for r in P.missing_map(df, "k", blocks=10).collect()}
    assert sum(r["n_rows"] for (b, c), r in got.items() if c == "v") == 50
    assert got[0, "v"]["missing_rate"] == 1.0 and got[1, "v"]["missing_rate"] == 0.0 and got[8, "k"]["missing_rate"] == 1.0


def test_all_columns_of_the_long_form(spark):
    df = spark.range(3).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(11)])
    assert C.long_numeric(df).select("variable").distinct().count() == 11
    assert C.onehot_long(df.select("id" if "id" in df.columns else "c1", "c2"), ["c1"], ["c2"]).count() == 3


def test_t_quantile_far_out_and_large_degrees_of_freedom():
    assert SP.qt(0.99995, 1) == pytest.approx(math.tan(math.pi * 0.49995), rel=1e-6)
    assert SP.pt_two_sided(1.959963984540054, 1e12) == pytest.approx(0.05, rel=1e-8)
    assert SP.qt(0.975, 5e6) == pytest.approx(1.959964, rel=1e-6)


def test_gamma_arrays():
    x = np.array([0.0, 0.1, 1.0, 2.5, 9.0, 50.0, np.nan])
    assert np.allclose(SP.pgamma_array(x, 1.0, 0.5)[:6], 1 - np.exp(-0.5 * x[:6]), rtol=1e-13) and np.isnan(SP.pgamma_array(x, 1.0, 0.5)[6])
    for a in (0.3, 1.0, 4.5, 250.0):
        p = np.array([1e-6, 0.01, 0.3, 0.5, 0.99, 1 - 1e-9])
        assert np.allclose(SP.pgamma_array(SP.qgamma_array(p, a, 2.0), a, 2.0), p, rtol=1e-9, atol=1e-13)
        want = [SP.pgamma(v, a, 2.0) for v in (0.05, a / 2, a)]
        assert np.allclose(SP.pgamma_array(np.array([0.05, a / 2, a]), a, 2.0), want, rtol=1e-10)


def test_gof_of_every_family_has_quantiles(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.gamma(2.0, 3.0, 300)], "x double")
    got = Fi.gof_many(df, "x", Fi.fit_all(df, "x")).collect()
    assert len(got) == 300 * 5 and all(r["fitted_quantile"] is not None and 0 <= r["fitted_cdf"] <= 1 for r in got)
    gamma = sorted((r["position"], r["sample"], r["fitted_quantile"]) for r in got if r["distribution"] == "gamma")
    assert np.corrcoef([g[1] for g in gamma], [g[2] for g in gamma])[0, 1] > 0.98
    layers = {r["layer"] for r in Fi.density_overlay(df, "x").select("layer").distinct().collect()}
    assert len(layers) == 6


def test_bootstrap_takes_any_id(spark):
    rows = [(2**40 + i * 2**32, f"k{i}", float(i % 17) ** 1.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, x double")
    ks = [{r["kurtosis"] for r in Fi.cullen_frey_boot(df, "x", c, reps=30).collect()} for c in ("id", "name")]
    assert all(len(k) > 25 for k in ks)  # rows 2**32 apart don't share their weights


def test_all_missing_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    assert all(r["loglik"] is None for r in D.boxcox_profile(df, "x").collect())
    assert D.transform(df, "x", "boxcox").first()["x_boxcox"] is None
    assert Fi.cullen_frey(df, "x").first()["skewness"] is None
    with pytest.raises(ValueError):
        E.trend_line(df, "x", "y")
    with pytest.raises(ValueError):
        E.trend_line(df.withColumn("x", F.lit(3.0)), "x", "y")


def test_kendall_sums_outgrow_64_bits(spark):
    big = 4_000_000_000
    d = spark.createDataFrame([(0, 0, 0, big), (0, big, big, big), (0, 2 * big, 2 * big, 1)], "pair int, rx long, ry long, cnt long")
    tau, n = K.kendall_from_counts(d, [(0, 1)])[0, 1]
    assert n == 2 * big + 1 and tau == pytest.approx(1.0, rel=1e-12)


def test_spearman_with_gaps_everywhere(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (150, 4)).astype(float)
    gaps = rng.random((150, 4)) < 0.2
    rows = [tuple(None if g else float(v) for v, g in zip(r, gr)) for r, gr in zip(x, gaps)]
    got = {(r["var1"], r["var2"]): r["corr"] for r in K.corr_spearman(spark.createDataFrame(rows, "a double, b double, c double, d double")).collect()}

    def ranks(v):
        return np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])

    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            if i < j:
                both = ~gaps[:, i] & ~gaps[:, j]
                assert got[a, b] == pytest.approx(np.corrcoef(ranks(x[both, i]), ranks(x[both, j]))[0, 1], rel=1e-12)


def test_shapiro_on_all_rows_equals_the_direct_sum(spark):
    rng = np.random.default_rng(5)
    for n in (3, 5, 6, 800):
        x = np.round(rng.normal(0, 3, n), 1)
        got = M.shapiro_wilk(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"]).first()
        w, p = M.shapiro_wilk_values(x)
        assert got["n"] == n and got["w"] == pytest.approx(w, rel=1e-7) and got["p_value"] == pytest.approx(p, rel=1e-4)


@pytest.mark.parametrize("n", [11, 97, 360])
def test_periodogram_equals_one_long_transform(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, t long, value double")
    t = np.arange(1, n + 1) - (n + 1) / 2
    y = x - x.mean() - (x @ t) * t / (n * (n * n - 1) / 12)
    m = int(n * T.TAPER)
    w = 0.5 * (1 - np.cos(np.pi * np.arange(1, 2 * m, 2) / (2 * m)))
    y[:m] *= w
    y[n - m:] *= w[::-1]
    size = T.nextn(n)
    power = np.abs(np.fft.fft(np.concatenate([y, np.zeros(size - n)]))) ** 2 / n
    got = T.periodogram(df).orderBy("freq_index").collect()
    assert np.allclose([r["power"] for r in got], power[1:size // 2 + 1] / (1 - 1.25 * T.TAPER), rtol=1e-9)
    power[0] = power[1]
    k = T.daniell_weights((3, 5))
    smooth = sum(v * np.roll(power, len(k) // 2 - j) for j, v in enumerate(k))
    got = T.periodogram(df, spans=(3, 5)).orderBy("freq_index").collect()
    assert np.allclose([r["power"] for r in got], smooth[1:size // 2 + 1] / (1 - 1.25 * T.TAPER), rtol=1e-9)


def test_grid_in_chunks_is_whole(spark, monkeypatch):
    monkeypatch.setattr(T, "GRID_CHUNK", 7)
    df = spark.range(0, 100, 33).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    got = T.bucket_series(df, "ts").orderBy("t").collect()
    assert len(got) == 100 and sum(r["value"] for r in got) == 4 and len({r["t"] for r in got}) == 100


def test_pairs_panel_parts(spark):
    df = spark.range(200).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.col("id").cast("double").alias("c"))
    got = E.pairs_panel(df, ["a", "b", "c"], bins=5, n_grid=16).groupBy("part", "var1", "var2").agg(F.sum("value").alias("s")).collect()
    assert sum(r["part"] == "corr" for r in got) == 3 and sum(r["part"] == "density" for r in got) == 3
    assert [r["s"] for r in got if r["part"] == "points"] == [200.0] * 3


def test_nothing_stays_cached(spark):
    spark.catalog.clearCache()
    df = spark.range(300).select((F.col("id") % 23).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    E.density(df, "x", by="g").collect()
    E.summary_numeric(df).collect()
    E.qq_points(df, "x").collect()
    C.encode_label(df.withColumn("s", F.col("g").cast("string")), ["s"]).collect()
    Fi.fit_compare(df.withColumn("x", F.col("x") + 1), "x").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
