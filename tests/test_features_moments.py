import math

import numpy as np
import pytest

from tablewright.operators import features as D
from tablewright.operators import moments as M


def test_equal_width_labels_like_cut(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    out = [r["x_binned"] for r in D.bin_equal_width(df, "x", 3).collect()]
    assert out[0] == "[0.991,4]" and out[3] == "[0.991,4]" and out[4] == "(4,7]" and out[9] == "(7,10]"
    assert out[6] == "(4,7]" and out[7] == "(7,10]"


def test_quantile_bins_and_duplicates(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    codes = [r["x_binned"] for r in D.bin_quantile(df, "x", 4).collect()]
    assert codes == [1, 1, 2, 2, 3, 3, 4, 4]
    dup = spark.createDataFrame([(1.0,)] * 6 + [(2.0,)], "x double")
    with pytest.raises(ValueError):
        D.bin_quantile(dup, "x", 4)


def test_reciprocal_nudge_and_log(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (-1.0,)], "x double")
    rec = [r["x_reciprocal"] for r in D.transform(df, "x", "reciprocal").collect()]
    assert rec[0] == pytest.approx(1e6) and rec[1] == pytest.approx(1 / (2 + 1e-6))
    lg = [r["x_log"] for r in D.transform(df, "x", "log").collect()]
    assert lg[2] is None and lg[1] == pytest.approx(math.log(3))


def test_boxcox_profile_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 3.0, 400) - 2.0  # has non-positive values: shift applies
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    prof = {round(r["lambda"], 6): r["loglik"] for r in D.boxcox_profile(df, "x").collect()}
    xs = x - x.min() + 1 if (x <= 0).any() else x
    gm = np.exp(np.mean(np.log(xs)))
    for lam in (-1.0, 0.0, 0.5, 1.3):
        y = np.log(xs) * gm if abs(lam) < 1e-12 else (xs ** lam - 1) / (lam * gm ** (lam - 1))
        ssr = np.sum((y - y.mean()) ** 2)
        assert prof[round(lam, 6)] == pytest.approx(-len(x) / 2 * np.log(ssr), rel=1e-9)


def test_formula_guard_and_aggregates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "v double")
    out = [r["c"] for r in D.formula(df, "c", "v - mean(v) + median(v) * 0").collect()]
    assert out == pytest.approx([-2.0, -1.0, 3.0])
    for bad in ("java_method('x', 'y')", "v; drop table t", "evil_fn(v)"):
        with pytest.raises(ValueError):
            D.formula(df, "c", bad)


def test_interaction_names(spark):
    df = spark.createDataFrame([(2.0, 0.0)], "a double, b double")
    out = D.interact(D.interact(D.interact(df, "a", "b", "multiply"), "a", "b", "add"), "a", "b", "divide")
    assert out.columns == ["a", "b", "a_x_b", "a_plus_b", "a_per_b"]
    assert out.first()["a_per_b"] == pytest.approx(2e10)


def test_moments_report_rules(spark):
    rng = np.random.default_rng(7)
    x = rng.exponential(1, 500)
    df = spark.createDataFrame([(float(v), 1.0, float(i) if i < 3 else None) for i, v in enumerate(x)],
                               "x double, k double, few double")
    rep = {r["column"]: r for r in M.moments_report(df).collect()}
    m2 = np.mean((x - x.mean()) ** 2)
    sk = np.mean((x - x.mean()) ** 3) / m2 ** 1.5
    assert rep["x"]["skewness"] == pytest.approx(math.floor(sk * 1000 + 0.5) / 1000)
    assert rep["x"]["skew_direction"] == M.DIR_RIGHT
    assert rep["k"]["skew_direction"] == M.DIR_CONSTANT and rep["k"]["skewness"] is None
    assert rep["few"]["skew_direction"] == M.DIR_INSUFFICIENT and rep["few"]["suggestion"] == M.ADV_INSUFFICIENT


def test_shapiro_wilk_behaviour(spark):
    rng = np.random.default_rng(11)
    w, p = M.shapiro_wilk_values(rng.normal(size=200))
    assert 0.97 < w <= 1 and p > 0.01
    w2, p2 = M.shapiro_wilk_values(rng.exponential(size=200))
    assert p2 < 1e-4
    ps = [M.shapiro_wilk_values(rng.normal(size=50))[1] for _ in range(200)]
    assert 0.02 < np.mean(np.array(ps) < 0.05) < 0.1
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=6000))], "id long, x double")
    r = M.shapiro_wilk(df, ["x"], "id", 5000).first()
    assert r["n"] == 5000 and 0 < r["p_value"] <= 1


def test_formula_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    out = [r["r"] for r in D.formula(df, "r", "a / b").collect()]
    assert out == [None, 2.0]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
