import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean as C
from tablewright.operators import profile as P
from tablewright.plans.cleaning import CleaningSpec


def test_profile_counts_null_as_value_and_alerts(spark):
    rows = [(1, "a", 5.0, None), (2, "b", 5.0, None), (3, None, 5.0, 1.0), (4, "d", 5.0, None)]
    df = spark.createDataFrame(rows, "`Sepal.Length` long, name string, const double, sparse double")
    prof = {r["column"]: r for r in P.column_profile(df).collect()}
    assert prof["name"]["n_unique"] == 4  # a, b, d + NULL
    assert prof["name"]["alert"] == P.ALERT_OVER_20  # 25 % missing
    assert prof["const"]["alert"] == P.ALERT_CONSTANT
    assert prof["sparse"]["pct_missing"] == 75.0 and prof["sparse"]["alert"] == P.ALERT_OVER_50
    assert prof["Sepal.Length"]["alert"] == P.ALERT_OK  # all unique but numeric


def test_id_like_alert_and_summary(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "code string")
    assert P.column_profile(df).first()["alert"] == P.ALERT_ID_LIKE
    s = P.dataset_summary(spark.createDataFrame([(1, None), (None, "a")], "a long, b string")).first()
    assert (s["n_rows"], s["n_cols"], s["n_numeric"], s["missing_cells"], s["pct_missing"]) == (2, 2, 1, 2, 50.0)


def test_missing_rows_schema_order(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, 1.0, "x")], "id long, b double, a string")
    got = [(r["id"], r["n_missing"], r["missing_columns"]) for r in P.missing_rows(df, "id").collect()]
    assert got == [(1, 2, "b, a"), (2, 1, "a")]


def test_impute_median_mode_categorical(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, None), (2.0, "b"), (1.0, "a")], "x double, s string")
    med, n = C.impute(df, "median")
    assert n == 2
    vals = [r["x"] for r in med.collect()]
    assert vals[2] == 1.5
    mode, _ = C.impute(df, "mode")
    r = mode.collect()[2]
    assert r["x"] == 1.0 and r["s"] == "a"  # ties go to the smallest value


def test_scaling_edge_cases(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (None, 3.0), (3.0, 10.0)], "c double, x double")
    mm = C.scale(df, "minmax").collect()
    assert [r["c"] for r in mm] == [0.0, 0.0, None, 0.0]
    z = np.array([r["x"] for r in C.scale(df, "zscore").collect()])
    assert abs(z.mean()) < 1e-12 and abs(z.std(ddof=1) - 1) < 1e-12
    rob = [r["x"] for r in C.scale(df, "robust", ["x"]).collect()]
    q1, q2, q3 = np.percentile([1, 2, 3, 10], [25, 50, 75])
    assert rob == pytest.approx([(v - q2) / (q3 - q1) for v in [1, 2, 3, 10]])
    rob_c = [r["c"] for r in C.scale(df, "robust", ["c"]).collect()]
    assert rob_c == [0.0, 0.0, None, 0.0]  # IQR 0: x - median


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    codes = [r["s"] for r in C.encode_label(df, ["s"]).collect()]
    assert sorted(codes, key=lambda v: (v is None, v)) == [1.0, 1.0, 2.0, 3.0, None]
    oh = C.encode_onehot(df, ["s"])
    assert oh.columns == ["s_a", "s_b", "s_c"]
    assert oh.collect()[2].asDict() == {"s_a": 0.0, "s_b": 0.0, "s_c": 0.0}
    with pytest.raises(ValueError):
        C.encode_onehot(df, ["s"], max_levels=2)


def test_sequential_outlier_removal_matches_loop(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 200)
    a[:5] = 10
    b = rng.exponential(1, 200)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got, removed = C.remove_outliers_sequential(df, "iqr", ["a", "b"])
    keep = np.ones(200, bool)
    for col in (a, b):
        x = col[keep]
        q1, q3 = np.percentile(x, [25, 75])
        out = (col < q1 - 1.5 * (q3 - q1)) | (col > q3 + 1.5 * (q3 - q1))
        keep &= ~out
    assert got.count() == keep.sum() and removed == 200 - keep.sum()


def test_cap_and_pipeline_log(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    capped, n = C.cap_outliers(df, "iqr")
    q1, q3 = np.percentile([1, 2, 3, 4, 100], [25, 75])
    assert n == 1 and max(r["x"] for r in capped.collect() if r["x"] is not None) == q3 + 1.5 * (q3 - q1)
    spec = CleaningSpec(na_strategy="impute", remove_dups=True, outlier_method="iqr", outlier_action="cap")
    _, log = spec.apply(df)
    assert log[0] == "Imputed 1 missing values (numeric: mean, categorical: mode)"
    assert log[-1].endswith("outliers winsorized (iqr method)")
    assert CleaningSpec().apply(df)[1] == ["No changes applied (all settings at default)."]


def test_parallel_removal_differs_from_sequential(spark):
    rows = [(float(v), float(w)) for v, w in zip(range(20), [1] * 18 + [50, 60])] + [(500.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    par, n_par = C.remove_outliers_parallel(df, "iqr")
    seq, n_seq = C.remove_outliers_sequential(df, "iqr")
    assert n_par == 21 - par.count() and n_seq == 21 - seq.count()
    assert par.count() <= 21


def test_wide_profile_matches_narrow(spark):
    rows = [(i, float(i % 3) if i % 4 else None, "ab"[i % 2], -0.0 if i == 1 else 0.0, None) for i in range(12)]
    df = spark.createDataFrame(rows, "a long, b double, c string, z double, n string")
    narrow = {r["column"]: (r["n_unique"], r["n_missing"]) for r in P.column_profile(df).collect()}
    more = df.select("*", *[F.lit(k).alias(f"c{k}") for k in range(20)])
    wide = {r["column"]: (r["n_unique"], r["n_missing"]) for r in P.column_profile(more).collect()}
    assert {c: wide[c] for c in narrow} == narrow and narrow["z"] == (1, 0) and narrow["n"] == (1, 12)
