import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import special as SP
from tablewright.operators import correlate as K
from tablewright.operators import explore as E
from tablewright.operators import fit as Fi
from tablewright.operators import rank as RK
from tablewright.operators import regress as G
from tablewright.operators import spectrum as T


def test_normal_columns_match_stdlib(spark):
    nd = NormalDist()
    ps = [1e-12, 1e-5, 0.01, 0.2, 0.5, 0.77, 0.975, 1 - 1e-9]
    xs = [-40.0, -8.0, -3.1, -0.4, 0.0, 1.0, 2.5, 7.5]
    df = spark.createDataFrame(list(zip(ps, xs)), "p double, x double")
    got = df.select(SP.qnorm_col(F.col("p")).alias("q"), SP.pnorm_col(F.col("x")).alias("c")).collect()
    for (p, x), r in zip(zip(ps, xs), got):
        assert r["q"] == pytest.approx(nd.inv_cdf(p), rel=1e-14, abs=1e-14)
        assert r["c"] == pytest.approx(nd.cdf(x), rel=1e-12, abs=1e-15)


def test_driver_special_functions():
    assert SP.qt(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert SP.pt_two_sided(2.0, 5) == pytest.approx(0.1019394788, rel=1e-8)
    assert SP.pgamma(2.0, 3.0) == pytest.approx(0.3233235838, rel=1e-9)
    assert SP.digamma(1.0) == pytest.approx(-0.5772156649, rel=1e-9)


def _avg_rank(a):
    order = np.argsort(a, kind="mergesort")
    r = np.empty(len(a))
    r[order] = np.arange(1, len(a) + 1)
    for v in np.unique(a):
        m = a == v
        r[m] = r[m].mean()
    return r


def _kendall_brute(x, y):
    n = len(x)
    s = c1 = c2 = 0
    for i in range(n):
        for j in range(i + 1, n):
            dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s += dx * dy
            c1 += dx != 0
            c2 += dy != 0
    return s / math.sqrt(c1 * c2)


@pytest.mark.parametrize("bucketed", [False, True])
def test_correlations_against_brute_force(spark, monkeypatch, bucketed):
    if bucketed:
        monkeypatch.setattr(RK, "TARGET_BUCKET_ROWS", 9)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 8, 120).astype(float)
    y = np.round(x + rng.normal(0, 3, 120))
    z = np.full(120, 2.0)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)], "x double, y double, z double")
    pe = {(r["var1"], r["var2"]): r["corr"] for r in K.corr_pearson(df).collect()}
    assert pe[("x", "y")] == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-12)
    assert pe[("x", "z")] is None and pe[("z", "z")] is None and pe[("x", "x")] == 1.0
    sp = {(r["var1"], r["var2"]): r["corr"] for r in K.corr_spearman(df, ["x", "y"]).collect()}
    assert sp[("x", "y")] == pytest.approx(np.corrcoef(_avg_rank(x), _avg_rank(y))[0, 1], rel=1e-12)
    tau, n = K.kendall_pairs(df, ["x", "y"])[0, 1]
    assert n == 120 and tau == pytest.approx(_kendall_brute(x, y), rel=1e-12)


def test_spearman_pairwise_missing(spark):
    rows = [(1.0, 5.0), (2.0, None), (3.0, 1.0), (4.0, 2.0), (None, 3.0), (6.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = {(x["var1"], x["var2"]): x for x in K.corr_spearman(df).collect()}
    a = np.array([1, 3, 4, 6.0])
    b = np.array([5, 1, 2, 9.0])
    assert r[("a", "b")]["n"] == 4
    assert r[("a", "b")]["corr"] == pytest.approx(np.corrcoef(_avg_rank(a), _avg_rank(b))[0, 1])


def test_histogram_density_box_qq(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(10, 2, 400)
    df = spark.createDataFrame([(float(v), "g" if i % 2 else "h") for i, v in enumerate(x)], "x double, g string")
    h = E.histogram(df, "x", 30).collect()
    assert sum(r["count"] for r in h) == 400 and len(h) == 30
    lo, hi = x.min(), x.max()
    w = (hi - lo) / 29
    assert h[0]["x"] == pytest.approx(lo) and h[-1]["x"] == pytest.approx(hi)
    d = E.density(df, "x").orderBy("idx").collect()
    bw = 0.9 * min(np.std(x, ddof=1), np.subtract(*np.percentile(x, [75, 25])) / 1.34) * 400 ** -0.2
    g = np.linspace(lo, hi, 512)
    brute = np.exp(-0.5 * ((g[:, None] - x[None, :]) / bw) ** 2).sum(1) / (400 * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in d], brute, rtol=1e-4, atol=1e-7)
    dg = E.density(df, "x", by="g").collect()
    assert len(dg) == 1024
    b = E.boxplot_stats(df, "x").first()
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert (b["q1"], b["median"], b["q3"]) == pytest.approx((q1, med, q3))
    assert b["whisker_low"] == inside.min() and b["n_outliers"] == 400 - len(inside)
    qq = E.qq_points(df, "x").orderBy("position").collect()
    assert len(qq) == 400 and qq[0]["sample"] == x.min()
    assert qq[9]["theoretical"] == pytest.approx(NormalDist().inv_cdf((10 - 0.5) / 400))


def test_qq_chunking_of_hot_values(spark, monkeypatch):
    monkeypatch.setattr(E, "QQ_CHUNK", 7)
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 3, "x double")
    pos = sorted(r["position"] for r in E.qq_points(df, "x").collect())
    assert pos == list(range(1, 54))


def test_periodogram_peak_and_dft(spark):
    n = 200
    t = np.arange(n)
    x = np.sin(2 * np.pi * t * 10 / n) + 0.01 * t
    rows = T.periodogram(spark.createDataFrame([("s", int(i), float(v)) for i, v in zip(t, x)], "series string, t long, value double")).collect()
    freq, spec = [r["frequency"] for r in rows], [r["power"] for r in rows]
    assert T.nextn(200) == 200 and T.nextn(7) == 8 and T.nextn(121) == 125
    assert freq[np.argmax(spec)] == pytest.approx(10 / n)
    assert list(T.daniell_weights((3, 5)) * 32) == pytest.approx([1, 4, 7, 8, 7, 4, 1])


def test_fits_and_ks(spark):
    rng = np.random.default_rng(12)
    x = rng.gamma(2.5, 2.0, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    norm = Fi.fit_family(df, "x", "norm")
    assert norm.params["mean"] == pytest.approx(x.mean()) and norm.params["sd"] == pytest.approx(x.std())
    ll = lambda k, b: np.sum(k * np.log(b) - math.lgamma(k) + (k - 1) * np.log(x) - b * x)
    g = Fi.fit_family(df, "x", "gamma")
    k, b = g.params["shape"], g.params["rate"]
    assert g.loglik == pytest.approx(ll(k, b), rel=1e-10)
    for dk, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert ll(k + dk, b + db) < g.loglik
    w = Fi.fit_family(df, "x", "weibull")
    kk, lam = w.params["shape"], w.params["scale"]
    llw = lambda k, l: np.sum(np.log(k / l) + (k - 1) * np.log(x / l) - (x / l) ** k)
    assert w.loglik == pytest.approx(llw(kk, lam), rel=1e-9)
    for dk, dl in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert llw(kk + dk, lam + dl) < w.loglik
    d, n = Fi.ks_statistic(df, "x", norm)
    xs = np.sort(x)
    cdf = np.array([NormalDist(norm.params["mean"], norm.params["sd"]).cdf(v) for v in xs])
    brute = max(np.max(np.arange(1, n + 1) / n - cdf), np.max(cdf - np.arange(n) / n))
    assert d == pytest.approx(brute, rel=1e-9)


def test_influence_matches_leave_one_out(spark):
    rng = np.random.default_rng(21)
    n = 40
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * x1 - x2 + rng.normal(size=n)
    y[3] += 6
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))],
                               "id long, x1 double, x2 double, y double")
    m = G.ols_fit(df, "y", ["x1", "x2", "y"])
    X = np.column_stack([np.ones(n), x1, x2])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert [m.intercept, *m.coef] == pytest.approx(beta)
    d = {r["id"]: r for r in G.diagnostics(df, m, ["id"]).collect()}
    assert sum(r["leverage"] for r in d.values()) == pytest.approx(3.0)
    p = 3
    s2 = np.sum((y - X @ beta) ** 2) / (n - p)
    for i in (0, 3, 17):
        keep = np.arange(n) != i
        bi, *_ = np.linalg.lstsq(X[keep], y[keep], rcond=None)
        cook = np.sum((X @ beta - X @ bi) ** 2) / (p * s2)
        si2 = np.sum((y[keep] - X[keep] @ bi) ** 2) / (n - 1 - p)
        dff = (X[i] @ beta - X[i] @ bi) / math.sqrt(si2 * d[i]["leverage"])
        assert d[i]["cooks_distance"] == pytest.approx(cook, rel=1e-9)
        assert d[i]["dffits"] == pytest.approx(dff, rel=1e-9)
    inf = {r["id"]: r for r in G.influence(df, m, ["id"]).collect()}
    assert inf[3]["influential"] and inf[3]["status"] in (G.STATUS_INFLUENCE, G.STATUS_BOTH)
    m2, rest = G.ols_refit(df, "y", ["x1", "x2"])
    assert m2.n == rest.count() < n
    with pytest.raises(ValueError):
        G.ols_fit(df, "y", ["y"])


def test_summary_logical_and_other(spark):
    import datetime as dt

    df = spark.createDataFrame([(True, "apple", dt.datetime(2024, 1, 1)), (False, "apple", dt.datetime(2024, 1, 3)),
                                (None, "banana", None), (True, None, dt.datetime(2024, 1, 2))],
                               "b boolean, f string, t timestamp")
    lg = E.summary_logical(df).first()
    assert (lg["n_missing"], lg["n_true"], lg["n_false"]) == (1, 2, 1) and lg["mean"] == pytest.approx(2 / 3)
    other = {r["column"]: r for r in E.summary_other(df, factor_cols=["f"], time_cols=["t"]).collect()}
    assert other["f"]["top_counts"] == "app: 2, ban: 1"
    assert other["t"]["median"] == "2024-01-02 00:00:00" and other["t"]["n_missing"] == 1


def test_top_counts_ties_beyond_k(spark):
    vals = ["a"] * 3 + ["b"] * 3 + ["c"] * 3 + ["e"] * 2 + ["d"] * 2 + ["f"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [(r["value"], r["count"]) for r in E.top_counts(df, ["s"]).orderBy("rank").collect()]
    assert got == [("a", 3), ("b", 3), ("c", 3), ("d", 2)]


def test_summary_string_at_any_width(spark):
    df = spark.createDataFrame([("a", None), ("b", " "), ("a", ""), (None, "x")], "s string, t string")
    narrow = [tuple(r) for r in E.summary_string(df).collect()]
    wide = df.select("*", *[F.lit(f"v{k}").alias(f"c{k}") for k in range(20)])
    assert [tuple(r) for r in E.summary_string(wide).collect()][:2] == narrow
    assert narrow[0][6] == 2 and narrow[1][6] == 3 and narrow[1][7] == 1
