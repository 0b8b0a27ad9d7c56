"""Weibull in two passes, columns that do not vary, and Spearman in batches."""

from __future__ import annotations

import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from tablewright.operators import correlate, fit


def newton(xs, k):
    g = sum(map(math.log, xs)) / len(xs)
    for _ in range(200):
        s0, s1, s2 = (sum(x**k * math.log(x) ** e for x in xs) for e in range(3))
        k -= (s1 / s0 - 1 / k - g) / ((s2 * s0 - s1 * s1) / s0**2 + 1 / k**2)
    return k, (s0 / len(xs)) ** (1 / k)


@pytest.mark.parametrize("draw", ["weibull", "lognormal", "two"])
def test_weibull_equals_newton(spark, monkeypatch, draw):
    rnd = random.Random(draw)
    xs = {"weibull": lambda: rnd.weibullvariate(3, 0.7), "lognormal": lambda: rnd.lognormvariate(5, 2), "two": lambda: rnd.choice([1.0, 1.0, 1.0, 50.0])}[draw]
    xs = [xs() for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = fit.fit_family(df, "x", "weibull")
    k, scale = newton(xs, got.params["shape"] * 1.01)
    assert got.params["shape"] == pytest.approx(k, rel=1e-9) and got.params["scale"] == pytest.approx(scale, rel=1e-9)
    monkeypatch.setattr(fit, "_weibull_start", lambda *a: a[-1])  # plain Newton from the first guess
    assert fit.fit_family(df, "x", "weibull").params["shape"] == pytest.approx(k, rel=1e-9)


def test_a_constant_column_has_no_two_parameter_fit(spark):
    df = spark.range(40).select(F.lit(3.0).alias("x"), F.lit(0.1).alias("y"), F.lit(None).cast("double").alias("none"))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        for c in ("x", "y"):
            assert [f.family for f in fit.fit_all(df, c)] == ["exp"]
    assert sum("do not vary" in str(w.message) for w in said) == 8
    norm = fit.Fit("norm", {"mean": 0.0, "sd": 1.0}, 0.0, 10, 0.0, {}, 0.0)
    assert fit.gof_points(df, "none", norm).count() == 0


def test_spearman_in_batches(spark, monkeypatch):
    df = spark.range(300).select(*[F.when(F.col("id") % 7 != k, F.hash("id", F.lit(k)) % 50).alias(f"c{k}") for k in range(4)])
    rounded = lambda rows: sorted((r[0], r[1], round(r[2], 12), *r[3:]) for r in rows)
    want = rounded(correlate.corr_spearman(df).collect())
    monkeypatch.setattr(correlate, "SPEARMAN_BATCH", 5)
    assert rounded(correlate.corr_spearman(df).collect()) == want
