"""Exact distribution of the Kolmogorov-Smirnov statistic of small untied samples."""

from __future__ import annotations

import numpy as np
import pytest

from tablewright.functions.special import kolmogorov_exact, kolmogorov_upper
from tablewright.operators import fit


def test_closed_forms_and_critical_values():
    for d in (0.5, 0.6, 0.75, 0.99):
        assert kolmogorov_exact(1, d) == pytest.approx(2 * (1 - d))
    # fixed values: published 5 % points
    for n, d in ((5, 0.56328), (10, 0.40925), (20, 0.29408)):
        assert kolmogorov_exact(n, d) == pytest.approx(0.05, abs=2e-5)
    assert kolmogorov_exact(7, 0) == kolmogorov_exact(7, 0.07) == 1 and kolmogorov_exact(7, 1.0) == 0
    assert kolmogorov_exact(99, 0.1) == pytest.approx(kolmogorov_upper(0.1 * 99**0.5), abs=0.03)


@pytest.mark.parametrize("n", [2, 13, 60])
def test_against_simulation(n):
    u = np.sort(np.random.default_rng(n).random((100_000, n)), axis=1)
    i = np.arange(1, n + 1) / n
    d = np.maximum(i - u, u - i + 1 / n).max(axis=1)
    for q in (0.2, 0.6, 0.95):
        at = float(np.quantile(d, q))
        assert kolmogorov_exact(n, at) == pytest.approx(1 - q, abs=0.006)


def test_only_small_untied_samples(spark):
    model = fit.fit_family(spark.createDataFrame([(float(i),) for i in range(1, 31)], "x double"), "x", "norm")
    small = spark.createDataFrame([(float(i),) for i in range(1, 31)], "x double")
    got = fit.ks_test(small, "x", model)
    assert got["p_exact"] == pytest.approx(kolmogorov_exact(30, got["statistic"]))
    assert fit.ks_test(small.unionByName(small.limit(1)), "x", model)["p_exact"] is None
