"""Same answer whatever the input partitioning (1, 4, 17 partitions)."""

import math

import numpy as np
import pytest

from tablewright.operators import clean as C
from tablewright.operators import correlate as K
from tablewright.operators import explore as E
from tablewright.operators import fit as Fi
from tablewright.operators import profile as P


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(np.round(rng.exponential(5), 1)) if i % 9 else None, int(rng.integers(0, 6)),
             "abc"[i % 3]) for i in range(600)]
    return spark.createDataFrame(rows, "id long, x double, k int, s string")


def _rows(df, key):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, v) for v in [t[i] for i in key]))


CASES = {
    "profile": (lambda d: P.column_profile(d).drop("position"), [0]),
    "missing_map": (lambda d: P.missing_map(d, "id", blocks=7), [0, 2]),
    "robust": (lambda d: C.scale(d, "robust", ["x"]), [0]),
    "label": (lambda d: C.encode_label(d, ["s"]), [0]),
    "boxplot": (lambda d: E.boxplot_stats(d, "x", by="s"), [0]),
    "qq": (lambda d: E.qq_points(d, "x"), [0]),
    "spearman": (lambda d: K.corr_spearman(d, ["x", "k"]), [0, 1]),
    "kendall": (lambda d: K.corr_kendall(d, ["x", "k"]), [0, 1]),
    "boot": (lambda d: Fi.cullen_frey_boot(d, "x", "id", reps=20), [0]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_partition_invariance(table, name):
    fn, key = CASES[name]
    base = _rows(fn(table.coalesce(1)), key)
    for parts in (4, 17):
        got = _rows(fn(table.repartition(parts)), key)
        assert len(got) == len(base)
        for a, b in zip(got, base):
            for u, v in zip(a, b):
                if isinstance(u, float) and isinstance(v, float):
                    assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-12)
                else:
                    assert u == v
