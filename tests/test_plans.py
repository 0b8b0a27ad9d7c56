"""Plan-shape checks: the properties that matter at scale, asserted on the physical plans."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import explore as E
from tablewright.operators import rank as RK
from tablewright.operators import regress as G


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _opt(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def lineitem(spark, tmp_path):
    rows = [(i, i % 7, float(i % 50 + 1), float(1000 + (i * 37) % 5000), (i % 11) / 100.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, "
                                     "l_extendedprice double, l_discount double")
    path = str(tmp_path / "li.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_filter_and_projection_reach_the_scan(lineitem):
    out = E.filter_range(lineitem.select("l_orderkey", "l_quantity"), "l_quantity", 5.0, 9.0)
    plan = _plan(out)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,5.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_influence_scoring_is_a_narrow_projection(lineitem):
    m = G.ols_fit(lineitem, "l_extendedprice", ["l_quantity", "l_discount"])
    plan = _plan(G.influence(lineitem, m, ["l_orderkey", "l_linenumber"]))
    assert "Exchange" not in plan and "Join" not in plan


def test_large_rankings_never_use_a_single_partition(spark, monkeypatch):
    monkeypatch.setattr(RK, "TARGET_BUCKET_ROWS", 100)
    df = spark.range(5000).select((F.col("id") % 1700).cast("double").alias("x"))
    plan = _plan(RK.ranked_counts(df, "x"))
    # the per-value running count is partitioned by value range ...
    assert "windowspecdefinition(_bucket" in plan
    # ... and the only unpartitioned step is over the per-bucket totals (one row per bucket)
    for line in plan.splitlines():
        if "Window" in line and "_value" in line:
            assert "windowspecdefinition(_bucket" in line


def test_density_has_no_cartesian_or_nested_loop(spark):
    df = spark.createDataFrame([(float(i % 97), "ab"[i % 2]) for i in range(2000)], "x double, g string")
    plan = _plan(E.density(df, "x", by="g"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_box_violin_and_missing_map_do_not_join_raw_rows(lineitem):
    from tablewright.operators import profile as P

    for out in (E.boxplot_stats(lineitem, "l_quantity", by="l_linenumber"), E.violin(lineitem, "l_quantity", by="l_linenumber")):
        joins = [line for line in _opt(out).splitlines() if "Join" in line]
        assert joins and not any("l_quantity" in line for line in joins)
    assert "Join" not in _plan(P.missing_map(lineitem, "l_orderkey"))


def test_sample_is_top_k_without_full_sort(lineitem):
    from tablewright.sources.readers import sample_fixed

    plan = _plan(sample_fixed(lineitem, 10, ["l_orderkey"]))
    assert "TakeOrderedAndProject" in plan
