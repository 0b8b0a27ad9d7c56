import os

import pytest

from tablewright.session import scratch_path
from tablewright.sources import readers as R

SF = "/root/testdata/sf0.001"


def test_csv_roundtrip_na_and_dispatch(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id long, s string, x double")
    path = scratch_path(spark, "t") + "/t.csv"
    R.write_csv(df, path)
    text = "".join(r["value"] + "\n" for r in spark.read.text(path).collect())
    assert "NA" in text
    back = R.load(spark, path).orderBy("id").collect()
    assert back[1]["s"] is None and back[1]["x"] is None and back[0]["x"] == 1.5
    with pytest.raises(ValueError):
        R.load(spark, "/tmp/whatever.xlsx")


def test_json_array_of_records(spark, tmp_path):
    p = tmp_path / "recs.json"
    p.write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    rows = R.load(spark, str(p)).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "x"), (2, None)]


def test_page_and_sample(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "id long, name string")
    page = R.page_table(df, search="N1", order_by=["id"], page=1, page_size=5).collect()
    assert [r["id"] for r in page] == [1, 10, 11, 12, 13]
    s1 = R.sample_fixed(df, 7, ["id"]).collect()
    assert len(s1) == 7 and s1 == R.sample_fixed(df.repartition(3), 7, ["id"]).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    out = entry.entry(spark)
    assert out.count() > 0 and "cooks_distance" in out.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ["column_profile", "clean_pipeline", "bin_quantile", "corr_spearman",
                                  "periodogram_smoothed", "cullen_frey_boot", "influence", "fit_compare",
                                  "ols_full_summary", "normality_test"])
def test_oracle_subset(spark, name):
    """A cross-section of queries against their SQL twins (the full set: tools/check_oracle.py)."""
    import duckdb

    import __spark_entry__ as entry
    from tools.check_oracle import TABLES, canon

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == canon(dcols, cur.fetchall())
