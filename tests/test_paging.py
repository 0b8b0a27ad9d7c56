"""Pages of a sorted table through the index: every page against one sort."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tablewright.sources import paging


def test_pages_equal_the_sort(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([None, 1.5, 1.5, float(rnd.randrange(90))]), rnd.choice([None, "a", "b", "ü"]), dt.datetime(2020, 1, 1 + rnd.randrange(3)), [k]) for k in range(1_500)]
    df = spark.createDataFrame(rows, "id bigint, x double, s string, t timestamp_ntz, a array<int>").repartition(5)
    for order, down in ((["x", "s"], [False, True]), (["s", "x"], [True, False]), (["t", "x"], [True, True]), (["x"], [False])):
        index = paging.PageIndex(df, order, down, leaf_rows=60)
        sort = [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(order, down, strict=True)]
        want = [tuple(r[c] for c in order) for r in df.orderBy(*sort).collect()]
        got = [r for page in range(1, 9) for r in index.page(page, 200).collect()]
        assert [tuple(r[c] for c in order) for r in got] == want
        assert sorted(r.id for r in got) == list(range(1_500))  # ties stand in one order on all pages
        assert index.page(9, 200).count() == 0
        passes = index.passes
        assert index.page(4, 200).count() == 200 and index.passes == passes  # known nodes cost nothing


def test_a_deep_page_sorts_one_leaf(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.lit("t").alias("s"))
    index = paging.PageIndex(df, ["k"], leaf_rows=5_000)
    page = index.page(10_001, 15)
    assert [r.k for r in page.collect()] == list(range(150_000, 150_015))
    leaf = index._leaf(150_000)
    assert leaf.rows <= 5_000 and leaf.before > 140_000
    # the first page of the same table is a top-k in the same order
    assert paging.page_table(df, order_by=["k"], page=2, page_size=5).collect()[0].k == 5


def test_hot_ties_equal_rows_and_empty_tables(spark):
    hot = spark.range(3_000).select(F.lit(1).alias("x"), "id")
    index = paging.PageIndex(hot, ["x"], leaf_rows=200)
    got = [r.id for page in range(1, 31) for r in index.page(page, 100).collect()]
    assert sorted(got) == list(range(3_000)) and index._leaf(2_000).rows <= 200
    equal = spark.range(1_000).select(F.lit(1).alias("x"))
    assert paging.page_table(equal, order_by=["x"], page=9, page_size=100, leaf_rows=10).count() == 100
    assert paging.page_table(equal.limit(0), order_by=["x"], page=9, leaf_rows=10).count() == 0
    nulls = equal.select(F.lit(None).cast("int").alias("x"))
    assert paging.page_table(nulls, order_by=["x"], descending=[True], page=4, page_size=10, leaf_rows=10).count() == 10
