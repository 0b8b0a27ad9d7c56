"""Selection of order statistics against sorted lists: ties, nulls, narrow and wrong brackets, any partitioning."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean, profile, rank, select

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def type7(xs, p):
    xs = sorted(xs)
    h = (len(xs) - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return xs[lo] + (h - lo) * (xs[hi] - xs[lo])


def columns(n):
    rnd = random.Random(n)
    return {"even": [rnd.random() for _ in range(n)], "ties": [float(rnd.choice([-1, -1, -1, 0, 2])) for _ in range(n)],
            "gaps": [None if k % 3 else rnd.gauss(0, 1e6) for k in range(n)], "none": [None] * n, "const": [7.5] * n,
            "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(-300, 300) for _ in range(n)], "hot": [0.0 if k % 3 else float(k) for k in range(n)]}


@pytest.mark.parametrize(("n", "accuracy", "move"), [(1, 10_000, 10**6), (2, 10_000, 10**6), (5_000, 10_000, 10**6), (5_000, 50, 20), (5_000, 50, 10**6)])
def test_quantiles_equal_sorting(spark, monkeypatch, n, accuracy, move):
    monkeypatch.setattr(select, "ACCURACY", accuracy)
    monkeypatch.setattr(select, "MOVE_ROWS", move)
    monkeypatch.setattr(select, "BATCH", 3)
    data = columns(n)
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data)).repartition(5)
    found = select.selected(df, list(data), PROBS, [[F.count(F.lit(1))]] * len(data), bins=4)
    for c, xs in data.items():
        known = [x for x in xs if x is not None]
        assert found[c]["n"] == len(known) and found[c]["more"] == [n]
        assert found[c]["q"] == ([type7(known, p) for p in PROBS] if known else [None] * len(PROBS)), c
        assert sum(found[c]["bins"]) == len(known)
    assert rank.quantile_map(df, ["even"], [0.5])["even"] == [type7(data["even"], 0.5)]


def test_a_wrong_sketch_falls_back_to_the_ranking(spark, monkeypatch):
    data = columns(3_000)
    df = spark.createDataFrame([(x,) for x in data["even"]], "even double")
    real = select._sketched

    def wrong(*args):
        out = real(*args)
        for f in out:
            f["brackets"] = [(f["hi"], f["hi"])] * len(f["brackets"])
        return out

    monkeypatch.setattr(select, "_sketched", wrong)
    assert select.selected(df, ["even"], PROBS)["even"]["q"] == [type7(data["even"], p) for p in PROBS]
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).alias("x"))
    got = {(r.block, r.column): r.missing_rate for r in profile.missing_map(rows, "id", blocks=7).collect()}
    monkeypatch.setattr(select, "_sketched", real)
    assert got == {(r.block, r.column): r.missing_rate for r in profile.missing_map(rows, "id", blocks=7).collect()}


@pytest.mark.parametrize("blocks", [1, 7, 100])
def test_block_starts_equal_sorting(spark, blocks):
    rnd = random.Random(blocks)
    for xs in ([rnd.randrange(50) for _ in range(900)], list(range(-3, 40)), [5] * 60, [2**62 + k for k in range(333)], [rnd.choice([0, 0, 0, k]) for k in range(500)]):
        total = len(xs) + 9  # rows without a value come last
        df = spark.createDataFrame([(x,) for x in xs], "x bigint")
        want: dict[int, int] = {}
        for x in sorted(set(xs), reverse=True):
            want[sum(y < x for y in xs) * blocks // total] = x
        assert dict(select.block_starts(df, F.col("x"), len(xs), total, blocks)) == want


def test_no_column_sized_exchange(spark, tmp_path):
    df = spark.range(200_000).select(F.rand(3).alias("x"), F.randn(4).alias("y"))
    df.write.parquet(str(tmp_path / "t"))
    cells = select.counted_cells(*(lambda d, v: (d, v, [f["brackets"] for f in select._sketched(d, v, [0.25, 0.5, 0.75])]))(
        spark.read.parquet(str(tmp_path / "t")), [F.col("x"), F.col("y")]))
    assert cells.count() < 2_000 and cells.agg(F.sum("cnt")).first()[0] == 400_000
    assert clean.iqr_bounds(df, ["x"])["x"].lower < 0
