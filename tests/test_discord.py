"""Discordant pairs by strips: equal to brute force at every depth of splitting, with ties and hot values."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tablewright.operators import correlate as K
from tablewright.operators import discord


def _brute(rows):
    return sum(c * e for x, y, c in rows for v, w, e in rows if x < v and y > w)


def _rows(rng, n, values, hot):
    seen = Counter((0 if rng.random() < hot else rng.randrange(values), rng.randrange(values)) for _ in range(n))
    return [(x, y, c) for (x, y), c in seen.items()]


@pytest.mark.parametrize("n, values, hot", [(1, 5, 0), (2, 2, 0), (300, 400, 0), (300, 7, 0), (300, 200, 0.4), (300, 1, 0)])
def test_local_and_cells(n, values, hot):
    rng = random.Random(n + values)
    rows = _rows(rng, n, values, hot)
    x, y, c = (np.array(v, dtype=np.int64) for v in zip(*rows, strict=True))
    assert discord.inversions(x, y, c) == _brute(rows)
    assert discord.inversions(x, y, c * 10**10) == _brute(rows) * 10**20
    gx, gy = x // 3, y // 5
    cells = Counter()
    for a, b, k in zip(gx.tolist(), gy.tolist(), c.tolist(), strict=True):
        cells[a, b] += k
    cx, cy, cc = (np.array(v, dtype=np.int64) for v in zip(*[(a, b, k) for (a, b), k in cells.items()], strict=True))
    assert discord.between_cells(cx, cy, cc) == _brute([(a, b, k) for (a, b), k in cells.items()])


@pytest.mark.parametrize("strips, local_rows", [(4, 20), (8, 60), (1024, 100), (1024, 1_000_000)])
def test_strips_equal_brute_force(spark, strips, local_rows):
    rng = random.Random(strips)
    tables = {0: _rows(rng, 250, 10_000, 0), 1: _rows(rng, 250, 200, 0.4), 3: _rows(rng, 200, 9, 0), 4: [(5, y, 1) for y in range(90)],
              5: [(i, 500 - i, 2) for i in range(150)]}
    data = [(k, x, y, c) for k, rows in tables.items() for x, y, c in rows]
    counts = spark.createDataFrame(data, "pair int, rx bigint, ry bigint, cnt bigint").repartition(4)
    assert {k: v for k, v in discord.discordances(counts, strips, local_rows).items() if v} == {k: _brute(r) for k, r in tables.items() if _brute(r)}


def test_no_rows_and_nulls(spark):
    empty = spark.createDataFrame([], "pair int, rx bigint, ry bigint, cnt bigint")
    assert discord.discordances(empty) == {}
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 1.0), (4.0, 0.5)], "a double, b double")
    assert {(r[0], r[1]): r[2] for r in K.corr_kendall(df, ["a", "b"]).collect()}["a", "b"] == pytest.approx(-1.0)
