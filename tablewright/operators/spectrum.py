"""Periodogram of ordered series: raw and modified-Daniell smoothed.

A series is a numeric column in a defined order.  For event data the order
comes from time buckets: :func:`bucket_series` counts (or sums) per time
bucket and fills gaps with 0, so a series is as long as its time range
divided by the bucket width -- bounded however many rows fall in it.

No task holds a series.  Positions come from the distributed ranking, trend
and taper are column expressions, and the transform of length n = n1 * n2 is
done in two steps of short transforms: n2 groups of n1 points, a phase
factor, then n1 groups of n2 points, with n1 and n2 near the square root of n.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.columns import qcol
from .rank import ranked_counts, written

# Taper share, minimum series length and the default smoothing spans.
TAPER = 0.1
MIN_LENGTH = 11
DEFAULT_SPANS = (3, 5)
#: time buckets that one row of the grid generates
GRID_CHUNK = 4096


def nextn(n: int, factors=(2, 3, 5)) -> int:
    """Smallest integer >= n whose prime factors are all in ``factors``."""
    m = max(1, n)
    while True:
        k = m
        for f in factors:
            while k % f == 0:
                k //= f
        if k == 1:
            return m
        m += 1


def daniell_weights(spans) -> np.ndarray:
    """Symmetric weights of the convolved modified Daniell kernels for ``spans`` (odd widths)."""
    w = np.array([1.0])
    for s in spans:
        m = int(s) // 2
        if m < 1:
            continue
        k = np.full(2 * m + 1, 1.0 / (2 * m))
        k[0] = k[-1] = 1.0 / (4 * m)
        w = np.convolve(w, k)
    return w


def split_length(n: int) -> int:
    """The divisor of ``n`` nearest to its square root (from below)."""
    return next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)


def bucket_series(df: DataFrame, ts_col: str, bucket: str = "1 hour", value: str | None = None,
                  by: str | None = None) -> DataFrame:
    """``(series, t, value)``: count (or sum of ``value``) per time bucket, gaps filled with 0."""
    key = qcol(by).cast("string") if by else F.lit("all")
    count_, unit = bucket.split()
    units = {"second", "minute", "hour", "day", "week", "month", "year"}
    if count_ == "1" and unit.rstrip("s") in units:
        # calendar truncation keeps the column's own time zone semantics (no session-zone shift)
        start = F.date_trunc(unit.rstrip("s"), qcol(ts_col))
    else:
        start = F.window(qcol(ts_col).cast("timestamp"), bucket).start
    agg = F.count(F.lit(1)).cast("double") if value is None else F.sum(qcol(value).cast("double"))
    per = df.select(key.alias("series"), start.alias("t"), *( [] if value is None else [qcol(value)])) \
        .groupBy("series", "t").agg(agg.alias("value"))
    span = per.groupBy("series").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    step, stride = F.expr(f"INTERVAL {bucket}"), F.expr(f"INTERVAL {int(count_) * GRID_CHUNK} {unit}")
    last = F.expr(f"INTERVAL {int(count_) * (GRID_CHUNK - 1)} {unit}")
    chunks = span.select("series", "t1", F.explode(F.sequence("t0", "t1", stride)).alias("_c")).repartition("series", "_c")
    grid = chunks.select("series", F.explode(F.sequence("_c", F.least(F.col("_c") + last, "t1"), step)).alias("t"))
    return grid.join(per, ["series", "t"], "left").select(
        "series", "t", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))


def _transform(rows: DataFrame, group: str, at: str, length: str, out: str, phase: bool) -> DataFrame:
    """One step of the transform: every (series, ``group``) is a vector of ``length`` points placed by ``at``."""
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        size, n, g = int(pdf[length].iloc[0]), int(pdf["n"].iloc[0]), int(pdf[group].iloc[0])
        v = np.zeros(size, dtype=complex)
        v[pdf[at].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        f, k = np.fft.fft(v), np.arange(size)
        if phase:
            f = f * np.exp(-2j * np.pi * ((g * k) % n) / n)
        first = pdf.iloc[0]
        return pd.DataFrame({"series": first["series"], "n0": first["n0"], "n": n, "n1": first["n1"], "n2": first["n2"],
                             group: g, out: k, "re": f.real, "im": f.imag})

    return rows.groupBy("series", group).applyInPandas(
        step, f"series string, n0 long, n long, n1 long, n2 long, {group} long, {out} long, re double, im double")


def periodogram(series: DataFrame, spans=None, *, taper: float = TAPER) -> DataFrame:
    """``(series, freq_index, frequency, power)`` per series, raw or smoothed with ``spans``.

    Input: ``(series, t, value)`` with one row per time step (see
    :func:`bucket_series`; values of the same step are added up).  Each series
    is linearly detrended, tapered at both ends by a split cosine and padded
    to a length with factors 2, 3 and 5.  Series shorter than 11 points are
    skipped.
    """
    steps = series.where(F.col("value").isNotNull()).groupBy("series", "t").agg(F.sum("value").alias("x"))
    points = ranked_counts(steps, "t", by=["series"], carry=["x"])

    @pandas_udf("long")
    def padded(n: pd.Series) -> pd.Series:
        return n.map(nextn)

    @pandas_udf("long")
    def short(n: pd.Series) -> pd.Series:
        return n.map(split_length)

    points = points.where(F.col("total") >= MIN_LENGTH).select(
        "series", F.col("before").alias("i"), F.col("total").alias("n0"), "x",
        (F.col("before") + 1 - (F.col("total") + 1) / F.lit(2.0)).alias("tc"))
    n0 = F.col("n0").cast("double")
    fits = (points.groupBy("series", "n0").agg(F.avg("x").alias("mean"), F.sum(F.col("x") * F.col("tc")).alias("sxt"))
            .select(F.col("series").alias("_s"), "mean", (F.col("sxt") / (n0 * (n0 * n0 - 1) / 12.0)).alias("slope"),
                    padded("n0").alias("n")).withColumn("n1", short("n")).withColumn("n2", F.expr("n div n1")))
    m = F.floor(n0 * F.lit(taper))
    edge = lambda j: 0.5 * (1 - F.cos(F.lit(math.pi) * (2 * j + 1) / (2 * m)))
    window = F.when(F.col("i") < m, edge(F.col("i"))).when(F.col("i") >= n0 - m, edge(n0 - 1 - F.col("i"))).otherwise(F.lit(1.0))
    rows = points.join(fits, F.col("series") == F.col("_s")).select(
        "series", "n0", "n", "n1", "n2", F.expr("i % n2").alias("r"), F.expr("i div n2").alias("q"),
        ((F.col("x") - F.col("mean") - F.col("slope") * F.col("tc")) * window).alias("re"), F.lit(0.0).alias("im"))
    inner = _transform(rows, "r", "q", "n1", "k1", True)
    outer = _transform(inner, "k1", "r", "n2", "k2", False)
    power = outer.select("series", "n", (F.col("k1") + F.col("n1") * F.col("k2")).alias("k"),
                         ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n0")).alias("p"))
    if spans:
        # the power at frequency 0 is that of its neighbours, which are equal for a real series
        first = power.where("k = 1").select("series", "n", F.lit(0).cast("long").alias("k"), "p")
        power = written(power.where("k > 0").unionByName(first), "spectrum")
        w = daniell_weights(spans)
        taps = F.array(*[F.struct(F.lit(j - len(w) // 2).alias("off"), F.lit(float(v)).alias("w")) for j, v in enumerate(w)])
        power = (power.select("series", "n", "k", "p", F.inline(taps))
                 .groupBy("series", "n", F.expr("pmod(k - off, n)").alias("k")).agg(F.sum(F.col("w") * F.col("p")).alias("p")))
    scale = 1 - (5.0 / 8.0) * taper * 2
    return power.where((F.col("k") >= 1) & (F.col("k") <= F.expr("n div 2"))).select(
        "series", F.col("k").alias("freq_index"), (F.col("k") / F.col("n")).alias("frequency"), (F.col("p") / F.lit(scale)).alias("power"))
