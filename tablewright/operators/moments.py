"""Shape of numeric columns: skewness, kurtosis, direction and advice; Shapiro-Wilk normality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, qcol
from ..functions.rounding import round_dp
from ..functions.special import qnorm, qnorm_col
from .rank import ranked_counts, unpivot_values

# Direction and advice texts with their cut-offs on skewness.
DIR_LEFT, DIR_RIGHT, DIR_SYM = "Left-skewed", "Right-skewed", "Approx. symmetric"
DIR_INSUFFICIENT = "Insufficient data"
DIR_CONSTANT = "Constant"
ADV_STRONG = "Strong skew - try log or Box-Cox"
ADV_MODERATE = "Moderate skew - consider sqrt or log"
ADV_MILD = "Mild skew - may benefit from sqrt"
ADV_NONE = "No transform needed"
ADV_INSUFFICIENT = "Need >= 4 non-NA observations"
MIN_VALUES = 4
SHAPIRO_MAX_N = 5000


def moments_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: n, population skewness ``m3/m2^1.5`` and non-excess kurtosis ``m4/m2^2``.

    One aggregation for all columns (Spark's ``skewness`` is the population
    form; its ``kurtosis`` is excess, so 3 is added).
    """
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"_n{i}"), F.skewness(x).alias(f"_s{i}"), (F.kurtosis(x) + 3).alias(f"_k{i}"),
                 F.stddev_pop(x).alias(f"_sd{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                              F.col(f"_n{i}").cast("long").alias("n"), F.col(f"_s{i}").alias("skewness"),
                              F.col(f"_k{i}").alias("kurtosis"), F.col(f"_sd{i}").alias("_sd"))
                     for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def moments_report(df: DataFrame, cols: list[str] | None = None, *, normality: bool = False,
                   order_by: str | None = None) -> DataFrame:
    """Skewness and kurtosis (3 dp), skew direction and transform advice, ordered by skewness descending.

    With ``normality=True`` adds the Shapiro-Wilk p-value (4 dp) of the first
    5,000 non-missing values in ``order_by`` order.
    """
    m = moments_table(df, cols)
    enough = F.col("n") >= MIN_VALUES
    const = F.col("_sd") == 0
    sk = F.col("skewness")
    direction = (F.when(~enough, F.lit(DIR_INSUFFICIENT)).when(const | sk.isNull(), F.lit(DIR_CONSTANT))
                 .when(sk < -0.5, F.lit(DIR_LEFT)).when(sk > 0.5, F.lit(DIR_RIGHT)).otherwise(F.lit(DIR_SYM)))
    ask = F.abs(sk)
    advice = (F.when(~enough, F.lit(ADV_INSUFFICIENT)).when(const | sk.isNull(), F.lit(None).cast("string"))
              .when(ask > 2, F.lit(ADV_STRONG)).when(ask > 1, F.lit(ADV_MODERATE)).when(ask > 0.5, F.lit(ADV_MILD))
              .otherwise(F.lit(ADV_NONE)))
    valid = enough & ~const
    out = m.select(
        "position", "column", "n",
        F.when(valid, round_dp(sk, 3)).alias("skewness"),
        F.when(valid, round_dp(F.col("kurtosis"), 3)).alias("kurtosis"),
        direction.alias("skew_direction"), advice.alias("suggestion"))
    if normality:
        if order_by is None:
            raise ValueError("normality needs order_by to define the first 5,000 values")
        sw = shapiro_wilk(df, [r["column"] for r in m.select("column").collect()], order_by)
        out = out.join(sw.select("column", round_dp(F.col("p_value"), 4).alias("normality_p")), "column", "left")
    return out.orderBy(F.desc_nulls_last("skewness"), "position")


# ------------------------------------------------------------ Shapiro-Wilk
# Royston (1995) polynomial coefficients (constant term first).
SW_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]


def _poly(c, x):
    return sum(a * x ** i for i, a in enumerate(c))


def shapiro_wilk_values(x: np.ndarray) -> tuple[float | None, float | None]:
    """W and p-value (Royston 1995) for one sorted-or-not sample of 3..5000 values."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3 or x[-1] - x[0] <= 0:
        return None, None
    nn2 = n // 2
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        an25 = n + 0.25
        m = np.array([qnorm((i - 0.375) / an25) for i in range(1, nn2 + 1)])
        summ2 = 2.0 * float(np.sum(m * m))
        ssumm2 = math.sqrt(summ2)
        rsn = 1.0 / math.sqrt(n)
        a1 = _poly(SW_C1, rsn) - m[0] / ssumm2
        a = np.empty(nn2)
        if n > 5:
            a1, a[1], fac = _extreme_weights(n, summ2, m[0], m[1])
            start = 2
        else:
            fac = math.sqrt((summ2 - 2 * m[0] ** 2) / (1 - 2 * a1 ** 2))
            start = 1
        a[0] = a1
        a[start:] = -m[start:] / fac
    w = np.zeros(n)
    w[:nn2] = -a
    w[n - nn2:] = a[::-1]
    xc = x - x.mean()
    wc = w - w.mean()
    W = float(np.dot(wc, xc) ** 2 / (np.dot(wc, wc) * np.dot(xc, xc)))
    W = min(W, 1.0)
    return W, shapiro_wilk_p(W, n)


def shapiro_wilk_p(w: float, n: int) -> float:
    """Royston's p-value of W for n values."""
    if n == 3:
        return max(0.0, 1.90985931710274 * (math.asin(math.sqrt(w)) - 1.04719755119660))
    if w >= 1.0:
        return 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = _poly(SW_G, n)
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mu = _poly(SW_C3, n)
        sigma = math.exp(_poly(SW_C4, n))
    else:
        ln = math.log(n)
        mu = _poly(SW_C5, ln)
        sigma = math.exp(_poly(SW_C6, ln))
    # upper normal tail computed directly (no 1 - cdf cancellation for small p)
    return 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2.0))


def first_values(df: DataFrame, cols: list[str], order_by: str, limit: int) -> DataFrame:
    """``(column, value)``: the first ``limit`` non-missing values of each column in ``order_by`` order.

    The order key is ranked per column with the distributed ranking (no
    single-partition window).
    """
    long = unpivot_values(df.select(qcol(order_by).alias("_ord"), *[qcol(c).alias(c) for c in cols]), cols,
                          by=["_ord"])
    long = long.where(F.col("value").isNotNull())
    rc = ranked_counts(long, "_ord", by=["column"]).where(F.col("before") < limit) \
        .select("column", F.col("value").alias("_ord"))
    return long.join(rc, ["column", "_ord"], "left_semi").select("column", "value")


def shapiro_wilk(df: DataFrame, cols: list[str], order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Per column: n, W and p-value on all values (or the first ``limit`` in ``order_by`` order).

    W needs only ranks and two sums: the values' distributed ranking gives
    each position's normal score, and one aggregation per column the rest.
    Royston's p-value was fitted for 3 to 5000 values; beyond, it is an
    extrapolation (see :func:`jarque_bera`).
    """
    from .explore import expand_positions

    long = first_values(df, cols, order_by, limit) if limit is not None else unpivot_values(df, cols)
    rc = ranked_counts(long, "value", by=["column"])
    # one row per column
    means = rc.groupBy(F.col("column").alias("_c")).agg((F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("_mean"))
    pts = expand_positions(rc).select("column", "position", F.col("total").alias("n"), "value")
    pts = pts.join(F.broadcast(means), F.col("column") == F.col("_c"))
    n, i, x = F.col("n"), F.col("position"), F.col("value") - F.col("_mean")
    m = qnorm_col((i - F.lit(0.375)) / (n + F.lit(0.25)))
    at = lambda k: F.max(F.when(i == k, x))
    rows = (pts.select("column", "position", "n", "value", "_mean", m.alias("m")).groupBy("column", "n").agg(
        F.sum(x * x).alias("sxx"), F.sum(F.col("m") * F.col("m")).alias("summ2"),
        F.sum(F.when((i > 2) & (i < n - 1), F.col("m") * x)).alias("smx"),
        F.max(F.when(i == 1, F.col("m"))).alias("m1"), F.max(F.when(i == 2, F.col("m"))).alias("m2"),
        at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(n - 1).alias("y2"), at(n).alias("y1"),
        F.collect_list(F.when(n <= 5, F.col("value"))).alias("few")).collect())
    out = []
    for r in rows:
        if r["n"] <= 5 or r["y1"] - r["x1"] <= 0:
            w, p = shapiro_wilk_values(np.array(r["few"] or [0.0, 0.0]))
        else:
            a1, a2, fac = _extreme_weights(r["n"], r["summ2"], r["m1"], r["m2"])
            top = a1 * (r["y1"] - r["x1"]) + a2 * (r["y2"] - r["x2"]) + (r["smx"] or 0.0) / fac
            size = 2 * (a1 ** 2 + a2 ** 2) + (r["summ2"] - 2 * r["m1"] ** 2 - 2 * r["m2"] ** 2) / fac ** 2
            w = min(top * top / (size * r["sxx"]), 1.0)
            p = shapiro_wilk_p(w, r["n"])
        out.append((r["column"], r["n"], w, p))
    return df.sparkSession.createDataFrame(out, "column string, n long, w double, p_value double")


def _extreme_weights(n: int, summ2: float, m1: float, m2: float) -> tuple[float, float, float]:
    """Weights of the two largest values and the divisor of all other scores (more than 5 values)."""
    rsn, root = 1.0 / math.sqrt(n), math.sqrt(summ2)
    a1 = _poly(SW_C1, rsn) - m1 / root
    a2 = _poly(SW_C2, rsn) - m2 / root
    return a1, a2, math.sqrt((summ2 - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))


def jarque_bera(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Full-data normality check from the moments: JB = n/6 (S^2 + (K-3)^2/4), p = exp(-JB/2)."""
    m = moments_table(df, cols)
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + (F.col("kurtosis") - 3) ** 2 / 4.0)
    return m.select("column", "n", jb.alias("jb"), F.exp(-jb / 2.0).alias("p_value"))
