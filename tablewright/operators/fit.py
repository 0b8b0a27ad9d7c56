"""Distribution fitting by maximum likelihood: normal, log-normal, exponential, gamma, Weibull.

Every estimate comes from a few sufficient statistics computed by whole-table
aggregations (mean, mean of logs, power sums); iterative solvers (gamma
shape, Weibull shape) iterate on driver scalars, one aggregation per Weibull
Newton step.  Goodness of fit (Kolmogorov-Smirnov) uses the distributed
ranking, never a global sort.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.columns import is_integral, qcol
from ..functions.rounding import round_dp
from ..functions.special import (
    digamma, kolmogorov_exact, kolmogorov_upper, pgamma_array, pnorm_col, qgamma_array, qnorm_col, trigamma,
)
from .explore import histogram, spread
from .rank import quantile_map, ranked_counts

FAMILIES = ("norm", "lnorm", "exp", "gamma", "weibull")
POSITIVE_FAMILIES = ("lnorm", "exp", "gamma", "weibull")
# Minimum sample, positive shift, parameter names, display labels.
MIN_VALUES = 10
SHIFT_EPS = 0.001
PARAM_NAMES = {"norm": ("mean", "sd"), "lnorm": ("meanlog", "sdlog"), "exp": ("rate",),
               "gamma": ("shape", "rate"), "weibull": ("shape", "scale")}
LABELS = {"norm": "Normal", "lnorm": "Log-Normal", "exp": "Exponential", "gamma": "Gamma", "weibull": "Weibull"}


@dataclass
class Fit:
    family: str
    params: dict
    loglik: float
    n: int
    shift: float = 0.0
    se: dict = field(default_factory=dict)
    corr: float | None = None

    @property
    def k(self) -> int:
        return len(self.params)

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self.loglik

    @property
    def bic(self) -> float:
        return self.k * math.log(self.n) - 2 * self.loglik


def fit_shift(df: DataFrame, col: str) -> tuple[float, float, int]:
    """(min, shift, n): positive families use ``x - min + 0.001`` when any value is <= 0."""
    r = df.agg(F.min(qcol(col).cast("double")).alias("lo"), F.count(qcol(col)).alias("n")).first()
    lo = r["lo"]
    shift = 0.0 if lo is None or lo > 0 else -lo + SHIFT_EPS
    return lo, shift, int(r["n"])


def _suff(df: DataFrame, col: str, shift: float) -> dict:
    x = qcol(col).cast("double")
    xs = x + F.lit(shift)
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"),
               F.avg(xs).alias("ms"), F.avg(F.log(xs)).alias("g"), F.var_pop(F.log(xs)).alias("vg"),
               F.stddev_samp(F.log(xs)).alias("sg")).first()
    return r.asDict()


#: Shapes at which the first Weibull pass takes power sums, and the factor they reach to both sides of the start.
NODES, REACH = 16, 2.5


def _weibull_start(df: DataFrame, z: Column, lz: Column, g: float, k0: float) -> float:
    """A root of the likelihood equation to about nine digits from one pass: power sums at Chebyshev points of ln(shape).

    The equation's left side is smooth in ln(shape), so its interpolant through these points has nearly the same root.
    Without a change of sign inside the reach the start stays as it is.
    """
    at = [math.cos((2 * j + 1) * math.pi / (2 * NODES)) for j in range(NODES)]
    shapes = [k0 * REACH**t for t in at]
    row = df.agg(*[a.alias(f"{name}{j}") for j, k in enumerate(shapes) for name, a in (
        ("a", F.sum(F.pow(z, F.lit(k)))), ("b", F.sum(F.pow(z, F.lit(k)) * lz)))]).first()
    f = [row[f"b{j}"] / row[f"a{j}"] - 1.0 / k - g for j, k in enumerate(shapes)]
    weight = [(-1) ** j * math.sin((2 * j + 1) * math.pi / (2 * NODES)) for j in range(NODES)]

    def interpolant(t: float) -> float:
        terms = [(w / (t - x) if t != x else math.inf, y) for w, x, y in zip(weight, at, f, strict=True)]
        hit = [y for w, y in terms if math.isinf(w)]
        return hit[0] if hit else sum(w * y for w, y in terms) / sum(w for w, _ in terms)

    low, high = -1.0, 1.0  # the left side grows with the shape
    if not interpolant(low) < 0 < interpolant(high):
        return k0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if interpolant(mid) < 0 else (low, mid)
    return k0 * REACH ** ((low + high) / 2)


def _weibull(df: DataFrame, col: str, shift: float, st: dict, max_iter: int = 50) -> tuple[float, float, dict]:
    """Shape and scale, x scaled by its mean: mostly two passes, one for the start and one that checks it by a Newton step.

    A small step's sums follow from the pass before it (their derivatives are the next power sums); a large one, after a
    start outside the reach, takes another pass.
    """
    scale0 = st["ms"]
    z = (qcol(col).cast("double") + F.lit(shift)) / F.lit(scale0)
    lz = F.log(z)
    g = st["g"] - math.log(scale0)
    k = _weibull_start(df, z, lz, g, 1.28255 / st["sg"] if st["sg"] else 1.0)
    n = st["n"]
    for _ in range(max_iter):
        zk = F.pow(z, F.lit(k))
        r = df.agg(F.sum(zk).alias("s0"), F.sum(zk * lz).alias("s1"), F.sum(zk * lz * lz).alias("s2")).first()
        s0, s1, s2 = r["s0"], r["s1"], r["s2"]
        step = -(s1 / s0 - 1.0 / k - g) / ((s2 * s0 - s1 * s1) / (s0 * s0) + 1.0 / (k * k))
        if abs(step) < 1e-6 * k:
            s0, s1 = s0 + step * s1 + step * step / 2 * s2, s1 + step * s2
            k += step
            break
        k = k + step if k + step > 0 else k / 2
    else:
        warnings.warn(f"the Weibull shape did not settle in {max_iter} steps", stacklevel=2)
    lam_z = (s0 / n) ** (1.0 / k)
    return k, lam_z * scale0, {"s0": s0, "s1": s1, "s2": s2, "lam_z": lam_z, "g": g}


def fit_family(df: DataFrame, col: str, family: str, *, shift: float | None = None, st: dict | None = None) -> Fit:
    """MLE of one family on the (shifted, for positive families) non-missing values."""
    if shift is None:
        _, pos_shift, _ = fit_shift(df, col)
        shift = pos_shift if family in POSITIVE_FAMILIES else 0.0
    if st is None:
        st = _suff(df, col, shift)
    n = st["n"]
    if n < MIN_VALUES:
        raise ValueError(f"need at least {MIN_VALUES} non-missing values")
    spread, center = (st["v"], st["m"]) if family == "norm" else (st["vg"], 1 + abs(st["g"]))
    if family != "exp" and spread <= (1e-12 * center) ** 2:
        raise ValueError("the values do not vary beyond rounding")
    if family == "norm":
        mean, sd = st["m"], math.sqrt(st["v"])
        ll = -n / 2.0 * (math.log(2 * math.pi * st["v"]) + 1)
        return Fit(family, {"mean": mean, "sd": sd}, ll, n, 0.0,
                   {"mean": sd / math.sqrt(n), "sd": sd / math.sqrt(2 * n)}, 0.0)
    if family == "lnorm":
        ml, sl = st["g"], math.sqrt(st["vg"])
        ll = -n / 2.0 * (math.log(2 * math.pi * st["vg"]) + 1) - n * st["g"]
        return Fit(family, {"meanlog": ml, "sdlog": sl}, ll, n, shift,
                   {"meanlog": sl / math.sqrt(n), "sdlog": sl / math.sqrt(2 * n)}, 0.0)
    if family == "exp":
        rate = 1.0 / st["ms"]
        ll = -n * math.log(st["ms"]) - n
        return Fit(family, {"rate": rate}, ll, n, shift, {"rate": rate / math.sqrt(n)})
    if family == "gamma":
        m, g = st["ms"], st["g"]
        s = math.log(m) - g
        k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
        for _ in range(100):
            step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
            k_new = k - step
            if k_new <= 0:
                k_new = k / 2
            if abs(k_new - k) < 1e-14 * k:
                k = k_new
                break
            k = k_new
        b = k / m
        ll = n * (k * math.log(b) - math.lgamma(k) + (k - 1) * g - k)
        # inverse Fisher information per observation: [[psi'(k), -1/b], [-1/b, k/b^2]]
        i11, i12, i22 = trigamma(k), -1.0 / b, k / (b * b)
        det = i11 * i22 - i12 * i12
        v11, v22, v12 = i22 / det / n, i11 / det / n, -i12 / det / n
        return Fit(family, {"shape": k, "rate": b}, ll, n, shift,
                   {"shape": math.sqrt(v11), "rate": math.sqrt(v22)}, v12 / math.sqrt(v11 * v22))
    if family == "weibull":
        k, scale, s = _weibull(df, col, shift, st)
        g = st["g"]
        ll = n * (math.log(k) - k * math.log(scale) + (k - 1) * g - 1)
        # observed information from the same power sums (z = x / mean, lam_z = scale / mean)
        lam = s["lam_z"]
        ln_l = math.log(lam)
        lk = lam ** k
        t0 = s["s0"] / lk
        t1 = (s["s1"] - ln_l * s["s0"]) / lk
        t2 = (s["s2"] - 2 * ln_l * s["s1"] + ln_l * ln_l * s["s0"]) / lk
        h_kk = -n / (k * k) - t2
        h_ll = n * k / scale ** 2 - k * (k + 1) / scale ** 2 * t0
        h_kl = -n / scale + (t0 + k * t1) / scale
        det = h_kk * h_ll - h_kl * h_kl
        v_kk, v_ll, v_kl = -h_ll / det, -h_kk / det, h_kl / det
        return Fit(family, {"shape": k, "scale": scale}, ll, n, shift,
                   {"shape": math.sqrt(abs(v_kk)), "scale": math.sqrt(abs(v_ll))},
                   v_kl / math.sqrt(abs(v_kk * v_ll)))
    raise ValueError(f"unknown family: {family}")


def fit_all(df: DataFrame, col: str, families=FAMILIES) -> list[Fit]:
    """All families on one column.  The single projected column is persisted (memory, spilling to
    disk) because the Weibull solver makes one pass per Newton step."""
    from pyspark import StorageLevel

    df = df.select(qcol(col).alias(col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_all(df, col, families)
    finally:
        df.unpersist()


def _fit_all(df: DataFrame, col: str, families) -> list[Fit]:
    lo, pos_shift, n = fit_shift(df, col)
    if n < MIN_VALUES:
        raise ValueError(f"need at least {MIN_VALUES} non-missing values")
    st0 = _suff(df, col, 0.0)
    st1 = st0 if pos_shift == 0 else _suff(df, col, pos_shift)
    fits = []
    for fam in families:
        shift = pos_shift if fam in POSITIVE_FAMILIES else 0.0
        try:
            fits.append(fit_family(df, col, fam, shift=shift, st=st1 if shift else st0))
        except (ValueError, ZeroDivisionError, OverflowError, ArithmeticError) as e:
            # a family that cannot be fitted is left out of the comparison, as a warning
            warnings.warn(f"{fam} left out of the comparison: {e}", stacklevel=2)
    return fits


# ------------------------------------------------------------- CDF / pdf
def cdf_col(fit: Fit, x: Column) -> Column:
    """Fitted CDF at (already shifted) x as a column expression (gamma: vectorised pandas UDF)."""
    p = fit.params
    if fit.family == "norm":
        return pnorm_col((x - F.lit(p["mean"])) / F.lit(p["sd"]))
    if fit.family == "lnorm":
        return F.when(x > 0, pnorm_col((F.log(x) - F.lit(p["meanlog"])) / F.lit(p["sdlog"]))).otherwise(F.lit(0.0))
    if fit.family == "exp":
        return F.when(x > 0, F.lit(1.0) - F.exp(-F.lit(p["rate"]) * x)).otherwise(F.lit(0.0))
    if fit.family == "weibull":
        return F.when(x > 0, F.lit(1.0) - F.exp(-F.pow(x / F.lit(p["scale"]), F.lit(p["shape"])))).otherwise(F.lit(0.0))
    if fit.family == "gamma":
        a, b = p["shape"], p["rate"]

        @pandas_udf("double")
        def gcdf(v: pd.Series) -> pd.Series:
            return pd.Series(pgamma_array(v.to_numpy(dtype=float), a, b))

        return gcdf(x)
    raise ValueError(fit.family)


def pdf_col(fit: Fit, x: Column) -> Column:
    p = fit.params
    if fit.family == "norm":
        u = (x - F.lit(p["mean"])) / F.lit(p["sd"])
        return F.exp(-u * u / 2) / F.lit(p["sd"] * math.sqrt(2 * math.pi))
    if fit.family == "lnorm":
        u = (F.log(x) - F.lit(p["meanlog"])) / F.lit(p["sdlog"])
        return F.when(x > 0, F.exp(-u * u / 2) / (x * F.lit(p["sdlog"] * math.sqrt(2 * math.pi)))).otherwise(0.0)
    if fit.family == "exp":
        return F.when(x >= 0, F.lit(p["rate"]) * F.exp(-F.lit(p["rate"]) * x)).otherwise(0.0)
    if fit.family == "gamma":
        a, b = p["shape"], p["rate"]
        c = a * math.log(b) - math.lgamma(a)
        return F.when(x > 0, F.exp(F.lit(c) + F.lit(a - 1) * F.log(x) - F.lit(b) * x)).otherwise(0.0)
    if fit.family == "weibull":
        k, lam = p["shape"], p["scale"]
        return F.when(x > 0, F.lit(k / lam) * F.pow(x / F.lit(lam), F.lit(k - 1))
                      * F.exp(-F.pow(x / F.lit(lam), F.lit(k)))).otherwise(0.0)
    raise ValueError(fit.family)


#: below this many untied values the distribution of the KS statistic is computed exactly (a fixed value)
KS_EXACT_BELOW = 100


def _ks(df: DataFrame, col: str, fit: Fit) -> tuple[float, int, bool]:
    """D = max over sorted positions of max(i/n - F, F - (i-1)/n), from distinct-value ranks; n; whether values are tied."""
    xs = qcol(col).cast("double") + F.lit(fit.shift)
    rc = ranked_counts(df, xs)
    fx = cdf_col(fit, F.col("value"))
    n = F.col("total").cast("double")
    d = F.greatest((F.col("before") + F.col("cnt")) / n - fx, fx - F.col("before") / n)
    r = rc.agg(F.max(d).alias("d"), F.max("total").alias("n"), F.max("cnt").alias("most")).first()
    return float(r["d"]), int(r["n"]), int(r["most"]) > 1


def ks_statistic(df: DataFrame, col: str, fit: Fit) -> tuple[float, int]:
    """The KS statistic D and n."""
    return _ks(df, col, fit)[:2]


def ks_test(df: DataFrame, col: str, fit: Fit) -> dict:
    """Statistic, ``p_asymptotic`` and, for fewer than ``KS_EXACT_BELOW`` untied values, ``p_exact`` (else None)."""
    d, n, tied = _ks(df, col, fit)
    exact = kolmogorov_exact(n, d) if n < KS_EXACT_BELOW and not tied else None
    return {"statistic": d, "n": n, "p_asymptotic": kolmogorov_upper(math.sqrt(n) * d), "p_exact": exact}


def _fmt_param(v: float) -> str:
    r = math.floor(v * 10000 + 0.5) / 10000
    return "%.15g" % r


def parameters_text(fit: Fit) -> str:
    return ", ".join(f"{k} = {_fmt_param(v)}" for k, v in fit.params.items())


def ks_many(df: DataFrame, col: str, fits: list[Fit]) -> dict[str, float]:
    """KS statistics of several fits: one distributed ranking and one aggregation for all."""
    rc = ranked_counts(df, qcol(col).cast("double"))  # a shift leaves ranks as they are
    n = F.col("total").cast("double")
    aggs = []
    for f in fits:
        fx = cdf_col(f, F.col("value") + F.lit(f.shift))
        aggs.append(F.max(F.greatest((F.col("before") + F.col("cnt")) / n - fx, fx - F.col("before") / n)).alias(f.family))
    r = rc.agg(*aggs, F.max("total").alias("_n")).first()
    return {f.family: kolmogorov_upper(math.sqrt(r["_n"]) * float(r[f.family])) for f in fits}


def fit_compare(df: DataFrame, col: str, families=FAMILIES, *, with_ks: bool = True) -> DataFrame:
    """Comparison table ordered by AIC: AIC, BIC, log-likelihood (2 dp), KS p (4 dp), parameters."""
    rows = []
    fits = fit_all(df, col, families)
    ks = ks_many(df, col, fits) if with_ks else {}
    for fit in fits:
        rows.append((fit.family, fit.aic, fit.bic, fit.loglik, ks.get(fit.family), parameters_text(fit)))
    out = df.sparkSession.createDataFrame(
        rows, "distribution string, aic double, bic double, loglik double, ks_p_asymptotic double, parameters string")
    return out.select("distribution", round_dp(F.col("aic"), 2).alias("aic"), round_dp(F.col("bic"), 2).alias("bic"),
                      round_dp(F.col("loglik"), 2).alias("loglik"),
                      round_dp(F.col("ks_p_asymptotic"), 4).alias("ks_p_asymptotic"), "parameters") \
        .orderBy("aic")


def fit_details(df: DataFrame, col: str, families=FAMILIES) -> DataFrame:
    """Per family and parameter: estimate, standard error; per family LL, AIC, BIC, parameter correlation."""
    rows = []
    for fit in fit_all(df, col, families):
        for name in PARAM_NAMES[fit.family]:
            rows.append((fit.family, name, fit.params[name], fit.se.get(name), fit.loglik, fit.aic, fit.bic,
                         fit.corr, fit.n))
    return df.sparkSession.createDataFrame(
        rows, "distribution string, parameter string, estimate double, std_error double, loglik double, "
              "aic double, bic double, param_corr double, n long")


def density_overlay(df: DataFrame, col: str, families=FAMILIES, bins: int = 40, grid: int = 200) -> DataFrame:
    """40-bin density histogram of x plus each fitted pdf on a 200-point grid from min to max.

    Rows: ``(layer, idx, x, y)``; positive families are evaluated at the
    shifted grid, as they were fitted.
    """
    fits = fit_all(df, col, families)
    lo, _, _ = fit_shift(df, col)
    hi = df.agg(F.max(qcol(col).cast("double"))).first()[0]
    h = histogram(df, col, bins).select(F.lit("histogram").alias("layer"), F.col("bin").alias("idx"), "x",
                                         F.col("density").alias("y"))
    step = (hi - lo) / (grid - 1)
    g = df.sparkSession.range(grid).select(F.col("id").alias("idx"), (F.lit(lo) + F.col("id") * F.lit(step)).alias("x"))
    out = h
    for fit in fits:
        xs = F.col("x") + F.lit(fit.shift)
        out = out.unionByName(g.select(F.lit(LABELS[fit.family]).alias("layer"), "idx", "x",
                                       pdf_col(fit, xs).alias("y")))
    return out


def cullen_frey(df: DataFrame, col: str) -> DataFrame:
    """Min, max, median, mean, sample sd, bias-corrected skewness and (non-excess) kurtosis."""
    x = qcol(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd")).first()
    n, m = st["n"], st["mean"]
    schema = ("column string, n long, min double, max double, median double, mean double, sd double, "
              "skewness double, kurtosis double")
    if not n:
        return df.sparkSession.createDataFrame([(col, 0, *[None] * 7)], schema)
    d = x - F.lit(m)
    c = df.agg(F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4")).first()
    med = quantile_map(df, [col], [0.5])[col][0]
    g1 = c["m3"] / c["m2"] ** 1.5 if c["m2"] else None
    b2 = c["m4"] / c["m2"] ** 2 if c["m2"] else None
    skew = math.sqrt(n * (n - 1)) / (n - 2) * g1 if g1 is not None and n > 2 else None
    kurt = ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * b2 - 3 * (n - 1)) + 3) if b2 is not None and n > 3 else None
    return df.sparkSession.createDataFrame(
        [(col, int(n), float(st["min"]), float(st["max"]), med, m, st["sd"], skew, kurt)], schema)


# ---------------------------------------------------------------- bootstrap
POISSON1_CDF = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_M32 = 4294967296


_MULTIPLIER = 73244475


def _mix32(x: Column) -> Column:
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(_MULTIPLIER), F.lit(_M32))
    return x.bitwiseXOR(F.shiftright(x, 16))


def with_uniform(rows: DataFrame, key: str, rep: str, name: str) -> DataFrame:
    """Add a reproducible uniform in [0, 1) from a 64-bit key and a replicate id.

    Replicate, high and low half of the key are mixed in turn (one projection
    each); every product stays below 2**59, so no key overflows and no two
    keys share their draws.
    """
    k = F.col(key).cast("long")
    out = rows.withColumn("_h", _mix32(F.col(rep).cast("long") + F.lit(12345)))
    out = out.withColumn("_h", F.shiftrightunsigned(k, 32).bitwiseXOR(F.col("_h"))).withColumn("_h", _mix32(F.col("_h")))
    out = out.withColumn("_h", k.bitwiseAND(F.lit(_M32 - 1)).bitwiseXOR(F.col("_h")))
    return out.withColumn(name, _mix32(F.col("_h")).cast("double") / F.lit(float(_M32))).drop("_h")


def poisson1(u: Column) -> Column:
    """Poisson(1) draw by inverse CDF of a uniform."""
    w = F.lit(0)
    for c in POISSON1_CDF:
        w = w + (u > F.lit(c)).cast("int")
    return w


def cullen_frey_boot(df: DataFrame, col: str, id_col: str, reps: int = 500) -> DataFrame:
    """Bootstrap (skewness^2, kurtosis) pairs by the Poisson bootstrap.

    Each row gets an independent Poisson(1) weight per replicate from a hash
    of (id, replicate).  Rows are expanded against the replicate ids right
    before a partial aggregation of weighted power sums, so the expansion is
    pipelined and only ``reps`` partial rows per task are shuffled.
    """
    x = qcol(col).cast("double")
    m = df.agg(F.avg(x)).first()[0]
    key = qcol(id_col) if is_integral(df.schema[id_col].dataType) else F.xxhash64(qcol(id_col))
    base = df.select(key.alias("_id"), (x - F.lit(m)).alias("_d")).where(F.col("_d").isNotNull())
    if base.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        # few input splits (small files): spread rows before the 500-fold expansion
        base = spread(base, "_id")
    ex = base.select("_id", "_d", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    d = F.col("_d")
    sums = with_uniform(ex, "_id", "rep", "_u").select("rep", poisson1(F.col("_u")).cast("double").alias("w"), d).groupBy("rep").agg(
        F.sum("w").alias("s0"), F.sum(F.col("w") * d).alias("s1"), F.sum(F.col("w") * d * d).alias("s2"),
        F.sum(F.col("w") * d * d * d).alias("s3"), F.sum(F.col("w") * d * d * d * d).alias("s4"))
    return boot_moments(sums)


def boot_moments(sums: DataFrame) -> DataFrame:
    n = F.col("s0")
    mu = F.col("s1") / n
    e2, e3, e4 = F.col("s2") / n, F.col("s3") / n, F.col("s4") / n
    m2 = e2 - mu * mu
    m3 = e3 - F.lit(3) * mu * e2 + F.lit(2) * mu * mu * mu
    m4 = e4 - F.lit(4) * mu * e3 + F.lit(6) * mu * mu * e2 - F.lit(3) * mu * mu * mu * mu
    g1 = m3 / F.pow(m2, 1.5)
    b2 = m4 / (m2 * m2)
    skew = F.sqrt(n * (n - 1)) / (n - 2) * g1
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * b2 - F.lit(3) * (n - 1)) + F.lit(3)
    return sums.select(F.col("rep").cast("long").alias("rep"), (skew * skew).alias("skewness_sq"),
                       kurt.alias("kurtosis"))


def gof_many(df: DataFrame, col: str, fits: list[Fit]) -> DataFrame:
    """:func:`gof_points` of several fits, stacked under their ``distribution``."""
    out = None
    for f in fits:
        one = gof_points(df, col, f).select(F.lit(f.family).alias("distribution"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def gof_points(df: DataFrame, col: str, fit: Fit) -> DataFrame:
    """Per sorted position: sample value, empirical CDF, fitted CDF (PP), fitted quantile of ppoints (QQ)."""
    from .explore import expand_positions, ppoints_a

    xs = qcol(col).cast("double") + F.lit(fit.shift)
    rc = ranked_counts(df, xs)
    first = rc.select("total").first()
    n = first[0] if first else 0  # a column without values has no points
    a = ppoints_a(n)
    pts = expand_positions(rc.select("value", "before", "cnt"))
    p = (F.col("position") - F.lit(a)) / F.lit(n + 1 - 2 * a)
    return pts.select("position", F.col("value").alias("sample"),
                      (F.col("position") / F.lit(float(n))).alias("ecdf"),
                      cdf_col(fit, F.col("value")).alias("fitted_cdf"),
                      quantile_col(fit, p).alias("fitted_quantile"))


def quantile_col(fit: Fit, p: Column) -> Column:
    q = fit.params
    if fit.family == "norm":
        return F.lit(q["mean"]) + F.lit(q["sd"]) * qnorm_col(p)
    if fit.family == "lnorm":
        return F.exp(F.lit(q["meanlog"]) + F.lit(q["sdlog"]) * qnorm_col(p))
    if fit.family == "exp":
        return -F.log1p(-p) / F.lit(q["rate"])
    if fit.family == "weibull":
        return F.lit(q["scale"]) * F.pow(-F.log1p(-p), F.lit(1.0 / q["shape"]))
    if fit.family == "gamma":
        a, b = q["shape"], q["rate"]

        @pandas_udf("double")
        def quantile(v: pd.Series) -> pd.Series:
            return pd.Series(qgamma_array(v.to_numpy(dtype=float), a, b))

        return quantile(p)
    raise ValueError(fit.family)
