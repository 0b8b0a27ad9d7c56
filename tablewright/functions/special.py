"""Special functions.

Two flavours:

* Column expressions (``pnorm_col``, ``qnorm_col``) built from arithmetic, so
  they run JVM-side inside whole-stage codegen, plus their SQL text twins
  (``pnorm_sql``, ``qnorm_sql``) for a second engine to check against.
* Driver scalars for the few numbers that need iteration (log-gamma
  derivatives, incomplete gamma/beta, t and Kolmogorov tails).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Published coefficients.
# Normal quantile: Wichura (1988), algorithm AS 241 (PPND16).
# ---------------------------------------------------------------------------
AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
           1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
           3.3430575583588128105e4, 2.5090809287301226727e3]
AS241_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
           5.2264952788528545610e3]
AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
           3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9]
AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15]

# Normal CDF: Hart (1968) rational approximation as given by West (2005).
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
SQRT_2PI = 2.506628274631


def _horner(coefs_low_to_high, x, lit):
    """Evaluate a polynomial high order first; works on Columns or SQL text."""
    acc = lit(coefs_low_to_high[-1])
    for a in reversed(coefs_low_to_high[:-1]):
        acc = _add(_mul(acc, x), lit(a))
    return acc


def _mul(a, b):
    return f"({a} * {b})" if isinstance(a, str) else a * b


def _add(a, b):
    return f"({a} + {b})" if isinstance(a, str) else a + b


def _sql_lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _col_lit(v: float) -> Column:
    return F.lit(float(v))


def _hart_poly(coefs_high_to_low, x, lit):
    return _horner(list(reversed(coefs_high_to_low)), x, lit)


# ---------------------------------------------------------------- normal CDF
def pnorm_col(x: Column) -> Column:
    """Standard normal CDF as a JVM-side column expression (abs error ~1e-14)."""
    x = x.cast("double")
    ax = F.abs(x)
    expo = F.exp(-ax * ax / F.lit(2.0))
    near = expo * _hart_poly(HART_NUM, ax, _col_lit) / _hart_poly(HART_DEN, ax, _col_lit)
    b = ax + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        b = ax + F.lit(k) / b
    far = expo / b / F.lit(SQRT_2PI)
    tail = F.when(ax > 37, F.lit(0.0)).when(ax < F.lit(7.07106781186547), near).otherwise(far)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def pnorm_sql(x: str) -> str:
    x = f"CAST(({x}) AS DOUBLE)"
    ax = f"abs({x})"
    expo = f"exp(-{ax} * {ax} / 2.0)"
    near = f"({expo} * {_hart_poly(HART_NUM, ax, _sql_lit)} / {_hart_poly(HART_DEN, ax, _sql_lit)})"
    b = f"({ax} + 0.65)"
    for k in ("4.0", "3.0", "2.0", "1.0"):
        b = f"({ax} + {k} / {b})"
    far = f"({expo} / {b} / {SQRT_2PI!r})"
    tail = f"(CASE WHEN {ax} > 37 THEN 0.0 WHEN {ax} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


# ----------------------------------------------------------- normal quantile
def _qnorm_parts(p, q, lit, sqrt, log, least):
    r_c = _add(lit(0.180625), _mul(_mul(q, q), lit(-1.0)))
    central = _mul(q, _div(_horner(AS241_A, r_c, lit), _horner(AS241_B, r_c, lit)))
    r = sqrt(_mul(log(least(p, _add(lit(1.0), _mul(p, lit(-1.0))))), lit(-1.0)))
    r1 = _add(r, lit(-1.6))
    mid = _div(_horner(AS241_C, r1, lit), _horner(AS241_D, r1, lit))
    r2 = _add(r, lit(-5.0))
    far = _div(_horner(AS241_E, r2, lit), _horner(AS241_F, r2, lit))
    return central, r, mid, far


def _div(a, b):
    return f"({a} / {b})" if isinstance(a, str) else a / b


def qnorm_col(p: Column) -> Column:
    """Standard normal quantile (AS 241) as a column expression; NULL outside (0,1)."""
    p = p.cast("double")
    q = p - F.lit(0.5)
    central, r, mid, far = _qnorm_parts(p, q, _col_lit, F.sqrt, F.log, F.least)
    tail = F.when(r <= 5.0, mid).otherwise(far)
    signed = F.when(q < 0, -tail).otherwise(tail)
    return (F.when(p.isNull() | (p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= 0.425, central)
            .otherwise(signed))


def qnorm_sql(p: str) -> str:
    p = f"CAST(({p}) AS DOUBLE)"
    q = f"({p} - 0.5)"
    central, r, mid, far = _qnorm_parts(
        p, q, _sql_lit, lambda a: f"sqrt({a})", lambda a: f"ln({a})",
        lambda a, b: f"least({a}, {b})")
    tail = f"(CASE WHEN {r} <= 5.0 THEN {mid} ELSE {far} END)"
    return (f"(CASE WHEN {p} IS NULL OR {p} <= 0 OR {p} >= 1 THEN NULL "
            f"WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


# ------------------------------------------------------------ driver scalars
def qnorm(p: float) -> float:
    q = p - 0.5
    if abs(q) <= 0.425:
        r = 0.180625 - q * q
        return q * _poly(AS241_A, r) / _poly(AS241_B, r)
    r = math.sqrt(-math.log(min(p, 1.0 - p)))
    if r <= 5.0:
        v = _poly(AS241_C, r - 1.6) / _poly(AS241_D, r - 1.6)
    else:
        v = _poly(AS241_E, r - 5.0) / _poly(AS241_F, r - 5.0)
    return -v if q < 0 else v


def pnorm(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def _poly(coefs_low_to_high, x):
    acc = 0.0
    for a in reversed(coefs_low_to_high):
        acc = acc * x + a
    return acc


def digamma(x: float) -> float:
    """psi(x) by upward recurrence and the asymptotic series."""
    res = 0.0
    while x < 6.0:
        res -= 1.0 / x
        x += 1.0
    f = 1.0 / (x * x)
    series = f * (-1 / 12 + f * (1 / 120 + f * (-1 / 252 + f * (1 / 240 + f * (-1 / 132)))))
    return res + math.log(x) - 0.5 / x + series


def trigamma(x: float) -> float:
    res = 0.0
    while x < 6.0:
        res += 1.0 / (x * x)
        x += 1.0
    f = 1.0 / (x * x)
    series = 1 / x + f / 2 + f / x * (1 / 6 + f * (-1 / 30 + f * (1 / 42 + f * (-1 / 30))))
    return res + series


def pgamma(x: float, shape: float, rate: float = 1.0) -> float:
    """Regularised lower incomplete gamma P(shape, rate*x)."""
    z = x * rate
    if z <= 0:
        return 0.0
    lg = shape * math.log(z) - z - math.lgamma(shape)
    if z < shape + 1.0:
        term = total = 1.0 / shape
        a = shape
        for _ in range(10000):
            a += 1.0
            term *= z / a
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return min(1.0, total * math.exp(lg))
    # continued fraction for Q (Lentz)
    tiny = 1e-300
    b = z + 1.0 - shape
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - shape)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return max(0.0, 1.0 - math.exp(lg) * h)


def lgamma_step(a: float, b: float) -> float:
    """lgamma(a + b) - lgamma(a) for b <= a, without cancellation at large a (difference of Stirling series)."""
    if a < 30.0:
        return math.lgamma(a + b) - math.lgamma(a)
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + tail(a + b) - tail(a)


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where the caller knows it more exactly."""
    if y is None:
        y = 1.0 - x
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    big, small = max(a, b), min(a, b)
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    lbt = lgamma_step(big, small) - math.lgamma(small) + a * log_x + b * log_y
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, y) / b


def _betacf(a, b, x):
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return h


def pt_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student t with ``df`` degrees of freedom."""
    if df <= 0 or t is None or math.isnan(t):
        return float("nan")
    if df > 1e4:
        # Hill's normalising expansion (relative error below 1e-12 here); the fraction below converges ever more slowly
        a = df - 0.5
        b = 48.0 * a * a
        z = math.sqrt(a * math.log1p(t * t / df))
        u = z + (z**3 + 3 * z) / b - (4 * z**7 + 33 * z**5 + 240 * z**3 + 855 * z) / (10 * b * (b + 0.8 * z**4 + 100))
        return math.erfc(u / math.sqrt(2.0))
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def pt(t: float, df: float) -> float:
    tail = 0.5 * pt_two_sided(t, df)
    return 1.0 - tail if t > 0 else tail


def qt(p: float, df: float) -> float:
    """Student t quantile by bisection on the CDF, in a bracket widened until it holds the answer."""
    lo, hi = -1e3, 1e3
    while pt(lo, df) > p and lo > -1e300:
        lo *= 1e3
    while pt(hi, df) < p and hi < 1e300:
        hi *= 1e3
    for _ in range(1100):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        if pt(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def pf_upper(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution."""
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def kolmogorov_upper(x: float) -> float:
    """Asymptotic P(sqrt(n) D > x): 2 * sum_k (-1)^(k-1) exp(-2 k^2 x^2)."""
    if x <= 0:
        return 1.0
    if x < 0.2:
        return 1.0
    total = 0.0
    for k in range(1, 101):
        total += (-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x)
    return max(0.0, min(1.0, 2.0 * total))


def kolmogorov_exact(n: int, d: float) -> float:
    """Exact P(D_n >= d) of a fully specified continuous distribution, by the matrix power of Marsaglia, Tsang and Wang."""
    import numpy as np

    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    k = math.floor(n * d) + 1
    h = k - n * d
    m = 2 * k - 1
    steps = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    matrix = np.where(steps >= 0, 1.0, 0.0)
    edge = h ** np.arange(1, m + 1)
    matrix[:, 0] -= edge
    matrix[-1, :] -= edge[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** m
    matrix /= np.array([math.gamma(i + 1) for i in range(m + 1)])[np.maximum(steps, 0)]
    below = np.linalg.matrix_power(matrix, n)[k - 1, k - 1] * math.exp(math.lgamma(n + 1) - n * math.log(n))
    return float(min(1.0, max(0.0, 1.0 - below)))


def kolmogorov_upper_sql(x: str) -> str:
    """SQL twin of :func:`kolmogorov_upper` using a 100-term series."""
    return (f"(CASE WHEN ({x}) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * "
            f"(SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * ({x}) * ({x}))) "
            f"FROM range(1, 101) AS kk(k)))) END)")


def pgamma_array(x, a: float, rate: float):
    """Gamma CDF over a NumPy array: power series below ``a + 1``, continued fraction above, all values at once."""
    import numpy as np

    x = np.asarray(x, dtype=float) * rate
    out = np.where(np.isnan(x), np.nan, 0.0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - math.lgamma(a))
        low = (x > 0) & (x < a + 1)
        if low.any():
            z = x[low]
            term = total = np.full(len(z), 1.0 / a)
            for k in range(1, 100_000):
                term = term * z / (a + k)
                total = total + term
                if (term < total * 1e-17).all():
                    break
            out[low] = np.minimum(front[low] * total, 1.0)
        high = x >= a + 1
        if high.any():
            z = x[high]
            b = z + 1.0 - a
            c, d = np.full(len(z), 1e300), 1.0 / b
            h = d
            for k in range(1, 100_000):
                an = -k * (k - a)
                b = b + 2.0
                d = an * d + b
                d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = b + an / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
                if (np.abs(d * c - 1.0) < 1e-16).all():
                    break
            out[high] = np.clip(1.0 - np.where(np.isinf(z), 0.0, front[high] * h), 0.0, 1.0)
    return out


def qgamma_array(p, a: float, rate: float):
    """Gamma quantiles over a NumPy array: Newton steps on :func:`pgamma_array` inside a shrinking bracket."""
    import numpy as np

    p = np.asarray(p, dtype=float)
    out = np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, np.nan))
    todo = (p > 0) & (p < 1)
    q = p[todo]
    lo, hi = np.zeros(len(q)), np.full(len(q), max(a, 1.0))
    while len(q) and (pgamma_array(hi, a, 1.0) < q).any():
        hi = np.where(pgamma_array(hi, a, 1.0) < q, hi * 2, hi)
    x = np.minimum(np.maximum(a * 0.999, 1e-300), hi)
    for _ in range(200):
        f = pgamma_array(x, a, 1.0) - q
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        with np.errstate(all="ignore"):
            step = x - f / np.exp((a - 1) * np.log(x) - x - math.lgamma(a))
        new = np.where((step > lo) & (step < hi), step, 0.5 * (lo + hi))
        if len(q) == 0 or (np.abs(new - x) <= 1e-15 * np.abs(new)).all():
            x = new
            break
        x = new
    out[todo] = x
    return out / rate
