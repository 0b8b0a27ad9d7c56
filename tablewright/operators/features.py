"""Feature engineering: transforms, Box-Cox, interactions, binning, safe formulas, previews."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, numeric_columns, qcol
from .rank import quantile_map

TRANSFORMS = ("log", "sqrt", "square", "boxcox", "reciprocal", "cbrt")
# Box-Cox lambda grid -2, -1.9, ..., 2 and the near-zero cut-off.
BOXCOX_FROM, BOXCOX_STEP, BOXCOX_N = -2.0, 0.1, 41
BOXCOX_LOG_CUTOFF = 0.01
RECIPROCAL_NUDGE = 1e-6
RATIO_NUDGE = 1e-10


def _nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# ------------------------------------------------------------------ Box-Cox
def boxcox_shift(df: DataFrame, col: str) -> float:
    """0 when every value is positive, else ``1 - min`` (shift to a minimum of 1)."""
    lo = df.agg(F.min(qcol(col).cast("double"))).first()[0]
    return 0.0 if lo is None or lo > 0 else 1.0 - lo


def boxcox_lambdas() -> list[float]:
    return [BOXCOX_FROM + i * BOXCOX_STEP for i in range(BOXCOX_N)]


def boxcox_profile(df: DataFrame, col: str, shift: float | None = None) -> DataFrame:
    """Profile log-likelihood of the Box-Cox lambda grid for a constant-mean model.

    Two passes: (1) shift, n and mean of ln x (geometric mean); (2) all 41
    variances in one aggregation on ``z = x / geometric mean``.
    ``loglik = -n/2 * ln(SSR)`` with SSR the residual sum of squares of the
    geometric-mean-normalised transform, as in the classic profile.
    """
    shift = boxcox_shift(df, col) if shift is None else shift
    x = qcol(col).cast("double") + F.lit(shift)
    st = df.agg(F.count(qcol(col)).alias("n"), F.avg(F.log(x)).alias("g")).first()
    n, g = st["n"], st["g"]
    if g is None:
        return df.sparkSession.createDataFrame([(i, lam, None) for i, lam in enumerate(boxcox_lambdas())],
                                               "idx long, lambda double, loglik double")
    gm = math.exp(g)
    z = x / F.lit(gm)
    lams = boxcox_lambdas()
    aggs = []
    for i, lam in enumerate(lams):
        t = F.log(z) if lam == 0 else (F.pow(z, F.lit(lam)) - F.lit(1.0)) / F.lit(lam)
        aggs.append(F.var_pop(t).alias(f"v{i}"))
    row = df.agg(*aggs).first()
    rows = []
    for i, lam in enumerate(lams):
        v = row[f"v{i}"]
        ssr = n * gm * gm * v if v is not None else None
        ll = -n / 2.0 * math.log(ssr) if ssr and ssr > 0 else None
        rows.append((i, lam, ll))
    return df.sparkSession.createDataFrame(rows, "idx long, lambda double, loglik double")


def boxcox_lambda(df: DataFrame, col: str, shift: float | None = None) -> float:
    best = None
    for r in boxcox_profile(df, col, shift).collect():
        if r["loglik"] is not None and (best is None or r["loglik"] > best[1]):
            best = (r["lambda"], r["loglik"])
    return 1.0 if best is None else best[0]


# --------------------------------------------------------------- transforms
def transform_expr(df: DataFrame, col: str, kind: str) -> Column:
    """The transformed column (fit steps, if any, run here as small actions)."""
    x = qcol(col).cast("double")
    if kind == "log":
        return _nan_to_null(F.log1p(x))
    if kind == "sqrt":
        return F.sqrt(F.abs(x))
    if kind == "square":
        return x * x
    if kind == "cbrt":
        return F.cbrt(x)
    if kind == "reciprocal":
        any_zero = df.agg(F.max((x == 0).cast("int"))).first()[0]
        nudge = RECIPROCAL_NUDGE if any_zero else 0.0
        return F.try_divide(F.lit(1.0), x + F.lit(nudge))
    if kind == "boxcox":
        shift = boxcox_shift(df, col)
        lam = boxcox_lambda(df, col, shift)
        xs = x + F.lit(shift)
        if abs(lam) < BOXCOX_LOG_CUTOFF:
            return F.log(xs)
        return (F.pow(xs, F.lit(lam)) - F.lit(1.0)) / F.lit(lam)
    raise ValueError(f"unknown transform: {kind}")


def transform(df: DataFrame, col: str, kind: str, name: str | None = None) -> DataFrame:
    """Append ``<col>_<kind>``; the source column stays."""
    return df.withColumn(name or f"{col}_{kind}", transform_expr(df, col, kind))


# ------------------------------------------------------------- interactions
INTERACTION_SUFFIX = {"multiply": "_x_", "add": "_plus_", "divide": "_per_"}


def interact(df: DataFrame, a: str, b: str, op: str, name: str | None = None) -> DataFrame:
    """``a*b``, ``a+b`` or ``a/(b+1e-10)``, named ``a_x_b``, ``a_plus_b``, ``a_per_b``."""
    xa, xb = qcol(a).cast("double"), qcol(b).cast("double")
    if op == "multiply":
        e = xa * xb
    elif op == "add":
        e = xa + xb
    elif op == "divide":
        e = F.try_divide(xa, xb + F.lit(RATIO_NUDGE))
    else:
        raise ValueError(f"unknown interaction: {op}")
    return df.withColumn(name or f"{a}{INTERACTION_SUFFIX[op]}{b}", e)


# ------------------------------------------------------------------ binning
def _fmt_g(v: float, digits: int) -> str:
    s = "%.*g" % (digits, v)
    return s


def interval_labels(breaks: list[float], include_lowest: bool = True, dig_lab: int = 3) -> list[str]:
    """Right-closed interval labels ``(a,b]`` (first ``[a,b]``), with the fewest digits (>= 3) that keep
    neighbouring cut points distinct."""
    nb = len(breaks)
    for dig in range(dig_lab, max(12, dig_lab) + 1):
        ch = [_fmt_g(0.0 + b, dig) for b in breaks]
        if all(ch[i] != ch[i + 1] for i in range(nb - 1)):
            break
    labels = [f"({ch[i]},{ch[i + 1]}]" for i in range(nb - 1)]
    if include_lowest and labels:
        labels[0] = "[" + labels[0][1:]
    return labels


def equal_width_breaks(lo: float, hi: float, n: int) -> list[float]:
    dx = hi - lo
    nb = n + 1
    if dx == 0:
        dx = abs(lo) if lo != 0 else 1.0
        a, b = lo - dx / 1000, hi + dx / 1000
        step = (b - a) / (nb - 1)
        return [a + i * step for i in range(nb)]
    step = (hi - lo) / (nb - 1)
    br = [lo + i * step for i in range(nb)]
    br[0], br[-1] = lo - dx / 1000, hi + dx / 1000
    return br


def _code_from_breaks(x: Column, breaks: list[float]) -> Column:
    """1-based right-closed interval code; the lowest break is included."""
    code = F.lit(1)
    for b in breaks[1:-1]:
        code = code + (x > F.lit(b)).cast("int")
    ok = (x >= F.lit(breaks[0])) & (x <= F.lit(breaks[-1]))
    return F.when(x.isNotNull() & ok, code)


def bin_equal_width(df: DataFrame, col: str, n: int = 5, name: str | None = None) -> DataFrame:
    """``n`` equal-width right-closed intervals over [min, max] (outer cuts widened by 0.1 % of the range);
    the new column holds the interval label."""
    if not 2 <= n:
        raise ValueError("need at least 2 bins")
    x = qcol(col).cast("double")
    st = df.agg(F.min(x), F.max(x)).first()
    if st[0] is None:
        raise ValueError(f"column {col!r} has no values")
    br = equal_width_breaks(float(st[0]), float(st[1]), n)
    labels = interval_labels(br)
    code = _code_from_breaks(x, br)
    return df.withColumn(name or f"{col}_binned", F.element_at(F.array(*[F.lit(s) for s in labels]), code))


def quantile_probs(n: int) -> list[float]:
    step = 1.0 / n
    return [i * step for i in range(n + 1)]


def bin_quantile(df: DataFrame, col: str, n: int = 4, name: str | None = None, *, approx: bool = False
                 ) -> DataFrame:
    """Quantile bins: type-7 cut points at i/n, right-closed, lowest included, integer code 1..n.

    Duplicate cut points raise, as interval cuts must be distinct.
    """
    probs = quantile_probs(n)
    br = quantile_map(df, [col], probs, approx=approx)[col]
    if br[0] is None:
        raise ValueError(f"column {col!r} has no values")
    if len(set(br)) != len(br):
        raise ValueError("'breaks' are not unique")
    x = qcol(col).cast("double")
    return df.withColumn(name or f"{col}_binned", _code_from_breaks(x, br))


# ----------------------------------------------------------------- formulas
# Functions a formula may call (Spark SQL names) and aggregate aliases.
ALLOWED_FUNCTIONS = {
    "abs", "sqrt", "cbrt", "exp", "expm1", "log", "ln", "log10", "log2", "log1p", "pow", "power", "round",
    "floor", "ceil", "ceiling", "sign", "signum", "greatest", "least", "coalesce", "nullif", "if", "nvl",
    "sin", "cos", "tan", "asin", "acos", "atan", "atan2", "sinh", "cosh", "tanh", "pi", "e", "mod", "pmod",
    "cast", "try_divide", "isnull", "isnotnull", "isnan", "nanvl", "length", "lower", "upper", "trim",
    "substr", "substring", "concat", "concat_ws", "double", "int", "bigint", "string",
}
AGGREGATES = {"mean": "avg", "avg": "avg", "sum": "sum", "min": "min", "max": "max", "sd": "stddev_samp",
              "stddev": "stddev_samp", "var": "var_samp", "variance": "var_samp", "count": "count",
              "median": "median"}
_FORBIDDEN = re.compile(r"(;|\bselect\b|\bfrom\b|\bjava_method\b|\breflect\b)", re.IGNORECASE)
_CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")


def _matching_paren(s: str, open_idx: int) -> int:
    depth = 0
    for i in range(open_idx, len(s)):
        if s[i] == "(":
            depth += 1
        elif s[i] == ")":
            depth -= 1
            if depth == 0:
                return i
    raise ValueError("unbalanced parentheses in formula")


def formula(df: DataFrame, name: str, expr: str) -> DataFrame:
    """Add column ``name`` from a Spark SQL expression restricted to an allow-list of functions.

    Whole-column aggregates inside the expression (``value - mean(value)``)
    are computed first in one aggregation pass and inlined as literals, so the
    final step is a plain row-wise projection; they may be nested.  Numeric
    columns enter as doubles; division by zero and NaN give missing values.
    """
    if _FORBIDDEN.search(expr):
        raise ValueError("formula may only be an expression over the table's columns")
    for m in _CALL.finditer(expr):
        fn = m.group(1).lower()
        if fn not in ALLOWED_FUNCTIONS and fn not in AGGREGATES:
            raise ValueError(f"function {fn!r} is not allowed in a formula")
    # numbers are computed as doubles (no integer overflow); a temporary view in a session of its own has
    # division by zero and invalid casts give missing values, without touching the caller's settings
    spark = df.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.ansi.enabled", "false")
    view = f"formula_{uuid.uuid4().hex}"
    kept = {f"__kept{i}": c for i, c in enumerate(df.columns)}
    (as_double(df.select("*", *[qcol(c).alias(k) for k, c in kept.items()]), numeric_columns(df)).createGlobalTempView(view))
    source = f"global_temp.{view}"
    try:
        # innermost aggregates first: each round computes those that hold no other aggregate, as literals
        while True:
            inner = _inner_aggregates(expr)
            if not inner:
                break
            values: list[object] = [None] * len(inner)
            plain = [k for k, (_, _, fn, _) in enumerate(inner) if fn != "median"]
            if plain:
                row = own.sql("SELECT " + ", ".join(f"{inner[k][2]}({inner[k][3]}) AS a{k}" for k in plain) + f" FROM {source}").first()
                for k in plain:
                    values[k] = row[f"a{k}"]
            for k, (_, _, fn, arg) in enumerate(inner):
                if fn == "median":
                    values[k] = quantile_map(own.sql(f"SELECT CAST({arg} AS DOUBLE) AS m FROM {source}"), ["m"], [0.5])["m"][0]
            out, last = [], 0
            for (start, end, _, _), v in zip(inner, values):
                out.append(expr[last:start])
                out.append("CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)")
                last = end
            expr = "".join([*out, expr[last:]])
        hidden = ", ".join(kept)
        made = own.sql(f"SELECT {hidden}, ({expr}) AS `{name.replace('`', '``')}` FROM {source}")
        value = qcol(name)
        if isinstance(made.schema[name].dataType, (T.DoubleType, T.FloatType)):
            value = _nan_to_null(value)
        # the caller's columns come back as they were
        return made.select(*[F.col(k).alias(c) for k, c in kept.items() if c != name], value.alias(name))
    finally:
        own.catalog.dropGlobalTempView(view)


def _inner_aggregates(expr: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, function, argument)`` of the aggregate calls that hold no other aggregate call."""
    found = []
    for m in _CALL.finditer(expr):
        fn = m.group(1).lower()
        if fn in AGGREGATES:
            close = _matching_paren(expr, m.end() - 1)
            arg = expr[m.end():close]
            if not any(c.group(1).lower() in AGGREGATES for c in _CALL.finditer(arg)):
                found.append((m.start(), close + 1, AGGREGATES[fn], arg))
    return found


# ------------------------------------------------------------------ preview
def transform_preview(df: DataFrame, col: str, kind: str, bins: int = 30, n_grid: int = 512) -> DataFrame:
    """Density-scaled 30-bin histogram and KDE of the raw and the transformed column, stacked by stage."""
    from .explore import density, histogram

    t = transform(df, col, kind, name="_t")
    frames = []
    for stage, c in (("before", col), ("after", "_t")):
        h = histogram(t, c, bins).select(F.lit(stage).alias("stage"), F.lit("histogram").alias("layer"),
                                         F.col("bin").alias("idx"), "x", F.col("density").alias("y"))
        d = density(t, c, None, n_grid).select(F.lit(stage).alias("stage"), F.lit("density").alias("layer"),
                                                 "idx", "x", F.col("density").alias("y"))
        frames += [h, d]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
