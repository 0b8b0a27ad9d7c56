"""Registered queries: OLS fit, influence diagnostics, removal and refit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import qnorm_sql
from ..operators import regress as G
from .common import S, finish, table
from .common import S as sig

Y, XS, IDS = "l_extendedprice", ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"]


def _li(s, sf):
    return table(s, sf, "lineitem")


def _model(s, sf):
    return G.ols_fit(_li(s, sf), Y, XS)


def ols_refit(s, sf):
    m, _ = G.ols_refit(_li(s, sf), Y, XS, rounds=1)
    return finish(G.coef_frame(s, m).withColumn("n", F.lit(m.n).cast("long")))


def _first_line(s, sf):
    """The one row (of the least order key and line) that the dummy marks."""
    return _li(s, sf).orderBy(*IDS).select(*IDS).first()


def influence_leverage_one(s, sf):
    key = _first_line(s, sf)
    one = (F.col("l_orderkey") == key[0]) & (F.col("l_linenumber") == key[1])
    df = _li(s, sf).select(*IDS, Y, "l_quantity", one.cast("double").alias("l_discount"))
    return G.influence(df, G.ols_fit(df, Y, XS), IDS)


def ols_mixed_scale(s, sf):
    """One predictor up to 1e12 and one up to 0.1."""
    df = _li(s, sf).select(*IDS, Y, (F.col("l_orderkey") * 1e7).alias("l_quantity"), "l_discount")
    return finish(G.coef_frame(s, G.ols_fit(df, Y, XS)), 6)


def _dependent(s, sf):
    """With two more predictors, a constant one and the sum of the others' multiples."""
    df = _li(s, sf).withColumn("one_price", F.lit(7.5)).withColumn("both", F.col("l_quantity") * 3 + F.col("l_discount") * 200 + 1)
    return df, G.ols_fit(df, Y, ["one_price", *XS, "both"])


def ols_dependent(s, sf):
    return finish(G.coef_frame(s, _dependent(s, sf)[1]))


QUERIES = {
    "ols_dependent": ols_dependent,
    "influence_dependent": lambda s, sf: G.influence(*_dependent(s, sf), IDS),
    "influence_leverage_one": influence_leverage_one,
    "ols_mixed_scale": ols_mixed_scale,
    "residual_trend": lambda s, sf: finish(G.residual_trend(_li(s, sf), _model(s, sf)), 6),
    "ols_coef": lambda s, sf: finish(G.coef_frame(s, _model(s, sf))),
    "ols_summary": lambda s, sf: G.summary_frame(s, _model(s, sf)),
    # tail probabilities come from a continued fraction: compare at 6 significant digits
    "ols_full_summary": lambda s, sf: finish(G.full_summary(_li(s, sf), _model(s, sf)), 6),
    "influence": lambda s, sf: G.influence(_li(s, sf), _model(s, sf), IDS),
    "influence_counts": lambda s, sf: finish(G.influence_counts(_li(s, sf), _model(s, sf), IDS)),
    "influential_top": lambda s, sf: G.influential_top(_li(s, sf), _model(s, sf), IDS),
    "influence_sorted": lambda s, sf: G.influence_sorted(_li(s, sf), _model(s, sf), IDS),
    "ols_refit": ols_refit,
    # residuals are differences of ~5e4-sized numbers: compare at 6 significant digits
    "residual_points": lambda s, sf: finish(G.residual_points(_li(s, sf), _model(s, sf), IDS), 6),
    "leverage_points": lambda s, sf: finish(G.leverage_points(_li(s, sf), _model(s, sf), IDS)),
}

# ---------------------------------------------------------------- SQL twins
R4 = lambda e: f"CAST(floor(({e}) * 10000.0 + 0.5) AS DOUBLE) / 10000.0"


def _fit_ctes(src: str, p: str = "") -> str:
    """CTEs {p}b (rows), {p}k (fit: n, means, S, det, b1, b2, a, sse, s2)."""
    return (
        f"{p}b AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x1, "
        f"CAST(l_discount AS DOUBLE) AS x2 FROM {src} WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL "
        f"AND l_discount IS NOT NULL), "
        f"{p}m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM {p}b), "
        f"{p}s AS (SELECT sum((x1 - m1) * (x1 - m1)) AS s11, sum((x1 - m1) * (x2 - m2)) AS s12, "
        f"sum((x2 - m2) * (x2 - m2)) AS s22, sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y, "
        f"sum((y - my) * (y - my)) AS syy FROM {p}b, {p}m), "
        f"{p}c AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM {p}s, {p}m), "
        f"{p}f AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM {p}c), "
        f"{p}k AS (SELECT *, my - b1 * m1 - b2 * m2 AS a, greatest(syy - (b1 * s1y + b2 * s2y), 0.0) AS sse, "
        f"greatest(syy - (b1 * s1y + b2 * s2y), 0.0) / (n - 3) AS s2 FROM {p}f)"
    )


def _diag_ctes(p: str = "") -> str:
    return (
        f"{p}d AS (SELECT {p}b.l_orderkey, {p}b.l_linenumber, {p}b.y, {p}b.x1, {p}b.x2, {p}k.*, "
        f"1.0 / n + (s22 * (x1 - m1) * (x1 - m1) - 2 * s12 * (x1 - m1) * (x2 - m2) + s11 * (x2 - m2) * (x2 - m2)) / det AS h, "
        f"a + b1 * x1 + b2 * x2 AS fitted, y - (a + b1 * x1 + b2 * x2) AS e FROM {p}b, {p}k), "
        f"{p}r AS (SELECT *, e / (sqrt(s2) * sqrt(1 - h)) AS r FROM {p}d), "
        f"{p}z AS (SELECT *, r * r * h / ((1 - h) * 3) AS cook, "
        f"e / (sqrt(((n - 3) * s2 - e * e / (1 - h)) / (n - 3 - 1)) * sqrt(1 - h)) * sqrt(h / (1 - h)) AS dffits, "
        f"r * r * h / ((1 - h) * 3) > 4.0 / n AS infl, h > 2.0 * 3 / n AS lev FROM {p}r)"
    )


STATUS = (f"CASE WHEN infl AND lev THEN '{G.STATUS_BOTH}' WHEN infl THEN '{G.STATUS_INFLUENCE}' "
          f"WHEN lev THEN '{G.STATUS_LEVERAGE}' ELSE '{G.STATUS_NORMAL}' END")
BASE = "WITH " + _fit_ctes("lineitem") + ", " + _diag_ctes() + " "


def _coef_select(k: str, digits: int = 9) -> str:
    def S(expr, alias=None):  # noqa: N802
        return sig(expr, alias, digits)

    return (
        f"SELECT '(Intercept)' AS term, {S('a', 'estimate')}, "
        f"{S('sqrt(s2 * (1.0 / n + (s22 * m1 * m1 - 2 * s12 * m1 * m2 + s11 * m2 * m2) / det))', 'std_error')}, "
        f"{S('a / sqrt(s2 * (1.0 / n + (s22 * m1 * m1 - 2 * s12 * m1 * m2 + s11 * m2 * m2) / det))', 't_value')} FROM {k} "
        f"UNION ALL SELECT 'l_quantity', {S('b1')}, {S('sqrt(s2 * s22 / det)')}, {S('b1 / sqrt(s2 * s22 / det)')} FROM {k} "
        f"UNION ALL SELECT 'l_discount', {S('b2')}, {S('sqrt(s2 * s11 / det)')}, {S('b2 / sqrt(s2 * s11 / det)')} FROM {k}"
    )


INFL_COLS = (f"l_orderkey, l_linenumber, {R4('cook')} AS cooks_distance, {R4('h')} AS leverage, "
             f"{R4('r')} AS std_residual, {R4('dffits')} AS dffits, infl AS influential, lev AS high_leverage, "
             f"{STATUS} AS status")


def _refit_sql() -> str:
    return ("WITH " + _fit_ctes("lineitem") + ", " + _diag_ctes() + ", "
            "kept AS (SELECT l_orderkey, l_linenumber, y AS l_extendedprice, x1 AS l_quantity, x2 AS l_discount "
            "FROM z WHERE NOT infl), " + _fit_ctes("kept", "q") +
            f" SELECT t.*, CAST((SELECT n FROM qk) AS BIGINT) AS n FROM ({_coef_select('qk')}) t")


BETA_ITER = 3000


def _betainc_ctes(inputs: str) -> str:
    """CTEs computing I_x(a, b) for rows ``(id, a, b, x)`` of ``inputs`` by the continued fraction
    (modified Lentz, fixed iteration count), using the symmetry I_x(a,b) = 1 - I_{1-x}(b,a) so the
    fraction converges.  Result: CTE ``bi(id, ix)``."""
    return (
        f"bin AS ({inputs}), "
        "bsw AS (SELECT id, a, b, x, x < (a + 1) / (a + b + 2) AS direct FROM bin), "
        "bp AS (SELECT id, direct, CASE WHEN direct THEN a ELSE b END AS pa, CASE WHEN direct THEN b ELSE a END AS pb, "
        "CASE WHEN direct THEN x ELSE 1 - x END AS px, a, b, x FROM bsw), "
        # anchor columns typed DOUBLE: a recursive CTE keeps the anchor's types (1.0 alone is a DECIMAL)
        "lz(id, m, c, d, h) AS (SELECT id, 0, CAST(1.0 AS DOUBLE), CAST(1.0 / (1 - (pa + pb) * px / (pa + 1)) AS DOUBLE), "
        "CAST(1.0 / (1 - (pa + pb) * px / (pa + 1)) AS DOUBLE) FROM bp "
        "UNION ALL SELECT lz.id, lz.m + 1, "
        # even step then odd step, folded into one recursion row
        "1 + (-(pa + lz.m + 1) * (pa + pb + lz.m + 1) * px / ((pa + 2 * (lz.m + 1)) * (pa + 1 + 2 * (lz.m + 1)))) / "
        "(1 + ((lz.m + 1) * (pb - (lz.m + 1)) * px / ((pa - 1 + 2 * (lz.m + 1)) * (pa + 2 * (lz.m + 1)))) / lz.c), "
        "1.0 / (1 + (-(pa + lz.m + 1) * (pa + pb + lz.m + 1) * px / ((pa + 2 * (lz.m + 1)) * (pa + 1 + 2 * (lz.m + 1)))) * "
        "(1.0 / (1 + ((lz.m + 1) * (pb - (lz.m + 1)) * px / ((pa - 1 + 2 * (lz.m + 1)) * (pa + 2 * (lz.m + 1)))) * lz.d))), "
        "lz.h * (1.0 / (1 + ((lz.m + 1) * (pb - (lz.m + 1)) * px / ((pa - 1 + 2 * (lz.m + 1)) * (pa + 2 * (lz.m + 1)))) * lz.d)) "
        "* (1 + ((lz.m + 1) * (pb - (lz.m + 1)) * px / ((pa - 1 + 2 * (lz.m + 1)) * (pa + 2 * (lz.m + 1)))) / lz.c) "
        "* (1.0 / (1 + (-(pa + lz.m + 1) * (pa + pb + lz.m + 1) * px / ((pa + 2 * (lz.m + 1)) * (pa + 1 + 2 * (lz.m + 1)))) * "
        "(1.0 / (1 + ((lz.m + 1) * (pb - (lz.m + 1)) * px / ((pa - 1 + 2 * (lz.m + 1)) * (pa + 2 * (lz.m + 1)))) * lz.d)))) "
        "* (1 + (-(pa + lz.m + 1) * (pa + pb + lz.m + 1) * px / ((pa + 2 * (lz.m + 1)) * (pa + 1 + 2 * (lz.m + 1)))) / "
        "(1 + ((lz.m + 1) * (pb - (lz.m + 1)) * px / ((pa - 1 + 2 * (lz.m + 1)) * (pa + 2 * (lz.m + 1)))) / lz.c)) "
        f"FROM lz JOIN bp ON bp.id = lz.id WHERE lz.m < {BETA_ITER}), "
        f"bh AS (SELECT id, h FROM lz WHERE m = {BETA_ITER}), "
        "bi AS (SELECT bp.id, CASE WHEN x <= 0 THEN 0.0 WHEN x >= 1 THEN 1.0 "
        "ELSE (CASE WHEN direct THEN 1 ELSE -1 END) * exp(lgamma(pa + pb) - lgamma(pa) - lgamma(pb) + pa * ln(px) "
        "+ pb * ln(1 - px)) * h / pa + CASE WHEN direct THEN 0.0 ELSE 1.0 END END AS ix FROM bp JOIN bh USING (id))"
    )


def _full_summary_sql() -> str:
    coef = ("co AS (SELECT 1 AS id, '(Intercept)' AS term, a AS est, "
            "sqrt(s2 * (1.0 / n + (s22 * m1 * m1 - 2 * s12 * m1 * m2 + s11 * m2 * m2) / det)) AS se FROM k "
            "UNION ALL SELECT 2, 'l_quantity', b1, sqrt(s2 * s22 / det) FROM k "
            "UNION ALL SELECT 3, 'l_discount', b2, sqrt(s2 * s11 / det) FROM k), "
            "ct AS (SELECT co.*, est / se AS t, k.n - 3 AS df FROM co, k), "
            "fs AS (SELECT ((syy - sse) / 2) / s2 AS f, n - 3 AS df2 FROM k), ")
    inputs = ("SELECT id, df / 2.0 AS a, 0.5 AS b, df / (df + t * t) AS x FROM ct "
              "UNION ALL SELECT 4, df2 / 2.0, 1.0, df2 / (df2 + 2 * f) FROM fs")
    res = ("rq AS (SELECT quantile_cont(e, 0.0) AS r0, quantile_cont(e, 0.25) AS r1, quantile_cont(e, 0.5) AS r2, "
           "quantile_cont(e, 0.75) AS r3, quantile_cont(e, 1.0) AS r4 FROM d) ")
    rows = []
    for term in ("(Intercept)", "l_quantity", "l_discount"):
        rows += [f"SELECT 'coefficient' AS section, '{term}:estimate' AS name, est AS value FROM ct WHERE term = '{term}'",
                 f"SELECT 'coefficient', '{term}:std_error', se FROM ct WHERE term = '{term}'",
                 f"SELECT 'coefficient', '{term}:t_value', t FROM ct WHERE term = '{term}'",
                 f"SELECT 'coefficient', '{term}:p_value', ix FROM ct JOIN bi USING (id) WHERE term = '{term}'"]
    rows += ["SELECT 'fit', 'residual_std_error', sqrt(s2) FROM k",
             "SELECT 'fit', 'df_residual', CAST(n - 3 AS DOUBLE) FROM k",
             "SELECT 'fit', 'r_squared', 1 - sse / syy FROM k",
             "SELECT 'fit', 'adj_r_squared', 1 - (sse / syy) * (n - 1) / (n - 3) FROM k",
             "SELECT 'fit', 'f_statistic', f FROM fs",
             "SELECT 'fit', 'f_p_value', ix FROM bi WHERE id = 4",
             "SELECT 'residuals', 'min', r0 FROM rq", "SELECT 'residuals', 'q1', r1 FROM rq",
             "SELECT 'residuals', 'median', r2 FROM rq", "SELECT 'residuals', 'q3', r3 FROM rq",
             "SELECT 'residuals', 'max', r4 FROM rq"]
    body = " UNION ALL ".join(rows)
    return ("WITH RECURSIVE " + _fit_ctes("lineitem") + ", " + _diag_ctes() + ", " + coef + _betainc_ctes(inputs)
            + ", " + res + f"SELECT section, name, {S('value', digits=6)} AS value FROM ({body})")


def _residual_sql() -> str:
    p = "(mid - a_) / (n + 1 - 2 * a_)"
    return (BASE + ", rk AS (SELECT *, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS mid, "
            "CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END AS a_ FROM z) "
            f"SELECT l_orderkey, l_linenumber, {S('fitted', 'fitted', 6)}, {S('e', 'residual', 6)}, "
            f"{S('r', 'std_residual', 6)}, {S('sqrt(abs(r))', 'sqrt_abs_std_residual', 6)}, "
            f"{S('cook', 'cooks_distance', 6)}, {S(qnorm_sql(p), 'theoretical', 6)} FROM rk")


_ONE = "(l_orderkey, l_linenumber) = (SELECT (l_orderkey, l_linenumber) FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1)"
_LEVERAGE_SRC = f"(SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, CAST({_ONE} AS DOUBLE) AS l_discount FROM lineitem)"
_FULL = "1 - h <= 1e-9"
_SCALE_SRC = "(SELECT l_orderkey, l_linenumber, l_extendedprice, l_orderkey * 1e7 AS l_quantity, l_discount FROM lineitem)"


def _leverage_one_sql() -> str:
    """Rows of full leverage have no scaled diagnostics and are not influential."""
    diag = _diag_ctes().replace("e / (sqrt(s2) * sqrt(1 - h)) AS r", f"CASE WHEN {_FULL} THEN NULL ELSE e / (sqrt(s2) * sqrt(greatest(1 - h, 1e-300))) END AS r")
    diag = diag.replace("e / (sqrt(((n - 3) * s2 - e * e / (1 - h)) / (n - 3 - 1)) * sqrt(1 - h)) * sqrt(h / (1 - h)) AS dffits",
                        f"CASE WHEN {_FULL} THEN NULL ELSE e / (sqrt(abs((n - 3) * s2 - e * e / (1 - h)) / (n - 3 - 1)) * sqrt(abs(1 - h))) * sqrt(abs(h / (1 - h))) END AS dffits")
    diag = diag.replace("r * r * h / ((1 - h) * 3) > 4.0 / n AS infl", "coalesce(r * r * h / ((1 - h) * 3) > 4.0 / n, FALSE) AS infl")
    cols = INFL_COLS.replace(f"{R4('h')} AS leverage", f"{R4('least(h, 1.0)')} AS leverage")
    return "WITH " + _fit_ctes(_LEVERAGE_SRC) + ", " + diag + f" SELECT {cols} FROM z"


ORACLE = {
    "influence_leverage_one": _leverage_one_sql(),
    "ols_mixed_scale": "WITH " + _fit_ctes(_SCALE_SRC) + " " + _coef_select("k", 6),
    "residual_trend": (BASE + ", ft AS (SELECT *, min(fitted) OVER () AS lo, (max(fitted) OVER () - min(fitted) OVER ()) / 20.0 AS w FROM z) "
                       f"SELECT CAST(least(floor((fitted - lo) / w), 19) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, {S('avg(fitted)', 'fitted', 6)}, "
                       f"{S('avg(e)', 'residual', 6)}, {S('avg(sqrt(abs(r)))', 'sqrt_abs_std_residual', 6)} FROM ft GROUP BY 1"),
    "ols_full_summary": _full_summary_sql(),
    "ols_dependent": ("WITH " + _fit_ctes("lineitem") + " " + _coef_select("k")
                      + " UNION ALL SELECT t, NULL, NULL, NULL FROM (VALUES ('one_price'), ('both')) v(t)"),
    "influence_dependent": BASE + f"SELECT {INFL_COLS} FROM z",
    "ols_coef": "WITH " + _fit_ctes("lineitem") + " " + _coef_select("k"),
    "ols_summary": ("WITH " + _fit_ctes("lineitem") + f" SELECT {R4('1 - sse / syy')} AS r_squared, "
                    f"{R4('1 - (sse / syy) * (n - 1) / (n - 3)')} AS adj_r_squared, CAST(n AS BIGINT) AS n FROM k"),
    "influence": BASE + f"SELECT {INFL_COLS} FROM z",
    "influence_counts": (BASE + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(infl AS INTEGER)) AS BIGINT) "
                         "AS n_influential, CAST(sum(CAST(lev AS INTEGER)) AS BIGINT) AS n_high_leverage, "
                         f"{S('4.0 / max(n)', 'cook_threshold')}, {S('6.0 / max(n)', 'leverage_threshold')} FROM z"),
    "influential_top": (BASE + f"SELECT l_orderkey, l_linenumber, {R4('cook')} AS cooks_distance, {R4('h')} AS leverage, "
                        f"{R4('r')} AS std_residual, {R4('dffits')} AS dffits, {STATUS} AS status FROM z WHERE infl"),
    "influence_sorted": BASE + f"SELECT {INFL_COLS} FROM z",
    "ols_refit": _refit_sql(),
    "residual_points": _residual_sql(),
    "leverage_points": (BASE + f"SELECT l_orderkey, l_linenumber, {S(R4('cook'), 'cooks_distance')}, "
                        f"{S(R4('h'), 'leverage')}, {S(R4('r'), 'std_residual')}, {STATUS} AS status, "
                        f"{S('4.0 / n', 'cook_threshold')}, {S('6.0 / n', 'leverage_threshold')} FROM z"),
}
