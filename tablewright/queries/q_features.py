"""Registered queries: transforms, Box-Cox, interactions, bins, formulas, preview, moments, normality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as D
from ..operators import moments as M
from .common import EVENTS_NUM_SQL, S, events_num, finish, table
from .sqlgen import SQRT_2PI, density_sql, histogram_sql


def _tf(tbl, keys, col, kind):
    def q(s, sf):
        df = table(s, sf, tbl).select(*keys, col)
        return finish(D.transform(df, col, kind))
    return q


def _ix(op):
    def q(s, sf):
        df = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
        return finish(D.interact(df, "l_extendedprice", "l_discount", op))
    return q


def bin_equal_width(s, sf):
    df = table(s, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.bin_equal_width(df, "o_totalprice", 10)


def bin_quantile(s, sf):
    df = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return D.bin_quantile(df, "l_extendedprice", 4)


def transform_preview(s, sf):
    return finish(D.transform_preview(table(s, sf, "events").select("value"), "value", "log"))


def moments_report(s, sf):
    return M.moments_report(table(s, sf, "documents"))


def normality_test(s, sf):
    df = events_num(s, sf)
    return finish(M.shapiro_wilk(df, ["value", "value_sparse", "user_id"], "event_id", M.SHAPIRO_MAX_N), 6)


def normality_all_rows(s, sf):
    return finish(M.shapiro_wilk(events_num(s, sf), ["value", "value_sparse", "user_id"]), 6)


def jarque_bera(s, sf):
    return finish(M.jarque_bera(events_num(s, sf), ["value", "value_sparse", "user_id"]), 6)


def formula_large_int(s, sf):
    big = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + 2000000000).cast("int").alias("a"),
                                          (F.col("l_linenumber") + 2000000000).cast("int").alias("b"))
    out = D.formula(big, "product", "a * b")
    return finish(D.formula(out, "spread", "mean(abs(a - mean(a))) / (l_linenumber - 1)"))


QUERIES = {
    "tf_log": _tf("events", ["event_id"], "value", "log"),
    "tf_sqrt": _tf("customer", ["c_custkey"], "c_acctbal", "sqrt"),
    "tf_square": _tf("customer", ["c_custkey"], "c_acctbal", "square"),
    "tf_reciprocal": _tf("lineitem", ["l_orderkey", "l_linenumber"], "l_discount", "reciprocal"),
    "tf_cbrt": _tf("customer", ["c_custkey"], "c_acctbal", "cbrt"),
    "tf_boxcox": _tf("customer", ["c_custkey"], "c_acctbal", "boxcox"),
    "boxcox_profile": lambda s, sf: finish(D.boxcox_profile(table(s, sf, "customer"), "c_acctbal")),
    "ix_multiply": _ix("multiply"),
    "ix_add": _ix("add"),
    "ix_ratio": _ix("divide"),
    "bin_equal_width": bin_equal_width,
    "bin_quantile": bin_quantile,
    "formula_ratio": lambda s, sf: finish(D.formula(
        table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"),
        "unit_price", "l_extendedprice / l_quantity")),
    "formula_center": lambda s, sf: finish(D.formula(
        table(s, sf, "events").select("event_id", "value"), "value_centered", "value - mean(value)")),
    "transform_preview": transform_preview,
    "moments_report": moments_report,
    "normality_test": normality_test,
    "normality_all_rows": normality_all_rows,
    "jarque_bera": jarque_bera,
    "formula_large_int": formula_large_int,
}

# ---------------------------------------------------------------- SQL twins
BOXCOX_CTES = (
    "bs AS (SELECT CASE WHEN min(c_acctbal) > 0 THEN 0.0 ELSE 1.0 - min(c_acctbal) END AS shift FROM customer), "
    "bx AS (SELECT c_custkey, c_acctbal, c_acctbal + shift AS x FROM customer, bs), "
    "bg AS (SELECT count(*) AS n, avg(ln(x)) AS g FROM bx), "
    "bgrid AS (SELECT i AS idx, -2.0 + i * CAST(0.1 AS DOUBLE) AS lam FROM range(0, 41) t(i)), "
    "bv AS (SELECT idx, lam, var_pop(CASE WHEN lam = 0 THEN ln(x / exp(g)) "
    "ELSE (pow(x / exp(g), lam) - 1.0) / lam END) AS v FROM bx, bg, bgrid GROUP BY idx, lam), "
    "bll AS (SELECT idx, lam, -n / 2.0 * ln(n * exp(g) * exp(g) * v) AS ll FROM bv, bg), "
    "best AS (SELECT lam FROM bll ORDER BY ll DESC LIMIT 1) "
)


def _boxcox_sql() -> str:
    t = ("CASE WHEN abs(best.lam) < 0.01 THEN ln(x) ELSE (pow(x, best.lam) - 1.0) / best.lam END")
    return f"WITH {BOXCOX_CTES} SELECT c_custkey, {S('c_acctbal', 'c_acctbal')}, {S(t, 'c_acctbal_boxcox')} FROM bx, best"


def _bin_width_sql() -> str:
    n = 10
    br = ("WITH st AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), "
          f"b AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) / 1000 WHEN i = {n} THEN hi + (hi - lo) / 1000 "
          f"ELSE lo + i * ((hi - lo) / {n}.0) END AS br FROM st, range(0, {n + 1}) t(i)), "
          "lab AS (SELECT b1.i + 1 AS code, CASE WHEN b1.i = 0 THEN '[' ELSE '(' END || printf('%.3g', b1.br) || ',' "
          "|| printf('%.3g', b2.br) || ']' AS label FROM b b1 JOIN b b2 ON b2.i = b1.i + 1), "
          "codes AS (SELECT o_orderkey, o_totalprice, 1 + (SELECT count(*) FROM b WHERE i BETWEEN 1 AND "
          f"{n - 1} AND o_totalprice > br) AS code FROM orders) ")
    return br + "SELECT o_orderkey, o_totalprice, lab.label AS o_totalprice_binned FROM codes JOIN lab USING (code)"


def _bin_quantile_sql() -> str:
    probs = D.quantile_probs(4)
    plist = ", ".join(repr(p) for p in probs)
    return ("WITH q AS (SELECT quantile_cont(l_extendedprice, [" + plist + "]) AS br FROM lineitem) "
            "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(1 + CAST(l_extendedprice > br[2] AS INTEGER) + "
            "CAST(l_extendedprice > br[3] AS INTEGER) + CAST(l_extendedprice > br[4] AS INTEGER) AS INTEGER) "
            "AS l_extendedprice_binned FROM lineitem, q")


def _preview_sql() -> str:
    src = "(SELECT value, ln(value + 1) AS t FROM events)"
    parts = []
    for stage, col in (("before", "value"), ("after", "t")):
        h = histogram_sql(src, col, 30)
        parts.append(f"SELECT '{stage}' AS stage, 'histogram' AS layer, bin AS idx, x, density AS y FROM ({h})")
        d = "WITH " + density_sql(src, col, None, 512, prefix=f"{stage[0]}") + \
            f"SELECT idx, gx, k / (n * bw * {SQRT_2PI!r}) AS dens FROM {stage[0]}dk"
        parts.append(f"SELECT '{stage}' AS stage, 'density' AS layer, CAST(idx AS BIGINT) AS idx, {S('gx')} AS x, "
                     f"{S('dens')} AS y FROM ({d})")
    return " UNION ALL ".join(parts)


def _moments_sql() -> str:
    parts = []
    for i, c in enumerate(["doc_id", "n_chars"]):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(x) AS n, "
            "avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS sk, "
            "avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) AS ku, stddev_pop(x) AS sd "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM documents)")
    body = " UNION ALL ".join(parts)
    r3 = lambda e: f"CAST(floor(({e}) * 1000.0 + 0.5) AS DOUBLE) / 1000.0"
    return (
        f"WITH mm AS ({body}) SELECT CAST(position AS INTEGER) AS position, \"column\", CAST(n AS BIGINT) AS n, "
        f"{r3('sk')} AS skewness, {r3('ku')} AS kurtosis, "
        f"CASE WHEN sk < -0.5 THEN '{M.DIR_LEFT}' WHEN sk > 0.5 THEN '{M.DIR_RIGHT}' ELSE '{M.DIR_SYM}' END "
        f"AS skew_direction, CASE WHEN abs(sk) > 2 THEN '{M.ADV_STRONG}' WHEN abs(sk) > 1 THEN '{M.ADV_MODERATE}' "
        f"WHEN abs(sk) > 0.5 THEN '{M.ADV_MILD}' ELSE '{M.ADV_NONE}' END AS suggestion FROM mm")


def _poly_sql(coefs, x: str) -> str:
    acc = repr(float(coefs[-1]))
    for a in reversed(coefs[:-1]):
        acc = f"({acc} * {x} + {float(a)!r})"
    return acc


def _shapiro_sql(limit: int | None) -> str:
    from ..functions.special import pnorm_sql, qnorm_sql

    cols = ["value", "value_sparse", "user_id"]
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, event_id, CAST({c} AS DOUBLE) AS x FROM ev WHERE {c} IS NOT NULL"
                              for c in cols)
    z = "((y - mu) / sigma)"
    return (
        f"WITH ev AS {EVENTS_NUM_SQL}, lg AS ({long}), "
        "fv AS (SELECT col, x FROM (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY event_id) AS rn "
        f"FROM lg){'' if limit is None else f' WHERE rn <= {limit}'}), "
        "srt AS (SELECT col, x, row_number() OVER (PARTITION BY col ORDER BY x) AS i, count(*) OVER (PARTITION BY col) AS n FROM fv), "
        f"half AS (SELECT col, i, n, {qnorm_sql('(i - 0.375) / (n + 0.25)')} AS m FROM srt WHERE i <= n // 2), "
        "ag AS (SELECT col, n, 2 * sum(m * m) AS summ2, max(CASE WHEN i = 1 THEN m END) AS m1, "
        "max(CASE WHEN i = 2 THEN m END) AS m2 FROM half GROUP BY col, n), "
        "cf AS (SELECT *, 1.0 / sqrt(n) AS rsn, sqrt(summ2) AS ssumm2 FROM ag), "
        f"a12 AS (SELECT *, {_poly_sql(M.SW_C1, 'rsn')} - m1 / ssumm2 AS a1, -m2 / ssumm2 + {_poly_sql(M.SW_C2, 'rsn')} AS a2 FROM cf), "
        "fc AS (SELECT *, CASE WHEN n > 5 THEN sqrt((summ2 - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) "
        "ELSE sqrt((summ2 - 2 * m1 * m1) / (1 - 2 * a1 * a1)) END AS fac FROM a12), "
        "ai AS (SELECT h.col, h.i, CASE WHEN h.i = 1 THEN f.a1 WHEN h.i = 2 AND f.n > 5 THEN f.a2 ELSE -h.m / f.fac END AS a "
        "FROM half h JOIN fc f USING (col)), "
        "w AS (SELECT s.col, s.x, s.n, CASE WHEN s.i <= s.n // 2 THEN -lo.a WHEN s.i > s.n - s.n // 2 THEN hi.a ELSE 0.0 END AS w "
        "FROM srt s LEFT JOIN ai lo ON lo.col = s.col AND lo.i = s.i LEFT JOIN ai hi ON hi.col = s.col AND hi.i = s.n + 1 - s.i), "
        "st AS (SELECT col, avg(x) AS mx, avg(w) AS mw FROM w GROUP BY col), "
        "ww AS (SELECT w.col, w.n, sum((w.w - mw) * (w.x - mx)) AS sxy, sum((w.w - mw) * (w.w - mw)) AS sww, "
        "sum((w.x - mx) * (w.x - mx)) AS sxx FROM w JOIN st USING (col) GROUP BY w.col, w.n), "
        "ws AS (SELECT col, n, least(sxy * sxy / (sww * sxx), 1.0) AS wv FROM ww), "
        f"pr AS (SELECT col, n, wv, ln(1 - wv) AS y, {_poly_sql(M.SW_C5, 'ln(n)')} AS mu, "
        f"exp({_poly_sql(M.SW_C6, 'ln(n)')}) AS sigma FROM ws) "
        f"SELECT col AS \"column\", CAST(n AS BIGINT) AS n, {S('wv', 'w', 6)}, "
        f"{S(pnorm_sql('-' + z), 'p_value', 6)} FROM pr"
    )


LI = "lineitem"
_JB = ("count(x) / 6.0 * (power(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), 2) "
       "+ power(avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3, 2) / 4.0)")
ORACLE = {
    "tf_log": f"SELECT event_id, {S('value', 'value')}, {S('ln(value + 1)', 'value_log')} FROM events",
    "tf_sqrt": f"SELECT c_custkey, {S('c_acctbal', 'c_acctbal')}, {S('sqrt(abs(c_acctbal))', 'c_acctbal_sqrt')} FROM customer",
    "tf_square": f"SELECT c_custkey, {S('c_acctbal', 'c_acctbal')}, {S('c_acctbal * c_acctbal', 'c_acctbal_square')} FROM customer",
    "tf_reciprocal": (f"SELECT l_orderkey, l_linenumber, {S('l_discount', 'l_discount')}, "
                      f"{S('1.0 / (l_discount + CASE WHEN (SELECT max(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) FROM lineitem) = 1 THEN 1e-6 ELSE 0.0 END)', 'l_discount_reciprocal')} "
                      "FROM lineitem"),
    "tf_cbrt": f"SELECT c_custkey, {S('c_acctbal', 'c_acctbal')}, {S('cbrt(c_acctbal)', 'c_acctbal_cbrt')} FROM customer",
    "tf_boxcox": _boxcox_sql(),
    "boxcox_profile": f"WITH {BOXCOX_CTES} SELECT CAST(idx AS BIGINT) AS idx, {S('lam', 'lambda')}, {S('ll', 'loglik')} FROM bll",
    "ix_multiply": (f"SELECT l_orderkey, l_linenumber, {S('l_extendedprice', 'l_extendedprice')}, {S('l_discount', 'l_discount')}, "
                    f"{S('l_extendedprice * l_discount', 'l_extendedprice_x_l_discount')} FROM {LI}"),
    "ix_add": (f"SELECT l_orderkey, l_linenumber, {S('l_extendedprice', 'l_extendedprice')}, {S('l_discount', 'l_discount')}, "
               f"{S('l_extendedprice + l_discount', 'l_extendedprice_plus_l_discount')} FROM {LI}"),
    "ix_ratio": (f"SELECT l_orderkey, l_linenumber, {S('l_extendedprice', 'l_extendedprice')}, {S('l_discount', 'l_discount')}, "
                 f"{S('l_extendedprice / (l_discount + 1e-10)', 'l_extendedprice_per_l_discount')} FROM {LI}"),
    "bin_equal_width": _bin_width_sql(),
    "bin_quantile": _bin_quantile_sql(),
    "formula_ratio": (f"SELECT l_orderkey, l_linenumber, {S('l_extendedprice', 'l_extendedprice')}, "
                      f"{S('l_quantity', 'l_quantity')}, {S('l_extendedprice / l_quantity', 'unit_price')} FROM {LI}"),
    "formula_center": (f"SELECT event_id, {S('value', 'value')}, "
                       f"{S('value - (SELECT avg(value) FROM events)', 'value_centered')} FROM events"),
    "transform_preview": _preview_sql(),
    "moments_report": _moments_sql(),
    "normality_test": _shapiro_sql(M.SHAPIRO_MAX_N),
    "normality_all_rows": _shapiro_sql(None),
    "jarque_bera": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(x) AS BIGINT) AS n, {S(_JB, 'jb', 6)}, {S(f'exp(-({_JB}) / 2.0)', 'p_value', 6)} "
        f"FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {EVENTS_NUM_SQL} e)"
        for c in ["value", "value_sparse", "user_id"]),
    "formula_large_int": (
        f"SELECT l_orderkey, l_linenumber, l_orderkey + 2000000000 AS a, l_linenumber + 2000000000 AS b, "
        f"{S('CAST(l_orderkey + 2000000000 AS DOUBLE) * (l_linenumber + 2000000000)', 'product')}, "
        f"{S('(SELECT avg(abs(l_orderkey - m)) FROM lineitem, (SELECT avg(l_orderkey) AS m FROM lineitem)) / nullif(l_linenumber - 1, 0)', 'spread')} FROM {LI}"),
}
