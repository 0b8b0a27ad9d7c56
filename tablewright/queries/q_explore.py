"""Registered queries: filters, chart data, correlations, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import qnorm_sql
from ..operators import correlate as K
from ..operators import explore as E
from .common import EVENTS_NA_SQL, EVENTS_NUM_SQL, S, events_na, events_num, finish, table
from .sqlgen import box_sql, density_select, density_sql, histogram_sql

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUST_NUM = ["c_nationkey", "c_acctbal", "c_custkey"]


def _ev(s, sf):
    return table(s, sf, "events")


QUERIES = {
    "filter_range": lambda s, sf: E.filter_range(_ev(s, sf).select("event_id", "value"), "value", 10.0, 100.0),
    "filter_in": lambda s, sf: E.filter_in(_ev(s, sf).select("event_id", "event_type"), "event_type",
                                           ["click", "view"]),
    "filter_domain": lambda s, sf: E.filter_domain(table(s, sf, "orders"), "o_orderpriority"),
    "filter_domain_numeric": lambda s, sf: finish(E.filter_domain(table(s, sf, "orders"), "o_totalprice")),
    "histogram": lambda s, sf: finish(E.histogram(table(s, sf, "orders"), "o_totalprice", 30)),
    "histogram_grouped": lambda s, sf: finish(E.histogram(_ev(s, sf), "value", 30, by="event_type")),
    "density": lambda s, sf: finish(E.density(_ev(s, sf), "value")),
    "density_grouped": lambda s, sf: finish(E.density(_ev(s, sf), "value", by="event_type")),
    "scatter_bins": lambda s, sf: finish(E.scatter_bins(table(s, sf, "lineitem"), "l_quantity", "l_extendedprice", 50)),
    "trend_line": lambda s, sf: finish(E.trend_line(table(s, sf, "lineitem"), "l_quantity", "l_extendedprice")),
    "boxplot_stats": lambda s, sf: finish(E.boxplot_stats(_ev(s, sf), "value", by="event_type")),
    "violin": lambda s, sf: finish(E.violin(_ev(s, sf), "value", "event_type")),
    "bar_counts": lambda s, sf: E.bar_counts(table(s, sf, "orders"), "o_orderpriority"),
    "qq_points": lambda s, sf: finish(E.qq_points(_ev(s, sf), "value")),
    "qq_line": lambda s, sf: finish(E.qq_line(_ev(s, sf), "value")),
    "corr_pearson": lambda s, sf: finish(K.corr_pearson(table(s, sf, "lineitem"), LI_NUM)),
    "corr_pearson_missing": lambda s, sf: finish(K.corr_pearson(events_num(s, sf), ["user_id", "value", "value_sparse"])),
    "corr_spearman": lambda s, sf: finish(K.corr_spearman(table(s, sf, "lineitem"), LI_NUM)),
    "corr_spearman_missing": lambda s, sf: finish(K.corr_spearman(events_num(s, sf), ["user_id", "value", "value_sparse"])),
    "corr_kendall": lambda s, sf: finish(K.corr_kendall(table(s, sf, "customer"), CUST_NUM)),
    "pairs_corr": lambda s, sf: finish(K.corr_pearson(table(s, sf, "lineitem"), ["l_quantity", "l_extendedprice"])),
    "pairs_panel": lambda s, sf: finish(E.pairs_panel(table(s, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])),
    "summary_logical": lambda s, sf: finish(E.summary_logical(events_na(s, sf).select(
        (F.col("value") > 50).alias("large"), (F.col("event_type") == "click").alias("is_click")))),
    "summary_numeric": lambda s, sf: finish(E.summary_numeric(events_num(s, sf))),
    "summary_string": lambda s, sf: finish(E.summary_string(events_na(s, sf))),
    "summary_other": lambda s, sf: E.summary_other(events_na(s, sf), factor_cols=["event_type"], time_cols=["ts"]),
}

# ---------------------------------------------------------------- SQL twins
EVN = EVENTS_NUM_SQL


def _pearson_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            m = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(
                f"SELECT '{a}' AS var1, '{b}' AS var2, "
                f"{S(f'covar_samp(CASE WHEN {m} THEN {a} END, CASE WHEN {m} THEN {b} END) / sqrt(var_samp(CASE WHEN {m} THEN {a} END) * var_samp(CASE WHEN {m} THEN {b} END))')} AS corr, "
                f"CAST(count(CASE WHEN {m} THEN 1 END) AS BIGINT) AS n FROM {src}")
        parts.append(f"SELECT '{a}' AS var1, '{a}' AS var2, CASE WHEN var_samp({a}) > 0 THEN 1.0 END AS corr, "
                     f"CAST(count({a}) AS BIGINT) AS n FROM {src}")
    return " UNION ALL ".join(parts)


def _spearman_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS var1, '{b}' AS var2, {S('covar_samp(ra, rb) / sqrt(var_samp(ra) * var_samp(rb))')} AS corr, "
                f"CAST(count(*) AS BIGINT) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
                f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
                f"FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
        parts.append(f"SELECT '{a}' AS var1, '{a}' AS var2, CASE WHEN var_samp({a}) > 0 THEN 1.0 END AS corr, "
                     f"CAST(count({a}) AS BIGINT) AS n FROM {src}")
    return " UNION ALL ".join(parts)


def _kendall_sql(src: str, key: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS var1, '{b}' AS var2, "
                f"{S(f'sum(sign(CAST(p.{a} AS DOUBLE) - q.{a}) * sign(CAST(p.{b} AS DOUBLE) - q.{b})) / sqrt(CAST(sum(CASE WHEN p.{a} <> q.{a} THEN 1 ELSE 0 END) AS DOUBLE) * sum(CASE WHEN p.{b} <> q.{b} THEN 1 ELSE 0 END))')} AS corr, "
                f"CAST((SELECT count(*) FROM {src}) AS BIGINT) AS n FROM {src} p JOIN {src} q ON p.{key} < q.{key}")
        parts.append(f"SELECT '{a}' AS var1, '{a}' AS var2, CASE WHEN count(DISTINCT {a}) > 1 THEN 1.0 END AS corr, "
                     f"CAST(count({a}) AS BIGINT) AS n FROM {src}")
    return " UNION ALL ".join(parts)


def _scatter_sql(x: str = "l_quantity", y: str = "l_extendedprice", bins: int = 50) -> str:
    return (f"WITH st AS (SELECT min({x}) AS x0, max({x}) AS x1, min({y}) AS y0, "
            f"max({y}) AS y1 FROM lineitem), w AS (SELECT x0, y0, "
            f"CASE WHEN x1 > x0 THEN (x1 - x0) / {bins}.0 ELSE 1.0 END AS wx, "
            f"CASE WHEN y1 > y0 THEN (y1 - y0) / {bins}.0 ELSE 1.0 END AS wy FROM st), "
            f"b AS (SELECT CAST(least(floor(({x} - x0) / wx), {bins - 1}) AS BIGINT) AS bin_x, "
            f"CAST(least(floor(({y} - y0) / wy), {bins - 1}) AS BIGINT) AS bin_y FROM lineitem, w) "
            f"SELECT bin_x, bin_y, {S('x0 + (bin_x + 0.5) * wx', 'x')}, {S('y0 + (bin_y + 0.5) * wy', 'y')}, "
            "CAST(count(*) AS BIGINT) AS count FROM b, w GROUP BY bin_x, bin_y, x0, y0, wx, wy")


_SE = "s * sqrt(1.0 / n + (x - xbar) * (x - xbar) / sxx)"
#: the 97.5 % point of Student's t by its series in 1 / df (df is in the thousands here) around the normal one
_Z = 1.959963984540054
_T975 = (f"({_Z!r} + {(_Z**3 + _Z) / 4!r} / (n - 2) + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / ((n - 2.0) * (n - 2)) "
         f"+ {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / ((n - 2.0) * (n - 2) * (n - 2)))")


def _pairs_sql(cols: list[str]) -> str:
    null = "CAST(NULL AS DOUBLE)"
    parts = [f"SELECT 'corr' AS part, var1, var2, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, {null} AS x, {null} AS y, corr AS value "
             f"FROM ({_pearson_sql('lineitem', cols)}) WHERE var1 <> var2"]
    for c in cols:
        parts.append(f"SELECT 'density', '{c}', '{c}', idx, CAST(NULL AS BIGINT), x, {null}, density FROM "
                     f"(WITH {density_sql('lineitem', c, None, 128)}{density_select(False)})")
    for k, a in enumerate(cols):
        for b in cols[k + 1:]:
            parts.append(f"SELECT 'points', '{a}', '{b}', bin_x, bin_y, x, y, CAST(count AS DOUBLE) FROM ({_scatter_sql(a, b, 20)})")
    return " UNION ALL ".join(parts)


def _logical_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count(v) AS BIGINT) AS n_missing, {S('1.0 - (count(*) - count(v)) / count(*)', 'complete_rate')}, "
        f"{S('avg(CAST(v AS DOUBLE))', 'mean')}, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS n_true, CAST(count(*) FILTER (WHERE NOT v) AS BIGINT) AS n_false "
        f"FROM (SELECT {e} AS v FROM {EVENTS_NA_SQL} ev)" for c, e in (("large", "value > 50"), ("is_click", "event_type = 'click'")))


def _trend_sql() -> str:
    return ("WITH f AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS b, "
            "regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx, "
            "regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, "
            "regr_avgx(l_extendedprice, l_quantity) AS xbar, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), "
            "g AS (SELECT i AS idx, lo + i * ((hi - lo) / 79.0) AS x, a, b, n, xbar, sxx, "
            "sqrt(greatest(syy - b * sxy, 0.0) / (n - 2)) AS s FROM f, range(0, 80) t(i)) "
            f"SELECT CAST(idx AS BIGINT) AS idx, {S('x', 'x')}, {S('a + b * x', 'fit')}, {S(_SE, 'se_fit')}, "
            f"{S(f'a + b * x - {_T975} * {_SE}', 'lower')}, {S(f'a + b * x + {_T975} * {_SE}', 'upper')} FROM g")


def _qq_sql() -> str:
    p = "(position - a) / (n + 1 - 2 * a)"
    return ("WITH r AS (SELECT CAST(row_number() OVER (ORDER BY value) AS BIGINT) AS position, value AS sample, "
            "count(*) OVER () AS n FROM events WHERE value IS NOT NULL), "
            "ra AS (SELECT *, CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END AS a FROM r) "
            f"SELECT position, {S('sample', 'sample')}, {S(qnorm_sql(p), 'theoretical')} FROM ra")


def _qq_line_sql() -> str:
    q1, q3 = E.QNORM_Q1, E.QNORM_Q3
    return ("WITH q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM events) "
            f"SELECT 'value' AS \"column\", {S('q25', 'q25')}, {S('q75', 'q75')}, "
            f"{S(f'(q75 - q25) / {q3 - q1!r}', 'slope')}, {S(f'q25 - (q75 - q25) / {q3 - q1!r} * {q1!r}', 'intercept')} FROM q")


def _summary_numeric_sql() -> str:
    parts = []
    for c in ["event_id", "user_id", "value", "value_sparse"]:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
            f"{S(f'1.0 * count({c}) / count(*)')} AS complete_rate, {S(f'avg({x})')} AS mean, "
            f"{S(f'stddev_samp({x})')} AS sd, {S(f'min({x})')} AS p0, {S(f'quantile_cont({x}, 0.25)')} AS p25, "
            f"{S(f'quantile_cont({x}, 0.5)')} AS p50, {S(f'quantile_cont({x}, 0.75)')} AS p75, "
            f"{S(f'max({x})')} AS p100, (SELECT string_agg(CAST(coalesce(cnt, 0) AS VARCHAR), ',' ORDER BY k) FROM "
            f"(SELECT k, cnt FROM range(0, 8) t(k) LEFT JOIN (SELECT CAST(least(floor(({x} - lo) / w), 7) AS BIGINT) AS b, "
            f"count(*) AS cnt FROM ev, (SELECT min({x}) AS lo, CASE WHEN max({x}) > min({x}) THEN (max({x}) - min({x})) / 8 "
            f"ELSE 1.0 END AS w FROM ev) WHERE {c} IS NOT NULL GROUP BY b) h ON h.b = t.k)) AS hist FROM ev")
    return f"WITH ev AS {EVN} " + " UNION ALL ".join(parts)


def _summary_string_sql() -> str:
    parts = []
    for c in ["event_type", "props"]:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
            f"{S(f'1.0 - sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*)')} AS complete_rate, "
            f"CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length, "
            f"CAST(coalesce(sum(CASE WHEN {c} = '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_empty, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, "
            f"CAST(coalesce(sum(CASE WHEN length({c}) > 0 AND trim({c}) = '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_whitespace "
            f"FROM {EVENTS_NA_SQL} ev")
    return " UNION ALL ".join(parts)


def _summary_other_sql() -> str:
    return (
        f"WITH ev AS {EVENTS_NA_SQL}, top AS (SELECT event_type, count(*) AS c FROM ev WHERE event_type IS NOT NULL "
        "GROUP BY event_type ORDER BY c DESC, event_type LIMIT 4) "
        "SELECT 'ts' AS \"column\", 'time' AS kind, CAST(sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
        "CAST(count(DISTINCT ts) AS BIGINT) AS n_unique, CAST(min(ts) AS VARCHAR) AS min, CAST(max(ts) AS VARCHAR) AS max, "
        "strftime(make_timestamp(CAST(floor(quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.5)) AS BIGINT)), '%Y-%m-%d %H:%M:%S') "
        "AS median, CAST(NULL AS VARCHAR) AS top_counts FROM ev "
        "UNION ALL SELECT 'event_type', 'factor', CAST(sum(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END) AS BIGINT), "
        "CAST(count(DISTINCT event_type) AS BIGINT), NULL, NULL, NULL, "
        "(SELECT string_agg(substr(event_type, 1, 3) || ': ' || c, ', ' ORDER BY c DESC, event_type) FROM top) FROM ev")


def _violin_sql() -> str:
    d = "WITH " + density_sql("events", "value", "event_type") + density_select(True)
    b = box_sql("events", "value", "event_type")
    return (f"SELECT d.\"group\", d.idx, d.x, d.density, d.bandwidth, b.n, b.q1, b.median, b.q3, b.whisker_low, "
            f"b.whisker_high, b.n_outliers FROM ({d}) d JOIN ({b}) b ON d.\"group\" IS NOT DISTINCT FROM b.\"group\"")


ORACLE = {
    "filter_range": "SELECT event_id, value FROM events WHERE value BETWEEN 10.0 AND 100.0",
    "filter_in": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')",
    "filter_domain": "SELECT DISTINCT o_orderpriority AS value FROM orders",
    "filter_domain_numeric": f"SELECT {S('min(o_totalprice)', 'min')}, {S('max(o_totalprice)', 'max')} FROM orders",
    "histogram": histogram_sql("orders", "o_totalprice", 30),
    "histogram_grouped": histogram_sql("events", "value", 30, "event_type"),
    "density": "WITH " + density_sql("events", "value") + density_select(False),
    "density_grouped": "WITH " + density_sql("events", "value", "event_type") + density_select(True),
    "scatter_bins": _scatter_sql(),
    "trend_line": _trend_sql(),
    "boxplot_stats": box_sql("events", "value", "event_type"),
    "violin": _violin_sql(),
    "bar_counts": "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY o_orderpriority",
    "qq_points": _qq_sql(),
    "qq_line": _qq_line_sql(),
    "corr_pearson": _pearson_sql("lineitem", LI_NUM),
    "corr_pearson_missing": _pearson_sql(EVN, ["user_id", "value", "value_sparse"]),
    "corr_spearman": _spearman_sql("lineitem", LI_NUM),
    "corr_spearman_missing": _spearman_sql(EVN, ["user_id", "value", "value_sparse"]),
    "corr_kendall": _kendall_sql("customer", "c_custkey", CUST_NUM),
    "pairs_corr": _pearson_sql("lineitem", ["l_quantity", "l_extendedprice"]),
    "pairs_panel": _pairs_sql(["l_quantity", "l_extendedprice", "l_tax"]),
    "summary_logical": _logical_sql(),
    "summary_numeric": _summary_numeric_sql(),
    "summary_string": _summary_string_sql(),
    "summary_other": _summary_other_sql(),
}
