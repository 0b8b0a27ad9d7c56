"""Registered queries: cleaning operators and the cleaning plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import explore as E
from ..plans.cleaning import CleaningSpec, log_frame
from .common import EVENTS_NUM_SQL, S, events_num, finish, table

NUM = ["event_id", "user_id", "value", "value_sparse"]
LEVELS = ["click", "error", "purchase", "signup", "view"]


def _outlier_table(spark, df, method, cols):
    b = C.outlier_bounds(df, method, cols)
    n = C.outlier_counts(df, method, cols, b)
    rows = [(c, b[c].center, b[c].spread, b[c].lower, b[c].upper, n[c]) for c in cols]
    return spark.createDataFrame(rows, "column string, center double, spread double, lower double, "
                                       "upper double, n_outliers long")


def pipeline_spec() -> CleaningSpec:
    return CleaningSpec(na_strategy="impute", impute_method="mean", remove_dups=True, scale_method="zscore",
                        encode_method="label", encode_cols=["event_type"], outlier_method="iqr",
                        outlier_action="cap")


QUERIES = {
    "na_drop_rows": lambda s, sf: finish(C.drop_missing_rows(events_num(s, sf))),
    "na_drop_cols": lambda s, sf: finish(C.drop_missing_columns(events_num(s, sf), 50.0)[0]),
    "impute_mean": lambda s, sf: finish(C.impute(events_num(s, sf), "mean")[0]),
    "impute_median": lambda s, sf: finish(C.impute(events_num(s, sf), "median")[0]),
    "impute_mode": lambda s, sf: finish(C.impute(events_num(s, sf), "mode")[0]),
    "impute_categorical": lambda s, sf: C.impute(events_num(s, sf).select("event_id", "event_type"))[0],
    "dedup": lambda s, sf: C.dedup(table(s, sf, "events").select("event_type", "user_id")),
    "scale_zscore": lambda s, sf: finish(C.scale(events_num(s, sf), "zscore")),
    "scale_minmax": lambda s, sf: finish(C.scale(events_num(s, sf), "minmax")),
    "scale_robust": lambda s, sf: finish(C.scale(events_num(s, sf), "robust")),
    "encode_label": lambda s, sf: finish(C.encode_label(events_num(s, sf), ["event_type"])),
    "encode_onehot": lambda s, sf: finish(C.encode_onehot(events_num(s, sf), ["event_type"])),
    "outlier_iqr": lambda s, sf: finish(_outlier_table(s, events_num(s, sf), "iqr", NUM)),
    "outlier_z": lambda s, sf: finish(_outlier_table(s, events_num(s, sf), "z", NUM)),
    "outlier_flag": lambda s, sf: finish(C.outlier_flags(events_num(s, sf), "iqr", NUM)),
    "outlier_remove_seq": lambda s, sf: finish(C.remove_outliers_sequential(events_num(s, sf), "iqr", NUM)[0]),
    "outlier_remove_parallel": lambda s, sf: finish(C.remove_outliers_parallel(events_num(s, sf), "iqr", NUM)[0]),
    "outlier_cap_iqr": lambda s, sf: finish(C.cap_outliers(events_num(s, sf), "iqr", NUM)[0]),
    "outlier_cap_z": lambda s, sf: finish(C.cap_outliers(events_num(s, sf), "z", NUM)[0]),
    # three chained float steps (impute, z-score, cap): compare at 7 significant digits
    "clean_pipeline": lambda s, sf: finish(pipeline_spec().apply(events_num(s, sf))[0], 7),
    "cleaning_log": lambda s, sf: log_frame(s, pipeline_spec().apply(events_num(s, sf))[1]),
    "before_after": lambda s, sf: C.before_after(events_num(s, sf), pipeline_spec().apply(events_num(s, sf))[0]),
    "outlier_boxplot": lambda s, sf: finish(
        E.boxplot_stats(C.long_numeric(events_num(s, sf)), "value", by="variable")),
    "outlier_report": lambda s, sf: C.outlier_report(events_num(s, sf)),
}

EV = f"WITH ev AS {EVENTS_NUM_SQL} "
MODE_TYPE = ("(SELECT event_type FROM ev WHERE event_type IS NOT NULL GROUP BY event_type "
             "ORDER BY count(*) DESC, event_type LIMIT 1)")


def _impute_sql(kind: str) -> str:
    if kind == "mean":
        f1, f2 = "(SELECT avg(value) FROM ev)", "(SELECT avg(value_sparse) FROM ev)"
    elif kind == "median":
        f1, f2 = "(SELECT quantile_cont(value, 0.5) FROM ev)", "(SELECT quantile_cont(value_sparse, 0.5) FROM ev)"
    else:
        f1 = "(SELECT value FROM ev WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)"
        f2 = ("(SELECT value_sparse FROM ev WHERE value_sparse IS NOT NULL GROUP BY value_sparse "
              "ORDER BY count(*) DESC, value_sparse LIMIT 1)")
    return (EV + f"SELECT event_id, user_id, coalesce(event_type, {MODE_TYPE}) AS event_type, "
            f"{S(f'coalesce(value, {f1})', 'value')}, {S(f'coalesce(value_sparse, {f2})', 'value_sparse')} FROM ev")


def _scaled(kind: str, src: str = "ev") -> dict[str, str]:
    out = {}
    for c in NUM:
        x = f"CAST({c} AS DOUBLE)"
        if kind == "zscore":
            out[c] = (f"CASE WHEN (SELECT stddev_samp({c}) FROM {src}) = 0 THEN NULL ELSE "
                      f"({x} - (SELECT avg({c}) FROM {src})) / (SELECT stddev_samp({c}) FROM {src}) END")
        elif kind == "minmax":
            lo, hi = f"(SELECT CAST(min({c}) AS DOUBLE) FROM {src})", f"(SELECT CAST(max({c}) AS DOUBLE) FROM {src})"
            out[c] = f"CASE WHEN {hi} = {lo} THEN CASE WHEN {c} IS NULL THEN NULL ELSE 0.0 END ELSE ({x} - {lo}) / ({hi} - {lo}) END"
        else:
            q1, med, q3 = (f"(SELECT quantile_cont({c}, {p}) FROM {src})" for p in ("0.25", "0.5", "0.75"))
            out[c] = f"CASE WHEN {q3} - {q1} = 0 THEN {x} - {med} ELSE ({x} - {med}) / ({q3} - {q1}) END"
    return out


def _scale_sql(kind: str) -> str:
    s = _scaled(kind)
    return EV + "SELECT " + ", ".join(
        [S(s["event_id"], "event_id"), S(s["user_id"], "user_id"), "event_type", S(s["value"], "value"),
         S(s["value_sparse"], "value_sparse")]) + " FROM ev"


LABEL_CODES = ("codes AS (SELECT event_type AS lvl, CAST(row_number() OVER (ORDER BY event_type) AS DOUBLE) AS code "
               "FROM (SELECT DISTINCT event_type FROM {src} WHERE event_type IS NOT NULL))")


def _iqr_bounds_sql(c: str, src: str) -> str:
    return (f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
            f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
            f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {src})")


def _outlier_table_sql(method: str) -> str:
    parts = []
    for c in NUM:
        if method == "iqr":
            b = _iqr_bounds_sql(c, "ev")
            parts.append(
                f"SELECT '{c}' AS \"column\", {S('quantile_cont(' + c + ', 0.5)')} AS center, "
                f"{S('b.q3 - b.q1')} AS spread, {S('b.lo')} AS lower, {S('b.hi')} AS upper, "
                f"CAST(sum(CASE WHEN {c} < b.lo OR {c} > b.hi THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers "
                f"FROM ev, {b} b GROUP BY b.q1, b.q3, b.lo, b.hi")
        else:
            parts.append(
                f"SELECT '{c}' AS \"column\", {S('b.m')} AS center, {S('b.s')} AS spread, "
                f"{S('b.m - 3 * b.s')} AS lower, {S('b.m + 3 * b.s')} AS upper, "
                f"CAST(sum(CASE WHEN abs({c} - b.m) / b.s > 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers "
                f"FROM ev, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM ev) b GROUP BY b.m, b.s")
    return EV + " UNION ALL ".join(parts)


def _flag_sql() -> str:
    flags = []
    for c in NUM:
        b = _iqr_bounds_sql(c, "ev")
        flags.append(f"coalesce({c} < (SELECT lo FROM {b}) OR {c} > (SELECT hi FROM {b}), false) AS {c}_outlier")
    return (EV + f"SELECT event_id, user_id, event_type, {S('value', 'value')}, {S('value_sparse', 'value_sparse')}, "
            + ", ".join(flags) + " FROM ev")


def _remove_seq_sql() -> str:
    ctes = [f"s0 AS (SELECT * FROM ev)"]
    for i, c in enumerate(NUM, start=1):
        b = _iqr_bounds_sql(c, f"s{i - 1}")
        ctes.append(f"s{i} AS (SELECT s.* FROM s{i - 1} s, {b} b "
                    f"WHERE NOT coalesce(s.{c} < b.lo OR s.{c} > b.hi, false))")
    return (EV + ", " + ", ".join(ctes) + " SELECT event_id, user_id, event_type, "
            f"{S('value', 'value')}, {S('value_sparse', 'value_sparse')} FROM s{len(NUM)}")


def _remove_parallel_sql() -> str:
    conds = " OR ".join(f"coalesce({c} < (SELECT lo FROM {_iqr_bounds_sql(c, 'ev')}) OR "
                        f"{c} > (SELECT hi FROM {_iqr_bounds_sql(c, 'ev')}), false)" for c in NUM)
    return (EV + f"SELECT event_id, user_id, event_type, {S('value', 'value')}, {S('value_sparse', 'value_sparse')} "
            f"FROM ev WHERE NOT ({conds})")


def _cap_expr(c: str, method: str, src: str) -> str:
    if method == "iqr":
        b = _iqr_bounds_sql(c, src)
        lo, hi = f"(SELECT lo FROM {b})", f"(SELECT hi FROM {b})"
    else:
        lo = f"(SELECT avg({c}) - 3 * stddev_samp({c}) FROM {src})"
        hi = f"(SELECT avg({c}) + 3 * stddev_samp({c}) FROM {src})"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least(CAST({c} AS DOUBLE), {hi}), {lo}) END"


def _cap_sql(method: str) -> str:
    cols = []
    for c in NUM:
        e = _cap_expr(c, method, "ev")
        # integer id columns stay integers when no value is capped
        cols.append(S(e, c) if c in ("value", "value_sparse") else f"{c}")
    return EV + "SELECT " + ", ".join(cols[:2] + ["event_type"] + cols[2:]) + " FROM ev"


def _pipeline_ctes() -> str:
    imp = (f"s1 AS (SELECT event_id, user_id, coalesce(event_type, {MODE_TYPE}) AS event_type, "
           f"coalesce(value, (SELECT avg(value) FROM ev)) AS value, "
           f"coalesce(value_sparse, (SELECT avg(value_sparse) FROM ev)) AS value_sparse FROM ev)")
    dd = "s2 AS (SELECT DISTINCT * FROM s1)"
    z = _scaled("zscore", "s2")
    sc = (f"s3 AS (SELECT {z['event_id']} AS event_id, {z['user_id']} AS user_id, event_type, "
          f"{z['value']} AS value, {z['value_sparse']} AS value_sparse FROM s2)")
    codes = LABEL_CODES.format(src="s3")
    enc = ("s4 AS (SELECT s3.event_id, s3.user_id, codes.code AS event_type, s3.value, s3.value_sparse "
           "FROM s3 LEFT JOIN codes ON s3.event_type = codes.lvl)")
    return f"{EV}, {imp}, {dd}, {sc}, {codes}, {enc}"


def _pipeline_sql() -> str:
    caps = [S(_cap_expr(c, "iqr", "s4"), c, 7) for c in NUM]
    return (_pipeline_ctes() + " SELECT " + ", ".join(caps[:2] + [S("event_type", "event_type", 7)] + caps[2:])
            + " FROM s4")


def _log_sql() -> str:
    n_imp = "(SELECT count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE value_sparse IS NULL) FROM ev)"
    n_out = " + ".join(
        f"(SELECT count(*) FROM s4, {_iqr_bounds_sql(c, 's4')} b WHERE s4.{c} < b.lo OR s4.{c} > b.hi)" for c in NUM)
    return (_pipeline_ctes() + " SELECT CAST(step AS BIGINT) AS step, message FROM (VALUES "
            f"(1, 'Imputed ' || {n_imp} || ' missing values (numeric: mean, categorical: mode)'), "
            "(2, 'Applied Z-score standardization'), (3, 'Label-encoded: event_type'), "
            f"(4, ({n_out}) || ' outliers winsorized (iqr method)')) t(step, message)")


LISTING = {"before": "event_id: bigint, user_id: bigint, event_type: string, value: double, value_sparse: double",
           "after": "event_id: double, user_id: double, event_type: double, value: double, value_sparse: double"}


def _facts_sql(stage: str, src: str, ncols: int) -> str:
    miss = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ["event_id", "user_id", "event_type", "value", "value_sparse"])
    return (f"SELECT '{stage}' AS stage, CAST(count(*) AS BIGINT) AS n_rows, CAST({ncols} AS BIGINT) AS n_cols, "
            f"CAST(coalesce(sum({miss}), 0) AS BIGINT) AS missing_cells, "
            f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS duplicate_rows, "
            f"'{LISTING[stage]}' AS columns FROM {src}")


def _before_after_sql() -> str:
    caps = [f"{_cap_expr(c, 'iqr', 's4')} AS {c}" for c in NUM]
    final = "s5 AS (SELECT " + ", ".join(caps[:2] + ["event_type"] + caps[2:]) + " FROM s4)"
    return _pipeline_ctes() + f", {final} " + _facts_sql("before", "ev", 5) + " UNION ALL " + _facts_sql("after", "s5", 5)


def _boxplot_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM ev" for c in NUM)
    return (EV + f", l AS ({long}), q AS (SELECT variable, count(value) AS n, quantile_cont(value, 0.25) AS q1, "
            "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM l WHERE value IS NOT NULL "
            "GROUP BY variable) "
            f"SELECT q.variable AS \"group\", CAST(q.n AS BIGINT) AS n, {S('q.q1', 'q1')}, {S('q.median', 'median')}, "
            f"{S('q.q3', 'q3')}, "
            f"{S('min(CASE WHEN l.value >= q.q1 - 1.5 * (q.q3 - q.q1) THEN l.value END)', 'whisker_low')}, "
            f"{S('max(CASE WHEN l.value <= q.q3 + 1.5 * (q.q3 - q.q1) THEN l.value END)', 'whisker_high')}, "
            "CAST(sum(CASE WHEN l.value < q.q1 - 1.5 * (q.q3 - q.q1) OR l.value > q.q3 + 1.5 * (q.q3 - q.q1) "
            "THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers "
            "FROM l JOIN q ON l.variable = q.variable WHERE l.value IS NOT NULL GROUP BY q.variable, q.n, q.q1, q.median, q.q3")


def _report_sql() -> str:
    parts = []
    for c in NUM:
        b = _iqr_bounds_sql(c, "ev")
        r3 = lambda e: f"CAST(floor(({e}) * 1000.0 + 0.5) AS DOUBLE) / 1000.0"
        parts.append(
            f"SELECT '{c}' AS \"column\", "
            f"CAST(sum(CASE WHEN {c} < b.lo OR {c} > b.hi THEN 1 ELSE 0 END) AS BIGINT) AS iqr_outliers, "
            f"CAST(sum(CASE WHEN abs({c} - z.m) / z.s > 3 THEN 1 ELSE 0 END) AS BIGINT) AS zscore_outliers, "
            f"{r3(f'CAST(min({c}) AS DOUBLE)')} AS min, {r3(f'CAST(max({c}) AS DOUBLE)')} AS max, "
            f"{r3('z.m')} AS mean, {r3('z.s')} AS sd "
            f"FROM ev, {b} b, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM ev) z GROUP BY b.lo, b.hi, z.m, z.s")
    return EV + " UNION ALL ".join(parts)


ORACLE = {
    "na_drop_rows": EV + f"SELECT event_id, user_id, event_type, {S('value', 'value')}, {S('value_sparse', 'value_sparse')} "
                         "FROM ev WHERE event_type IS NOT NULL AND value IS NOT NULL AND value_sparse IS NOT NULL",
    "na_drop_cols": EV + f"SELECT event_id, user_id, event_type, {S('value', 'value')} FROM ev",
    "impute_mean": _impute_sql("mean"),
    "impute_median": _impute_sql("median"),
    "impute_mode": _impute_sql("mode"),
    "impute_categorical": EV + f"SELECT event_id, coalesce(event_type, {MODE_TYPE}) AS event_type FROM ev",
    "dedup": "SELECT DISTINCT event_type, user_id FROM events",
    "scale_zscore": _scale_sql("zscore"),
    "scale_minmax": _scale_sql("minmax"),
    "scale_robust": _scale_sql("robust"),
    "encode_label": EV + ", " + LABEL_CODES.format(src="ev") + " SELECT event_id, user_id, "
                    f"codes.code AS event_type, {S('value', 'value')}, {S('value_sparse', 'value_sparse')} "
                    "FROM ev LEFT JOIN codes ON ev.event_type = codes.lvl",
    "encode_onehot": EV + f"SELECT event_id, user_id, {S('value', 'value')}, {S('value_sparse', 'value_sparse')}, "
                     + ", ".join(f"CASE WHEN event_type = '{v}' THEN 1.0 ELSE 0.0 END AS event_type_{v}" for v in LEVELS)
                     + " FROM ev",
    "outlier_iqr": _outlier_table_sql("iqr"),
    "outlier_z": _outlier_table_sql("z"),
    "outlier_flag": _flag_sql(),
    "outlier_remove_seq": _remove_seq_sql(),
    "outlier_remove_parallel": _remove_parallel_sql(),
    "outlier_cap_iqr": _cap_sql("iqr"),
    "outlier_cap_z": _cap_sql("z"),
    "clean_pipeline": _pipeline_sql(),
    "cleaning_log": _log_sql(),
    "before_after": _before_after_sql(),
    "outlier_boxplot": _boxplot_sql(),
    "outlier_report": _report_sql(),
}
