"""Registered queries: scans, sinks, paging, profiling, missingness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import rank as RK
from ..session import scratch_path
from ..sources import readers as R
from .common import EVENTS_NA_SQL, S, events_na, finish, table

ORDERS_TEXT_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _orders_canonical(df):
    return df.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"),
        F.col("o_custkey").cast("long").alias("o_custkey"),
        F.col("o_orderstatus").cast("string").alias("o_orderstatus"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.col("o_orderpriority").cast("string").alias("o_orderpriority"),
    )


ORDERS_CANONICAL_SQL = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"
)


def scan_csv(spark, sf):
    path = scratch_path(spark, "orders-csv") + "/orders.csv"
    R.write_csv(table(spark, sf, "orders"), path)
    return _orders_canonical(R.load(spark, path))


def scan_tsv(spark, sf):
    path = scratch_path(spark, "orders-tsv") + "/orders.tsv"
    R.write_csv(table(spark, sf, "orders"), path, sep="\t")
    return _orders_canonical(R.load(spark, path))


def scan_csv_text(spark, sf):
    """Free text with quotes and line breaks through the CSV sink and back."""
    path = scratch_path(spark, "documents-csv") + "/documents.csv"
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('"q", '), "text", F.lit(' "e"')).alias("text"), "lang")
    R.write_csv(docs, path)
    back = R.load(spark, path, multi_line=True)
    return back.select(F.col("doc_id").cast("long"), "text", "lang")


EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _events_back(back):
    return back.select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long"),
                       "event_type", F.col("value").cast("double"), "props")


def scan_json(spark, sf):
    path = scratch_path(spark, "events-json") + "/events.json"
    R.write_json(table(spark, sf, "events").select(*EVENT_COLS), path)
    return _events_back(R.load(spark, path))


def scan_json_array(spark, sf):
    """Files that each hold one array of records (10,000 at most here)."""
    path = scratch_path(spark, "events-json-array") + "/events.json"
    rows = table(spark, sf, "events").select(*EVENT_COLS)
    arrays = (rows.groupBy(F.expr("event_id div 10000").alias("part"))
              .agg(F.to_json(F.collect_list(F.struct(*EVENT_COLS)), R.JSON_TIMES).alias("value")))
    arrays.write.partitionBy("part").text(path)
    return _events_back(R.load(spark, path))


def load_dispatch(spark, sf):
    return R.load(spark, f"{sf.rstrip('/')}/customer.parquet")


def sample_fixed(spark, sf):
    orders = table(spark, sf, "orders")
    order = F.pmod(F.col("o_orderkey") * F.lit(1103515245) + F.lit(12345), F.lit(2147483647))
    return _orders_canonical(R.sample_fixed(orders, 2000, ["o_orderkey"], order=order))


def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "events-na-csv") + "/events_na.csv"
    src = events_na(spark, sf).select("event_id", "user_id", "event_type", "value", "props", "value_sparse")
    R.write_csv(src, path)
    back = R.load(spark, path)
    return back.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type",
                       F.col("value").cast("double"), "props", F.col("value_sparse").cast("double"))


def page_table(spark, sf):
    cust = table(spark, sf, "customer")
    return R.page_table(cust, search="building", order_by=["c_acctbal", "c_custkey"],
                        descending=[True, False], page=2, page_size=15)


def page_deep(spark, sf):
    """A page far down a sorted table, through a page index with leaves of 2,000 rows."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return R.page_table(items, order_by=["l_shipdate", "l_orderkey", "l_linenumber"], descending=[True, False, False],
                        page=250, page_size=20, leaf_rows=2_000)


def dataset_summary(spark, sf):
    return P.dataset_summary(events_na(spark, sf))


def kpi_filtered(spark, sf):
    ev = events_na(spark, sf)
    return P.dataset_summary(ev.where(F.col("value").between(10.0, 100.0)))


def column_profile(spark, sf):
    return P.column_profile(events_na(spark, sf))


def column_profile_wide(spark, sf):
    """20 columns, with arrays and timestamps among them: the same rule as for a narrow table."""
    ev = events_na(spark, sf)
    return P.column_profile(ev.select(
        "*", *[(F.col("event_id") % k).alias(f"mod_{k}") for k in range(2, 13)],
        F.array("event_type", F.lit("x")).alias("pair"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")))


def _ranked(spark, sf, name, col):
    df = table(spark, sf, name)
    buckets = RK.ranked_counts(df, col, target_rows=max(1, df.select(col).distinct().count() // 40))
    return buckets.select("value", "cnt", "before", "total")


def missing_rows(spark, sf):
    return P.missing_rows(events_na(spark, sf), "event_id")


def missing_map(spark, sf):
    return finish(P.missing_map(events_na(spark, sf), "event_id", blocks=100))


QUERIES = {
    "scan_csv": scan_csv, "scan_tsv": scan_tsv, "scan_json": scan_json, "load_dispatch": load_dispatch,
    "sample_fixed": sample_fixed, "sink_roundtrip": sink_roundtrip, "page_table": page_table, "page_deep": page_deep,
    "dataset_summary": dataset_summary, "kpi_filtered": kpi_filtered, "column_profile": column_profile,
    "missing_rows": missing_rows, "missing_map": missing_map, "scan_csv_text": scan_csv_text, "scan_json_array": scan_json_array,
    "column_profile_wide": column_profile_wide,
    # about 40 buckets each, whatever the table's size
    "rank_bucketed_numeric": lambda s, sf: _ranked(s, sf, "lineitem", "l_extendedprice"),
    "rank_bucketed_timestamp": lambda s, sf: _ranked(s, sf, "events", "ts"),
    "rank_bucketed_text": lambda s, sf: _ranked(s, sf, "customer", "c_name"),
}

EV_COLS = [("event_id", "bigint", False), ("ts", "timestamp_ntz", False), ("user_id", "bigint", False),
           ("event_type", "string", True), ("value", "double", False), ("props", "string", True),
           ("value_sparse", "double", False)]


def _summary_sql(where: str = "") -> str:
    miss = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c, _, _ in EV_COLS)
    return (
        f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(7 AS BIGINT) AS n_cols, CAST(4 AS BIGINT) AS n_numeric, "
        f"CAST(3 AS BIGINT) AS n_categorical, CAST(coalesce(sum({miss}), 0) AS BIGINT) AS missing_cells, "
        f"CAST(floor(CAST(sum({miss}) AS DOUBLE) * 100.0 / (count(*) * 7.0) * 10.0 + 0.5) AS DOUBLE) / 10.0 "
        f"AS pct_missing FROM {EVENTS_NA_SQL} ev {where}"
    )


def _profile_sql(cols=EV_COLS, src: str = EVENTS_NA_SQL) -> str:
    parts = []
    for i, (c, t, text) in enumerate(cols):
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type, "
            f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
            f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique, "
            f"CAST(count(*) AS BIGINT) AS n_total, {str(text).upper()} AS is_text FROM {src} ev"
        )
    body = " UNION ALL ".join(parts)
    return (
        "WITH p AS (" + body + "), q AS (SELECT *, CAST(floor(CAST(n_missing AS DOUBLE) * 100.0 / n_total * 10.0 + 0.5)"
        " AS DOUBLE) / 10.0 AS pct_missing FROM p) "
        "SELECT \"column\", type, n_missing, pct_missing, n_unique, n_total, "
        f"CASE WHEN pct_missing > 50 THEN '{P.ALERT_OVER_50}' WHEN pct_missing > 20 THEN '{P.ALERT_OVER_20}' "
        f"WHEN n_unique = 1 THEN '{P.ALERT_CONSTANT}' WHEN n_unique = n_total AND is_text THEN '{P.ALERT_ID_LIKE}' "
        f"ELSE '{P.ALERT_OK}' END AS alert, position FROM q"
    )


def _wide_sql() -> str:
    mods = [(f"mod_{k}", "bigint", False) for k in range(2, 13)]
    extra = ", ".join(f"event_id % {k} AS mod_{k}" for k in range(2, 13))
    cols = EV_COLS + mods + [("pair", "array<string>", False), ("hour", "timestamp_ntz", False)]
    return _profile_sql(cols, f"(SELECT *, {extra}, [event_type, 'x'] AS pair, date_trunc('hour', ts) AS hour FROM {EVENTS_NA_SQL} e0)")


def _rank_sql(table_: str, col: str) -> str:
    return (f"SELECT {col} AS value, cnt, CAST(sum(cnt) OVER (ORDER BY {col}) - cnt AS BIGINT) AS before, "
            f"CAST(sum(cnt) OVER () AS BIGINT) AS total FROM (SELECT {col}, count(*) AS cnt FROM {table_} WHERE {col} IS NOT NULL GROUP BY 1)")


def _missing_rows_sql() -> str:
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c, _, _ in EV_COLS)
    names = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c, _, _ in EV_COLS)
    return (
        f"SELECT event_id, CAST(n_missing AS BIGINT) AS n_missing, "
        f"CAST(floor(n_missing * 100.0 / 7.0 * 10.0 + 0.5) AS DOUBLE) / 10.0 AS pct_missing, missing_columns FROM "
        f"(SELECT event_id, {n} AS n_missing, concat_ws(', ', {names}) AS missing_columns FROM {EVENTS_NA_SQL} ev) "
        f"WHERE n_missing > 0"
    )


def _missing_map_sql() -> str:
    flags = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}" for c, _, _ in EV_COLS)
    avgs = ", ".join(f"avg({c}) AS {c}" for c, _, _ in EV_COLS)
    unp = " UNION ALL ".join(
        f"SELECT block, n_rows, '{c}' AS \"column\", {S(c)} AS missing_rate FROM g" for c, _, _ in EV_COLS)
    return (
        f"WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS pos, count(*) OVER () AS n, {flags} "
        f"FROM {EVENTS_NA_SQL} ev), "
        f"b AS (SELECT CAST(floor(CAST((pos - 1) * 100 AS DOUBLE) / CAST(n AS DOUBLE)) AS BIGINT) AS block, * FROM r), "
        f"g AS (SELECT block, CAST(count(*) AS BIGINT) AS n_rows, {avgs} FROM b GROUP BY block) {unp}"
    )


def _orders_sql(src: str = "orders") -> str:
    return ORDERS_CANONICAL_SQL.replace("FROM orders", f"FROM {src}")


ORACLE = {
    "scan_csv": ORDERS_CANONICAL_SQL,
    "scan_tsv": ORDERS_CANONICAL_SQL,
    "scan_json": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "scan_json_array": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "scan_csv_text": """SELECT doc_id, '"q", ' || text || ' "e"' AS text, lang FROM documents""",
    "column_profile_wide": _wide_sql(),
    "rank_bucketed_numeric": _rank_sql("lineitem", "l_extendedprice"),
    "rank_bucketed_timestamp": _rank_sql("events", "ts"),
    "rank_bucketed_text": _rank_sql("customer", "c_name"),
    "load_dispatch": "SELECT * FROM customer",
    "sample_fixed": _orders_sql(
        "(SELECT * FROM orders ORDER BY (o_orderkey * 1103515245 + 12345) % 2147483647, o_orderkey LIMIT 2000)"),
    "sink_roundtrip": f"SELECT event_id, user_id, event_type, value, props, value_sparse FROM {EVENTS_NA_SQL} ev",
    "page_table": (
        "SELECT * FROM customer WHERE lower(CAST(c_custkey AS VARCHAR)) LIKE '%building%' "
        "OR lower(c_name) LIKE '%building%' OR lower(CAST(c_nationkey AS VARCHAR)) LIKE '%building%' "
        "OR lower(CAST(c_acctbal AS VARCHAR)) LIKE '%building%' OR lower(c_mktsegment) LIKE '%building%' "
        "ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 15"),
    "page_deep": ("SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem "
                  "ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice LIMIT 20 OFFSET 4980"),
    "dataset_summary": _summary_sql(),
    "kpi_filtered": _summary_sql("WHERE value BETWEEN 10.0 AND 100.0"),
    "column_profile": _profile_sql(),
    "missing_rows": _missing_rows_sql(),
    "missing_map": _missing_map_sql(),
}
