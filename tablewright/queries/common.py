"""Inputs shared by the registered queries and their SQL twins.

Derived fixtures (missing cells etc.) are defined once here in both Spark and
SQL so the two engines see the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rounding import sig_round, sig_round_sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def events_na(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` with derived missing cells: 10 % of value, 1/7 of event_type, 60 % of value_sparse."""
    ev = table(spark, sf, "events")
    eid = F.col("event_id")
    return ev.select(
        "event_id", "ts", "user_id",
        F.when(eid % 7 == 2, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid % 10 == 3, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        "props",
        F.when(eid % 5 < 3, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value_sparse"),
    )


EVENTS_NA_SQL = (
    "(SELECT event_id, ts, user_id, "
    "CASE WHEN event_id % 7 = 2 THEN NULL ELSE event_type END AS event_type, "
    "CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value, props, "
    "CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS value_sparse FROM events)"
)


def events_num(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaning fixture: ids, category and two numeric columns with missing cells."""
    return events_na(spark, sf).select("event_id", "user_id", "event_type", "value", "value_sparse")


EVENTS_NUM_SQL = f"(SELECT event_id, user_id, event_type, value, value_sparse FROM {EVENTS_NA_SQL})"


def finish(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column to ``digits`` significant digits (engine-independent).

    Two projections: the decimal exponent is computed once per value, then
    the rounding uses it (same arithmetic as :func:`sig_round`).
    """
    dbl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not dbl:
        return df
    q = lambda n: F.col("`" + n + "`")
    stage = df.select("*", *[(F.lit(digits - 1) - F.floor(F.log10(F.abs(q(n).cast("double"))))).alias(f"__k{i}")
                             for i, n in enumerate(dbl)])
    out = []
    idx = {n: i for i, n in enumerate(dbl)}
    for f in df.schema.fields:
        if f.name not in idx:
            out.append(q(f.name))
            continue
        x, k = q(f.name).cast("double"), F.col(f"__k{idx[f.name]}")
        p = F.pow(F.lit(10.0), F.abs(k))
        finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        r = (F.when(x.isNull(), F.lit(None).cast("double"))
             .when(~finite | (x == 0), x)
             .when(F.abs(x) < F.lit(1e-12), F.lit(0.0))
             .when(k >= 0, F.floor(x * p + F.lit(0.5)).cast("double") / p)
             .otherwise(F.floor(x / p + F.lit(0.5)).cast("double") * p))
        out.append(r.alias(f.name))
    return stage.select(*out)


def S(expr: str, alias: str | None = None, digits: int = 9) -> str:
    """SQL twin of :func:`finish` for one expression."""
    s = sig_round_sql(expr, digits)
    return f"{s} AS {alias}" if alias else s


def col_round(c: Column, digits: int = 9) -> Column:
    return sig_round(c, digits)
