"""Profiling and missingness (dataset summary, column profile, missing map/rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, is_string, qcol, type_name
from ..functions.rounding import round_dp
from .rank import exact_key, ranked_counts
from .select import MissedError, block_starts, literal

# Profile alert texts, first matching rule wins.
ALERT_OVER_50 = "!! >50% missing - consider dropping"
ALERT_OVER_20 = "! >20% missing - imputation recommended"
ALERT_CONSTANT = "!! Constant column"
ALERT_ID_LIKE = "! All unique (possible ID column)"
ALERT_OK = "OK"


def _missing_flag(df: DataFrame, name: str):
    return qcol(name).isNull()


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, cols, numeric and categorical column counts, missing cells and their share."""
    fields = df.schema.fields
    n_cols = len(fields)
    n_num = sum(1 for f in fields if is_numeric(f.dataType))
    miss = F.lit(0).cast("long")
    for f in fields:
        miss = miss + _missing_flag(df, f.name).cast("long")
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(miss).alias("missing_cells"))
    cells = F.col("n_rows") * F.lit(n_cols)
    return agg.select(
        F.col("n_rows").cast("long").alias("n_rows"),
        F.lit(n_cols).cast("long").alias("n_cols"),
        F.lit(n_num).cast("long").alias("n_numeric"),
        F.lit(n_cols - n_num).cast("long").alias("n_categorical"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).cast("long").alias("missing_cells"),
        round_dp(F.try_divide(F.col("missing_cells").cast("double") * 100.0, cells.cast("double")), 1)
        .alias("pct_missing"),
    )


def _distinct_counts(df: DataFrame) -> DataFrame:
    """``(position, n_unique)`` with NULL counted as one value.

    Exact distinct counts of many columns in one ``agg`` are planned as an
    Expand that copies every row once per column.  Here the columns of each
    data type become one stream of ``(position, value)`` cells, so values are
    compared as what they are and the work is linear in cells at any width.
    """
    kinds: dict[str, list[int]] = {}
    for i, f in enumerate(df.schema.fields):
        kinds.setdefault(f.dataType.simpleString(), []).append(i)
    out = None
    for at in kinds.values():
        cells = F.array(*[F.struct(F.lit(i).alias("position"), qcol(df.columns[i]).alias("value")) for i in at])
        part = (df.select(F.inline(cells)).groupBy("position", "value").agg(F.count(F.lit(1)).alias("_c"))
                .groupBy("position").agg(F.count(F.lit(1)).cast("long").alias("n_unique")))
        out = part if out is None else out.unionByName(part)
    return out


def column_profile(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """Per column: type, missing count and share, distinct count (NULL counts as one value), alert.

    Counts come from a single aggregation over the table, whose one-row result
    is unpivoted; exact distinct counts from one stream of typed cells per data
    type (see :func:`_distinct_counts`).  ``approx=True`` swaps the exact distinct count for
    HyperLogLog++ (no shuffle of values) for very wide or very large tables.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = qcol(f.name)
        aggs.append(F.sum(c.isNull().cast("long")).alias(f"_m{i}"))
        if approx:
            aggs.append((F.approx_count_distinct(c) + F.max(c.isNull().cast("int"))).alias(f"_u{i}"))
    one = df.agg(*aggs)
    if not approx:
        # one number per column
        uniq = {r["position"]: r["n_unique"] for r in _distinct_counts(df).collect()}
        one = one.select("*", *[F.lit(uniq.get(i, 0)).cast("long").alias(f"_u{i}") for i in range(len(fields))])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(type_name(f.dataType)).alias("type"),
            F.coalesce(F.col(f"_m{i}"), F.lit(0)).cast("long").alias("n_missing"),
            F.coalesce(F.col(f"_u{i}"), F.lit(0)).cast("long").alias("n_unique"),
            F.lit(is_string(f.dataType)).alias("_is_text"),
        )
        for i, f in enumerate(fields)
    ])
    long = one.select(F.col("_n").cast("long").alias("n_total"), F.inline(rows))
    pct = round_dp(F.try_divide(F.col("n_missing").cast("double") * 100.0, F.col("n_total").cast("double")), 1)
    long = long.withColumn("pct_missing", pct)
    alert = (F.when(F.col("pct_missing") > 50, F.lit(ALERT_OVER_50))
             .when(F.col("pct_missing") > 20, F.lit(ALERT_OVER_20))
             .when(F.col("n_unique") == 1, F.lit(ALERT_CONSTANT))
             .when((F.col("n_unique") == F.col("n_total")) & F.col("_is_text"), F.lit(ALERT_ID_LIKE))
             .otherwise(F.lit(ALERT_OK)))
    return (long.withColumn("alert", alert)
            .select("column", "type", "n_missing", "pct_missing", "n_unique", "n_total", "alert", "position")
            .orderBy(F.desc("pct_missing"), F.asc("position")))


def missing_rows(df: DataFrame, id_col: str) -> DataFrame:
    """Rows with at least one missing cell: id, count, share of columns, column names in schema order."""
    names = df.columns
    n_missing = sum((qcol(c).isNull().cast("int") for c in names), F.lit(0))
    which = F.concat_ws(", ", *[F.when(qcol(c).isNull(), F.lit(c)) for c in names])
    return (df.select(qcol(id_col).alias(id_col), n_missing.alias("n_missing"), which.alias("missing_columns"))
            .where(F.col("n_missing") > 0)
            .select(id_col, F.col("n_missing").cast("long").alias("n_missing"),
                    round_dp(F.col("n_missing") * 100.0 / F.lit(float(len(names))), 1).alias("pct_missing"),
                    "missing_columns")
            .orderBy(F.desc("n_missing"), F.asc(id_col)))


def _block_starts(keys: DataFrame, n_known: int, total: int, blocks: int) -> list[tuple[int, object]]:
    """Block numbers and their first values, at most ``blocks``: by selection, or by ranking for texts (no sketch of them) and bad sketches."""
    if is_numeric(keys.schema["_order"].dataType):
        try:
            return block_starts(keys, F.col("_order"), n_known, total, blocks)
        except MissedError:
            pass
    block = F.floor(F.col("before") * F.lit(blocks) / F.lit(total)).cast("long")
    rows = ranked_counts(keys, "_order").groupBy(block.alias("block")).agg(F.min("value").alias("first")).collect() if n_known else []
    return sorted((r["block"], r["first"]) for r in rows)


def missing_map(df: DataFrame, order_by: str, blocks: int = 100) -> DataFrame:
    """Missingness grid with bounded output: ``(block, column, missing_rate)``.

    Rows stand in ``order_by`` order and are cut into ``blocks`` blocks of
    equal size; rows of the same value stand in the block of the first of
    them, rows without a value after all others in the block where they begin.
    Selection only yields the first value of each block; the rows then need
    one narrow projection and one aggregation.
    """
    names = df.columns
    total, n_known = df.agg(F.count(F.lit(1)), F.count(qcol(order_by))).first()
    order = exact_key(qcol(order_by), df.schema[order_by].dataType)
    starts = _block_starts(df.select(order.alias("_order")), n_known, total, blocks)

    def place(lo: int, hi: int) -> str:
        """Binary search of the order value among the blocks' first values, as SQL text."""
        if hi - lo == 1:
            return str(starts[lo][0])
        mid = (lo + hi) // 2
        first = starts[mid][1]
        quoted = literal(first) if not isinstance(first, (str, bool)) else str(first).lower() if isinstance(first, bool) else "decode(unhex('" + first.encode().hex() + "'), 'UTF-8')"
        return f"CASE WHEN _order < {quoted} THEN {place(lo, mid)} ELSE {place(mid, hi)} END"

    after = F.lit(int(n_known * blocks // total) if total else 0).cast("long")
    block = F.when(F.col("_order").isNull(), after).otherwise(F.expr(place(0, len(starts))).cast("long")) if starts else after
    flags = [qcol(c).isNull().cast("double").alias(c) for c in names]
    rows = df.select(order.alias("_order"), *[f.alias(f"_f{i}") for i, f in enumerate(flags)])
    per = rows.select(block.alias("block"), *[F.col(f"_f{i}").alias(c) for i, c in enumerate(names)]).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(qcol(c)).alias(c) for c in names])
    return per.unpivot(["block", "n_rows"], names, "column", "missing_rate")
