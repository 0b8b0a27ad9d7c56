"""Distributed ranking and exact quantiles.

``Window.orderBy`` without a partition key sends every row to one task, and
the exact ``percentile`` aggregate keeps all values of a group in one buffer.
Neither survives a 100 TB column.  Instead, at every size and for every type:

1. ``groupBy(group, value).count()`` collapses duplicates map-side, so a hot
   value (a third of all rows) becomes a single row with a large count.  The
   counts are written once to the cluster's shared folder: all later steps
   read that table, a lost executor only costs a re-read, and nothing stays
   cached.
2. Every value lands in a bucket of bounded size.  Buckets are ranges of an
   order-preserving numeric key of the value (days, microseconds, the bytes
   after a common text prefix, ...), split at approximate quantiles of that
   key.  One bucket is just the case without split points.
3. Per-(group, bucket) totals (a small table) give bucket offsets; a window
   partitioned by (group, bucket) gives the exact running count inside.

The result has one row per distinct value: ``before`` rows of the same group
are strictly smaller, ``cnt`` rows equal it.  Positions, average ranks and
type-7 quantiles all follow from it.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, qcol
from ..session import scratch_path
from .select import selected

#: distinct values per window task (windows sort and spill, and the split points every task carries
#: stay under ~1 MB even at 1e12 distinct values)
TARGET_BUCKET_ROWS = 1_000_000
#: bytes of a text that its numeric key holds, from the first byte in which the column's texts differ
KEY_BYTES = 6


def bucket_count(n_rows: int, target_rows: int | None = None) -> int:
    """Buckets for ``n_rows`` distinct values: enough to bound each window task."""
    return max(1, math.ceil(n_rows / (target_rows or TARGET_BUCKET_ROWS)))


def order_key(c: Column, dtype: T.DataType, skip: int = 0) -> Column:
    """A double that never decreases as the value grows; ``skip`` leading bytes of a text are left out."""
    if is_numeric(dtype):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, c).cast("double")
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
        part = F.hex(F.substring(c.cast("binary"), skip + 1, KEY_BYTES))
        return F.conv(F.rpad(part, 2 * KEY_BYTES, "0"), 16, 10).cast("double")
    raise TypeError(f"cannot rank values of type {dtype.simpleString()}")


def exact_key(c: Column, dtype: T.DataType) -> Column:
    """A column in the order of ``c`` whose values can be written as literals: days and microseconds for dates and times."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return c


def _bucketize(vc: DataFrame, n_buckets: int) -> DataFrame:
    dtype, skip, splits = vc.schema["_value"].dataType, 0, []
    if n_buckets > 1:
        if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
            ends = vc.select(F.col("_value").cast("binary").alias("v")).agg(F.min("v"), F.max("v")).first()
            skip = len(os.path.commonprefix([bytes(e) for e in ends if e is not None]))
        probs = [i / n_buckets for i in range(1, n_buckets)]
        # rank error n/accuracy stays below a quarter bucket, so buckets stay within ~1.5x of the target
        found = vc.agg(F.percentile_approx(order_key(F.col("_value"), dtype, skip), probs, max(10_000, 4 * n_buckets))).first()[0]
        splits = sorted({float(x) for x in found or [] if x is not None and not math.isnan(x)})
    if not splits:
        return vc.withColumn("_bucket", F.lit(0))
    bucketizer = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="_key_d", outputCol="_bucket_d", handleInvalid="keep")
    keyed = vc.withColumn("_key_d", order_key(F.col("_value"), dtype, skip))
    return bucketizer.transform(keyed).withColumn("_bucket", F.col("_bucket_d").cast("int")).drop("_key_d", "_bucket_d")


#: rank tables up to this many rows are broadcast when joined back to row-level data
BROADCAST_RANK_ROWS = 200_000


def join_back(rows: DataFrame, table: DataFrame, cond, n_table_rows: int | None, how: str = "inner") -> DataFrame:
    """Join a per-value table (ranks, codes) back to row-level data.

    The table is broadcast only when its counted size is small; otherwise a
    sort-merge join is forced so the optimizer never broadcasts the row side
    (whose size estimate after column pruning can look small).
    """
    if n_table_rows is not None and n_table_rows <= BROADCAST_RANK_ROWS:
        return rows.join(F.broadcast(table), cond, how)
    return rows.hint("merge").join(table, cond, how)


def ranked_counts(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str] = (),
    *,
    weight: str | Column | None = None,
    target_rows: int | None = None,
    carry: Sequence[str] = (),
    cumulate: Sequence[str] = (),
) -> DataFrame:
    """Distinct values per group with exact ranks.

    Returns ``(*by, value, cnt, before, total)``: ``before`` counts rows of the
    same group with a strictly smaller value, ``total`` the group's non-null
    rows.  NULL values are dropped.  ``weight`` (a count column) lets callers
    feed pre-aggregated rows; ``carry`` columns are summed per distinct value
    and passed through; ``cumulate`` columns as well, and their sums over the
    smaller values come as ``before_<name>``.  Buckets hold about
    ``target_rows`` distinct values (default ``TARGET_BUCKET_ROWS``).
    """
    by, carry, cumulate = list(by), list(carry), list(cumulate)
    vcol = qcol(value) if isinstance(value, str) else value
    wcol = F.lit(1).cast("long") if weight is None else (qcol(weight) if isinstance(weight, str) else weight)
    extra = [*carry, *cumulate]
    vc = written(
        df.select(*[qcol(b).alias(b) for b in by], vcol.alias("_value"), wcol.cast("long").alias("_w"),
                  *[qcol(c).alias(c) for c in extra])
        .where(F.col("_value").isNotNull())
        .groupBy(*by, "_value")
        .agg(F.sum("_w").alias("cnt"), *[F.sum(c).alias(c) for c in extra]), "ranking")
    n_rows = vc.count()
    vcb = _bucketize(vc, bucket_count(n_rows, target_rows))
    grp = Window.partitionBy(*[F.col(b) for b in by])
    sums = ["cnt", *cumulate]
    wb = grp.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = (vcb.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
            .select(*[F.col(b).alias(f"_o_{b}") for b in by], F.col("_bucket").alias("_o_bucket"),
                    *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_before_{c}") for c in sums],
                    F.sum("_t_cnt").over(grp).alias("_total")))
    cond = [F.col("_bucket") == F.col("_o_bucket")] + [F.col(b).eqNullSafe(F.col(f"_o_{b}")) for b in by]
    w = Window.partitionBy(*[F.col(b) for b in by], F.col("_bucket")).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = vcb.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_in_{c}") for c in sums])
    joined = inside.join(offs, on=cond, how="inner")
    res = joined.select(
        *by, F.col("_value").alias("value"), F.col("cnt").cast("long").alias("cnt"),
        (F.col("_before_cnt") + F.col("_in_cnt")).cast("long").alias("before"), F.col("_total").cast("long").alias("total"),
        *extra, *[(F.col(f"_before_{c}") + F.col(f"_in_{c}")).cast("long").alias(f"before_{c}") for c in cumulate])
    res._tablewright_rows = n_rows
    return res


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_size(df: DataFrame) -> int | None:
    """Row count of a table returned by :func:`ranked_counts` (known from its planning pass)."""
    return getattr(df, "_tablewright_rows", None)


def average_rank(rc: DataFrame) -> Column:
    """Average (mid) rank of a tie group, 1-based, as in ``rank(ties='average')``."""
    return F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)


def unpivot_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                   name_col: str = "column", value_col: str = "value") -> DataFrame:
    """Long form ``(*by, column, value)`` with values cast to double."""
    by = list(by)
    base = df.select(*[qcol(b).alias(b) for b in by], *[qcol(c).cast("double").alias(c) for c in cols])
    return base.unpivot(by, list(cols), name_col, value_col)


def _type7_positions(p: float) -> tuple[Column, Column, Column]:
    h = (F.col("total") - F.lit(1)).cast("double") * F.lit(float(p))
    lo = F.floor(h).cast("long")
    hi = F.ceil(h).cast("long")
    return lo, hi, h - lo.cast("double")


def ranked_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Type-7 quantiles from the full ranking: ``(*by, column, n, q0, q1, ...)``, one row per (group, column)."""
    by = list(by)
    keys = [*by, "column"]
    rc = ranked_counts(unpivot_values(df, cols, by), "value", keys)
    hit = F.lit(False)
    aggs = [F.max("total").alias("n")]
    contains = lambda pos: (F.col("before") <= pos) & (pos < F.col("before") + F.col("cnt"))
    for i, p in enumerate(probs):
        lo, hi, frac = _type7_positions(p)
        hit = hit | contains(lo) | contains(hi)
        aggs += [F.max(F.when(contains(lo), F.col("value"))).alias(f"_lo{i}"),
                 F.max(F.when(contains(hi), F.col("value"))).alias(f"_hi{i}"),
                 F.max(frac).alias(f"_f{i}")]
    agg = rc.where(hit).groupBy(*keys).agg(*aggs)
    return agg.select(*keys, F.col("n").cast("long").alias("n"), *[
        (F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}")
        for i in range(len(probs))
    ])


def quantiles_long(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    approx: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Type-7 quantiles of several columns (optionally per group), exact by default.

    Whole columns go through selection (:mod:`.select`), groups through the
    ranking.  Returns ``(*by, column, n, q0, q1, ...)`` -- one row per
    (group, column) that has values.
    """
    by = list(by)
    if approx:
        long = unpivot_values(df, cols, by)
        return (long.where(F.col("value").isNotNull()).groupBy(*by, "column")
                .agg(F.count("value").alias("n"),
                     *[F.percentile_approx("value", float(p), accuracy).alias(f"q{i}")
                       for i, p in enumerate(probs)]))
    if by:
        return ranked_quantiles(df, cols, probs, by)
    found = selected(df, cols, probs)
    schema = ", ".join(["column string, n bigint", *[f"q{i} double" for i in range(len(probs))]])
    return df.sparkSession.createDataFrame([(c, f["n"], *f["q"]) for c, f in found.items() if f["n"]], schema)


def quantile_map(df: DataFrame, cols: Sequence[str], probs: Sequence[float], *, approx: bool = False
                 ) -> dict[str, list[float | None]]:
    """Driver-side {column: [q...]} for a few columns (summary-sized)."""
    if not approx:
        return {c: f["q"] for c, f in selected(df, cols, probs).items()}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for r in quantiles_long(df, cols, probs, approx=True).collect():
        out[r["column"]] = [r[f"q{i}"] for i in range(len(probs))]
    return out


def positions(df: DataFrame, order_col: str) -> DataFrame:
    """Attach a 1-based global position ``_pos`` by ``order_col`` (must be unique, non-null).

    No single-partition window: the ranks come from :func:`ranked_counts`
    joined back on the key.
    """
    rc0 = ranked_counts(df, order_col)
    rc = rc0.select(F.col("value").alias("_key"), (F.col("before") + 1).alias("_pos"), F.col("total").alias("_n"))
    return join_back(df, rc, qcol(order_col) == F.col("_key"), table_size(rc0)).drop("_key")
