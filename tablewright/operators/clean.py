"""Cleaning: missing values, duplicates, scaling, encoding, outliers.

Each operator follows *fit then transform*: one small aggregation (an action
returning a few numbers per column) and then a narrow projection or filter
with those numbers inlined as literals, so the transform adds no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, qcol, string_columns
from ..functions.rounding import round_dp
from .rank import join_back, quantile_map, ranked_counts, table_size


# ------------------------------------------------------------------ missing
def drop_missing_rows(df: DataFrame) -> DataFrame:
    """Keep rows with no missing cell."""
    return df.na.drop(how="any")


def null_rates(df: DataFrame, cols: list[str] | None = None) -> dict[str, float]:
    cols = cols or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(qcol(c).isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(cols)]).first()
    n = row["_n"] or 0
    return {c: ((row[f"_m{i}"] or 0) / n if n else 0.0) for i, c in enumerate(cols)}


def null_counts(df: DataFrame, cols: list[str] | None = None) -> dict[str, int]:
    cols = cols or df.columns
    row = df.agg(*[F.sum(qcol(c).isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(cols)]).first()
    return {c: int(row[f"_m{i}"] or 0) for i, c in enumerate(cols)}


def drop_missing_columns(df: DataFrame, threshold_pct: float = 50.0) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share is strictly above ``threshold_pct`` percent."""
    rates = null_rates(df)
    drop = [c for c in df.columns if rates[c] > threshold_pct / 100.0]
    return df.select(*[qcol(c) for c in df.columns if c not in drop]), drop


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-missing value per column; ties go to the smallest value.

    Distributed: ``groupBy(column, value).count()`` (map-side combined), then
    the best count per column; never one buffer holding every value.
    """
    if not cols:
        return {}
    long = df.select(*[qcol(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    vc = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = vc.groupBy("column").agg(F.max("cnt").alias("mx"))
    won = (vc.join(best, "column").where(F.col("cnt") == F.col("mx"))
           .groupBy("column").agg(F.min("value").alias("mode")))
    return {r["column"]: r["mode"] for r in won.collect()}


def impute(df: DataFrame, numeric: str = "mean", cols: list[str] | None = None,
           categorical: bool = True) -> tuple[DataFrame, int]:
    """Fill missing numeric cells with the column mean/median/mode and text cells with the mode.

    Imputed numeric columns become double.  Returns the table and the number
    of cells filled.
    """
    num = [c for c in (cols or numeric_columns(df)) if c in numeric_columns(df)]
    txt = string_columns(df) if categorical else []
    # one pass: missing counts of every candidate column, and the means when those are the fill
    allc = num + txt
    aggs = [F.sum(qcol(c).isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(allc)]
    if numeric == "mean":
        aggs += [F.avg(qcol(c)).alias(f"_a{i}") for i, c in enumerate(num)]
    row = df.agg(*aggs).first() if aggs else None
    counts = {c: int(row[f"_m{i}"] or 0) for i, c in enumerate(allc)} if row else {}
    means = {c: row[f"_a{i}"] for i, c in enumerate(num)} if (row and numeric == "mean") else {}
    num = [c for c in num if counts[c] > 0]
    txt = [c for c in txt if counts[c] > 0]
    fill: dict[str, object] = {}
    if num:
        if numeric == "mean":
            fill.update({c: means[c] for c in num})
        elif numeric == "median":
            qm = quantile_map(df, num, [0.5])
            fill.update({c: qm[c][0] for c in num})
        elif numeric == "mode":
            dbl = df.select(*[qcol(c).cast("double").alias(c) for c in num])
            fill.update(modes(dbl, num))
        else:
            raise ValueError(f"unknown numeric imputation: {numeric}")
    if txt:
        fill.update(modes(df, txt))
    exprs = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if f.name in num:
            v = fill.get(f.name)
            exprs.append(F.coalesce(c.cast("double"), F.lit(v).cast("double")).alias(f.name))
        elif f.name in txt and fill.get(f.name) is not None:
            exprs.append(F.coalesce(c, F.lit(fill[f.name])).alias(f.name))
        else:
            exprs.append(c)
    n_filled = sum(counts[c] for c in num + txt if fill.get(c) is not None)
    return df.select(*exprs), n_filled


# --------------------------------------------------------------- duplicates
def dedup(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (NULL equals NULL)."""
    return df.dropDuplicates()


# ------------------------------------------------------------------ scaling
def _replace(df: DataFrame, new: dict[str, object]) -> DataFrame:
    return df.select(*[(new[c].alias(c) if c in new else qcol(c)) for c in df.columns])


def scale(df: DataFrame, method: str = "zscore", cols: list[str] | None = None, *,
          approx: bool = False) -> DataFrame:
    """Scale numeric columns: ``zscore`` (sample sd), ``minmax`` to [0, 1], ``robust`` (median/IQR).

    Constant columns: z-score gives NULL, min-max gives 0, robust gives x - median.
    """
    cols = cols or numeric_columns(df)
    if not cols:
        return df
    new = {}
    if method == "zscore":
        row = df.agg(*[F.avg(qcol(c)).alias(f"_a{i}") for i, c in enumerate(cols)],
                     *[F.stddev_samp(qcol(c)).alias(f"_s{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            m, s = row[f"_a{i}"], row[f"_s{i}"]
            x = qcol(c).cast("double")
            new[c] = F.try_divide(x - F.lit(m), F.lit(s if s else None).cast("double"))
    elif method == "minmax":
        row = df.agg(*[F.min(qcol(c)).alias(f"_lo{i}") for i, c in enumerate(cols)],
                     *[F.max(qcol(c)).alias(f"_hi{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            lo, hi = row[f"_lo{i}"], row[f"_hi{i}"]
            x = qcol(c).cast("double")
            if lo is None:
                new[c] = x
            elif hi == lo:
                new[c] = F.when(x.isNotNull(), F.lit(0.0))
            else:
                new[c] = (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    elif method == "robust":
        qm = quantile_map(df, cols, [0.25, 0.5, 0.75], approx=approx)
        for c in cols:
            q1, med, q3 = qm[c]
            x = qcol(c).cast("double")
            if med is None:
                new[c] = x
            elif q3 - q1 == 0:
                new[c] = x - F.lit(med)
            else:
                new[c] = (x - F.lit(med)) / F.lit(q3 - q1)
    else:
        raise ValueError(f"unknown scaling: {method}")
    return _replace(df, new)


# ----------------------------------------------------------------- encoding
def label_codes(df: DataFrame, col: str) -> DataFrame:
    """``(level, code)``: 1-based code of each distinct non-missing level in sorted order."""
    rc = ranked_counts(df.select(qcol(col).alias("_lvl")).distinct(), "_lvl")
    out = rc.select(F.col("value").alias("_level"), (F.col("before") + 1).cast("double").alias("_code"))
    out._tablewright_rows = table_size(rc)
    return out


def encode_label(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace each column by its 1-based sorted-level code (double); missing stays missing.

    The level table is joined back; AQE broadcasts it at run time when it is
    small and falls back to a shuffle join when it is not.
    """
    out = df
    for c in cols:
        if c not in out.columns:
            continue
        codes = label_codes(out, c)
        order = out.columns
        out = (join_back(out, codes, qcol(c) == F.col("_level"), table_size(codes), "left")
               .select(*[(F.col("_code").alias(x) if x == c else qcol(x)) for x in order]))
    return out


def onehot_long(df: DataFrame, id_cols: list[str], cols: list[str]) -> DataFrame:
    """``(*id_cols, column, level)``: one row per 1 of a one-hot encoding, for any number of levels."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("level")) for c in cols])
    return df.select(*[qcol(c).alias(c) for c in id_cols], F.inline(cells)).where(F.col("level").isNotNull())


def encode_onehot(df: DataFrame, cols: list[str], *, max_levels: int = 200) -> DataFrame:
    """Replace each column by 0/1 dummies ``<col>_<level>`` (sorted levels) appended at the end.

    The output schema depends on the data, so the distinct levels are
    collected first; more than ``max_levels`` levels raises instead of
    building an unbounded schema (:func:`onehot_long` has no limit).  A missing cell gives all-zero dummies.
    """
    out = df
    for c in cols:
        if c not in out.columns:
            continue
        levels = [r[0] for r in out.select(qcol(c)).where(qcol(c).isNotNull()).distinct()
                  .limit(max_levels + 1).collect()]
        if len(levels) > max_levels:
            raise ValueError(f"column {c!r} has more than {max_levels} levels; raise max_levels to encode it")
        levels = sorted(levels)
        dummies = [F.when(qcol(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}") for v in levels]
        out = out.select(*[qcol(x) for x in out.columns if x != c], *dummies)
    return out


# ----------------------------------------------------------------- outliers
@dataclass(frozen=True)
class Bounds:
    lower: float | None
    upper: float | None
    center: float | None = None  # median (iqr) or mean (z)
    spread: float | None = None  # IQR or sd


def iqr_bounds(df: DataFrame, cols: list[str], *, approx: bool = False) -> dict[str, Bounds]:
    qm = quantile_map(df, cols, [0.25, 0.5, 0.75], approx=approx)
    out = {}
    for c in cols:
        q1, med, q3 = qm[c]
        if q1 is None:
            out[c] = Bounds(None, None)
            continue
        iqr = q3 - q1
        out[c] = Bounds(q1 - 1.5 * iqr, q3 + 1.5 * iqr, med, iqr)
    return out


def z_bounds(df: DataFrame, cols: list[str]) -> dict[str, Bounds]:
    row = df.agg(*[F.avg(qcol(c)).alias(f"_a{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(qcol(c)).alias(f"_s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"_a{i}"], row[f"_s{i}"]
        if m is None or s is None or s == 0:
            out[c] = Bounds(None, None, m, s)
        else:
            out[c] = Bounds(m - 3 * s, m + 3 * s, m, s)
    return out


def outlier_bounds(df: DataFrame, method: str, cols: list[str], *, approx: bool = False) -> dict[str, Bounds]:
    if method == "iqr":
        return iqr_bounds(df, cols, approx=approx)
    if method == "z":
        return z_bounds(df, cols)
    raise ValueError(f"unknown outlier method: {method}")


def outlier_predicate(c, b: Bounds, method: str):
    """True for an outlier; missing cells are never outliers."""
    x = qcol(c).cast("double")
    if b.lower is None:
        return F.lit(False)
    if method == "z":
        # |x - mean| / sd > 3, the definition the z rule states
        return F.coalesce(F.abs(x - F.lit(b.center)) / F.lit(b.spread) > F.lit(3.0), F.lit(False))
    return F.coalesce((x < F.lit(b.lower)) | (x > F.lit(b.upper)), F.lit(False))


def outlier_flags(df: DataFrame, method: str = "iqr", cols: list[str] | None = None) -> DataFrame:
    """Append boolean ``<col>_outlier`` columns; data unchanged."""
    cols = cols or numeric_columns(df)
    bounds = outlier_bounds(df, method, cols)
    return df.select("*", *[outlier_predicate(c, bounds[c], method).alias(f"{c}_outlier") for c in cols])


def outlier_counts(df: DataFrame, method: str, cols: list[str], bounds: dict[str, Bounds] | None = None
                   ) -> dict[str, int]:
    bounds = bounds or outlier_bounds(df, method, cols)
    row = df.agg(*[F.sum(outlier_predicate(c, bounds[c], method).cast("long")).alias(f"_o{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: int(row[f"_o{i}"] or 0) for i, c in enumerate(cols)}


def remove_outliers_sequential(df: DataFrame, method: str = "iqr", cols: list[str] | None = None, *,
                               checkpoint_every: int = 4) -> tuple[DataFrame, int]:
    """Remove outlier rows column by column, each column's bounds computed on the survivors.

    Inherently one pass per column.  Lineage is cut with a reliable
    ``checkpoint()`` (to the session's shared checkpoint folder) every
    ``checkpoint_every`` columns so a long column list neither re-plans a
    deep tree nor recomputes from the source after a lost executor.
    """
    cols = cols or numeric_columns(df)
    removed = 0
    cur = df
    for i, c in enumerate(cols):
        b = outlier_bounds(cur, method, [c])[c]
        n_out = outlier_counts(cur, method, [c], {c: b})[c]
        if n_out > 0:
            cur = cur.where(~outlier_predicate(c, b, method))
            removed += n_out
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < len(cols):
            cur = cur.checkpoint(eager=True)
    return cur, removed


def remove_outliers_parallel(df: DataFrame, method: str = "iqr", cols: list[str] | None = None
                             ) -> tuple[DataFrame, int]:
    """One-pass variant: every column's bounds from the same (unfiltered) table, then one filter.

    Cheaper than :func:`remove_outliers_sequential` (one fit pass for all
    columns) but not the same result: later columns' bounds are not
    recomputed on the survivors.
    """
    cols = cols or numeric_columns(df)
    bounds = outlier_bounds(df, method, cols)
    any_out = F.lit(False)
    for c in cols:
        any_out = any_out | outlier_predicate(c, bounds[c], method)
    n_out = df.agg(F.sum(any_out.cast("long"))).first()[0] or 0
    return df.where(~any_out), int(n_out)


def cap_outliers(df: DataFrame, method: str = "iqr", cols: list[str] | None = None) -> tuple[DataFrame, int]:
    """Winsorise to the IQR fences or mean +/- 3 sd.  Columns are independent: one fit pass."""
    cols = cols or numeric_columns(df)
    bounds = outlier_bounds(df, method, cols)
    counts = outlier_counts(df, method, cols, bounds)
    new = {}
    for c in cols:
        b = bounds[c]
        if counts[c] == 0 or b.lower is None:
            continue
        x = qcol(c)
        new[c] = F.when(x.isNull(), x).otherwise(F.greatest(F.least(x, F.lit(b.upper)), F.lit(b.lower)))
    return _replace(df, new), sum(counts.values())


def outlier_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: IQR and z outlier counts, min, max, mean, sd (3 dp).  Non-sequential."""
    cols = cols or numeric_columns(df)
    ib = iqr_bounds(df, cols)
    zb = z_bounds(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        aggs += [F.sum(outlier_predicate(c, ib[c], "iqr").cast("long")).alias(f"_i{i}"),
                 F.sum(outlier_predicate(c, zb[c], "z").cast("long")).alias(f"_z{i}"),
                 F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"),
        F.col(f"_i{i}").cast("long").alias("iqr_outliers"),
        F.col(f"_z{i}").cast("long").alias("zscore_outliers"),
        round_dp(F.col(f"_lo{i}"), 3).alias("min"),
        round_dp(F.col(f"_hi{i}"), 3).alias("max"),
        round_dp(F.lit(zb[c].center).cast("double"), 3).alias("mean"),
        round_dp(F.lit(zb[c].spread).cast("double"), 3).alias("sd"),
    ) for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


# ------------------------------------------------------------ before/after
def table_facts(df: DataFrame, stage: str) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows (n - n distinct) of a table."""
    miss = sum((qcol(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    n_distinct = df.distinct().count()
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(miss).alias("missing_cells"))
    listing = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields)
    return base.select(
        F.lit(stage).alias("stage"), F.col("n_rows").cast("long").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).cast("long").alias("missing_cells"),
        (F.col("n_rows") - F.lit(n_distinct)).cast("long").alias("duplicate_rows"),
        F.lit(listing).alias("columns"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    return table_facts(before, "before").unionByName(table_facts(after, "after"))


def long_numeric(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """All numeric columns (or the first ``max_cols``) as ``(variable, value)`` rows."""
    cols = numeric_columns(df)[:max_cols]
    return (df.select(*[qcol(c).cast("double").alias(c) for c in cols])
            .unpivot([], cols, "variable", "value"))
