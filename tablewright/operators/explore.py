"""Exploration: filters, chart data (histogram, density, box, QQ, bars, scatter bins, trend) and summaries.

The reference draws charts; here we compute the data behind each one as a
DataFrame.  Grids have a fixed size, so chart outputs stay bounded whatever
the row count, except QQ points, which are one row per input row by
definition and are produced in parallel chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import is_numeric, numeric_columns, qcol, string_columns
from ..functions.special import qnorm_col, qt
from .rank import quantiles_long, ranked_counts, written
from .select import selected

SQRT_2PI = math.sqrt(2.0 * math.pi)
#: positions per chunk when a tie group's QQ points are expanded
QQ_CHUNK = 100_000


# ------------------------------------------------------------------ filters
def filter_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Inclusive numeric range; missing cells are excluded."""
    return df.where(qcol(col).between(lo, hi))


def filter_in(df: DataFrame, col: str, values: list, *, inline_limit: int = 1000) -> DataFrame:
    """Membership filter; an empty list means no filter.

    Short lists become an ``IN`` predicate (pushed to the scan); long lists a
    left-semi join against a broadcast table whose size is the list length.
    """
    if not values:
        return df
    if len(values) <= inline_limit:
        return df.where(qcol(col).isin(list(values)))
    spark = SparkSession.getActiveSession()
    keys = spark.createDataFrame([(v,) for v in values], ["_k"])
    return df.join(F.broadcast(keys), qcol(col) == F.col("_k"), "left_semi")


def filter_domain(df: DataFrame, col: str) -> DataFrame:
    """Values a filter can take: ``(min, max)`` for numbers, distinct values otherwise."""
    if is_numeric(df.schema[col].dataType):
        return df.agg(F.min(qcol(col)).cast("double").alias("min"), F.max(qcol(col)).cast("double").alias("max"))
    return df.select(qcol(col).alias("value")).distinct()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows over the cluster's task slots before a CPU-heavy expansion.

    Adaptive execution merges small shuffle partitions by byte size, which
    would put a step that multiplies the work by hundreds into one task; an
    explicit partition count is kept as given.
    """
    # one partition per task slot: the point is to occupy every core, not to follow the shuffle setting
    n = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *[F.col(k) for k in keys])


# ---------------------------------------------------------------- histogram
def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width histogram, first bin centred on the minimum, right-closed bins.

    ``w = (max - min) / (bins - 1)``; ``bin = ceil((x - min) / w - 0.5)``.  With
    ``by``, bins span the overall range and counts/densities are per group.
    Every bin is returned, empty ones with count 0.
    """
    x = qcol(col).cast("double")
    st = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    if lo is None:
        raise ValueError(f"column {col!r} has no values")
    if hi == lo or bins <= 1:
        nb, w = 1, 1.0
        b = F.lit(0)
    else:
        nb, w = bins, (hi - lo) / (bins - 1)
        b = F.least(F.greatest(F.ceil((x - F.lit(lo)) / F.lit(w) - F.lit(0.5)), F.lit(0)), F.lit(nb - 1))
    g = qcol(by).alias("group") if by else F.lit(None).cast("string").alias("group")
    counts = (df.select(g, b.cast("int").alias("bin")).where(x.isNotNull())
              .groupBy("group", "bin").agg(F.count(F.lit(1)).alias("count")))
    groups = counts.groupBy("group").agg(F.sum("count").alias("n_group"))
    grid = groups.select(F.col("group").alias("_gg"), "n_group",
                         F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("_gb"))
    out = grid.join(counts, [F.col("_gg").eqNullSafe(F.col("group")), F.col("_gb") == F.col("bin")], "left") \
        .select(F.col("_gg").alias("group"), F.col("_gb").alias("bin"),
                F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"), "n_group")
    center = F.lit(lo) + F.col("bin") * F.lit(w)
    out = out.select(
        "group", F.col("bin").cast("long").alias("bin"),
        center.alias("x"), (center - F.lit(w / 2)).alias("xmin"), (center + F.lit(w / 2)).alias("xmax"),
        "count", (F.col("count") / (F.col("n_group") * F.lit(w))).alias("density"))
    return out if by else out.drop("group")


# ------------------------------------------------------------------ density
#: fine grid over which a kernel density spreads its values before smoothing (per group, at every size)
FINE_GRID = 4096


def _ranked(df: DataFrame, col: str, by: str | None) -> DataFrame:
    """Distinct values per group ``_g`` with counts and ranks: all that box and density figures need."""
    g = qcol(by) if by else F.lit(None).cast("string")
    return ranked_counts(df.select(g.alias("_g"), qcol(col).cast("double").alias("_x")), "_x", by=["_g"])


def _box(rc: DataFrame) -> DataFrame:
    """Per group ``_qg``: n, min, max and the three quartiles (type 7) from ranked distinct values."""
    holds = lambda pos: (F.col("before") <= pos) & (pos < F.col("before") + F.col("cnt"))
    aggs = []
    for i, p in enumerate((0.25, 0.5, 0.75)):
        h = (F.col("total") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.max(F.when(holds(lo), F.col("value"))).alias(f"_lo{i}"),
                 F.max(F.when(holds(hi), F.col("value"))).alias(f"_hi{i}"), F.max(h - lo).alias(f"_f{i}")]
    agg = rc.groupBy(F.col("_g").alias("_qg")).agg(
        F.max("total").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), *aggs)
    q = [F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")) for i in range(3)]
    return agg.select("_qg", "n", "lo", "hi", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))


def _bandwidth(sd: Column, iqr: Column, n: Column, first: Column) -> Column:
    """Silverman's rule of thumb: 0.9 times the smaller of sd and iqr / 1.34 (whichever is above 0), times n ** -0.2."""
    spread_ = F.least(sd, iqr / F.lit(1.34))
    size = (F.when(spread_ > 0, spread_).when(sd > 0, sd).when(first != 0, F.abs(first)).otherwise(F.lit(1.0)))
    return F.lit(0.9) * size * F.pow(n.cast("double"), F.lit(-0.2))


def density(df: DataFrame, col: str, by: str | None = None, n_grid: int = 512) -> DataFrame:
    """Gaussian kernel density on an ``n_grid`` grid from min to max (per group), bandwidth nrd0.

    Every value is first spread linearly over its two neighbours on a fine
    grid of ``FINE_GRID`` points from min to max (one map-side aggregation of
    distinct values); the fine grid is then smoothed onto the output grid.
    The work after the aggregation is the same for every table size.  Groups
    are rows of tables throughout; nothing is collected.
    """
    return _density(_ranked(df, col, by), df, col, by, n_grid)


def _density(rc: DataFrame, df: DataFrame, col: str, by: str | None, n_grid: int) -> DataFrame:
    g = qcol(by) if by else F.lit(None).cast("string")
    x = qcol(col).cast("double")
    sd = (df.select(g.alias("_sg"), x.alias("_x")).groupBy("_sg").agg(F.coalesce(F.stddev_samp("_x"), F.lit(0.0)).alias("sd")))
    par = _box(rc).join(sd, F.col("_qg").eqNullSafe(F.col("_sg")))
    par = written(par.select(
        F.col("_qg").alias("_pg"), F.col("n").alias("_n"), F.col("lo").alias("_lo"), (F.col("hi") - F.col("lo")).alias("_span"),
        _bandwidth(F.col("sd"), F.col("q3") - F.col("q1"), F.col("n"), F.col("lo")).alias("_bw")), "density-groups")
    at = F.when(F.col("_span") > 0, (F.col("value") - F.col("_lo")) / F.col("_span") * F.lit(FINE_GRID - 1)).otherwise(F.lit(0.0))
    near = F.least(F.floor(F.col("_at")), F.lit(FINE_GRID - 2)).cast("int")
    part = F.col("_at") - F.col("_bin")
    fine = (rc.join(par.select("_pg", "_lo", "_span"), F.col("_g").eqNullSafe(F.col("_pg")))
            .select("_g", "cnt", at.alias("_at")).withColumn("_bin", near)
            .select("_g", F.inline(F.array(F.struct(F.col("_bin").alias("_b"), (F.col("cnt") * (F.lit(1.0) - part)).alias("_w")),
                                           F.struct((F.col("_bin") + 1).alias("_b"), (F.col("cnt") * part).alias("_w")))))
            .groupBy("_g", "_b").agg(F.sum("_w").alias("_w")).where(F.col("_w") > 0))
    step = F.col("_span") / F.lit(float(max(n_grid - 1, 1)))
    grid_x = F.col("_lo") + F.col("_idx") * step
    u = (grid_x - (F.col("_lo") + F.col("_b") * (F.col("_span") / F.lit(float(FINE_GRID - 1))))) / F.col("_bw")
    # at most FINE_GRID rows a group from here on
    sums = (spread(fine, "_g", "_b").join(par, F.col("_g").eqNullSafe(F.col("_pg")))
            .select("_pg", "_n", "_lo", "_span", "_bw", "_b", "_w", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("_idx"))
            .groupBy("_pg", "_n", "_lo", "_span", "_bw", "_idx").agg(F.sum(F.col("_w") * F.exp(F.lit(-0.5) * u * u)).alias("_k")))
    out = sums.select(
        F.col("_pg").alias("group"), F.col("_idx").cast("long").alias("idx"), grid_x.alias("x"),
        (F.col("_k") / (F.col("_n") * F.col("_bw") * F.lit(SQRT_2PI))).alias("density"), F.col("_bw").alias("bandwidth"))
    return out if by else out.drop("group")


# ------------------------------------------------------------------ boxplot
def boxplot_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Per group: n, q1, median, q3, whiskers (extreme values within 1.5 IQR), outlier count.

    Everything comes from the ranked distinct values; rows are read once.
    """
    out = _boxes(_ranked(df, col, by))
    return out if by else out.drop("group")


def _boxes(rc: DataFrame) -> DataFrame:
    q = _box(rc)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    lo_f, hi_f, x = F.col("q1") - reach, F.col("q3") + reach, F.col("value")
    return (rc.join(q, F.col("_g").eqNullSafe(F.col("_qg"))).groupBy("_qg", "n", "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_f, x)).alias("whisker_low"), F.max(F.when(x <= hi_f, x)).alias("whisker_high"),
        F.sum(F.when((x < lo_f) | (x > hi_f), F.col("cnt")).otherwise(F.lit(0))).cast("long").alias("n_outliers"))
        .select(F.col("_qg").alias("group"), F.col("n").cast("long").alias("n"), "q1", "median", "q3",
                "whisker_low", "whisker_high", "n_outliers"))


def violin(df: DataFrame, col: str, by: str, n_grid: int = 512) -> DataFrame:
    """Per group: density curve rows with the group's box statistics attached (one ranking for both)."""
    rc = _ranked(df, col, by)
    b = _boxes(rc).withColumnRenamed("group", "_bg")
    return _density(rc, df, col, by, n_grid).join(b, F.col("group").eqNullSafe(F.col("_bg"))).drop("_bg")


# -------------------------------------------------------------------- bars
def bar_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(qcol(col).alias(col)).agg(F.count(F.lit(1)).cast("long").alias("count"))


# ------------------------------------------------------------------ scatter
def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """2-D bin counts over the (x, y) bounding box: bounded output for a scatter plot."""
    xs, ys = qcol(x).cast("double"), qcol(y).cast("double")
    both = df.select(xs.alias("_x"), ys.alias("_y")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    st = both.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    x0, x1, y0, y1 = (float(v) if v is not None else 0.0 for v in st)
    wx = (x1 - x0) / bins if x1 > x0 else 1.0
    wy = (y1 - y0) / bins if y1 > y0 else 1.0
    bx = F.least(F.floor((F.col("_x") - F.lit(x0)) / F.lit(wx)), F.lit(bins - 1)).cast("long")
    by_ = F.least(F.floor((F.col("_y") - F.lit(y0)) / F.lit(wy)), F.lit(bins - 1)).cast("long")
    c = both.groupBy(bx.alias("bin_x"), by_.alias("bin_y")).agg(F.count(F.lit(1)).cast("long").alias("count"))
    return c.select("bin_x", "bin_y", (F.lit(x0) + (F.col("bin_x") + 0.5) * F.lit(wx)).alias("x"),
                    (F.lit(y0) + (F.col("bin_y") + 0.5) * F.lit(wy)).alias("y"), "count")


def pairs_panel(df: DataFrame, cols: list[str], bins: int = 20, n_grid: int = 128) -> DataFrame:
    """All parts of a pairs panel of 2 to 6 columns in one table.

    ``(part, var1, var2, i, j, x, y, value)``: the correlation of each pair
    (``corr``), each column's density curve (``density``: x and value) and each
    pair's two-dimensional bin counts (``points``: bin centres x, y and value).
    """
    from .correlate import corr_pearson

    if not 2 <= len(cols) <= 6:
        raise ValueError("a pairs panel takes 2 to 6 columns")
    none, whole = F.lit(None).cast("double"), F.lit(None).cast("long")
    out = corr_pearson(df, cols).where("var1 <> var2").select(
        F.lit("corr").alias("part"), "var1", "var2", whole.alias("i"), whole.alias("j"), none.alias("x"), none.alias("y"),
        F.col("corr").alias("value"))
    for c in cols:
        out = out.unionByName(density(df, c, None, n_grid).select(
            F.lit("density").alias("part"), F.lit(c).alias("var1"), F.lit(c).alias("var2"), F.col("idx").alias("i"),
            whole.alias("j"), "x", none.alias("y"), F.col("density").alias("value")))
    for k, a in enumerate(cols):
        for b in cols[k + 1:]:
            out = out.unionByName(scatter_bins(df, a, b, bins).select(
                F.lit("points").alias("part"), F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col("bin_x").alias("i"),
                F.col("bin_y").alias("j"), "x", "y", F.col("count").cast("double").alias("value")))
    return out


# -------------------------------------------------------------------- trend
def trend_fit(df: DataFrame, x: str, y: str) -> dict:
    xs, ys = qcol(x).cast("double"), qcol(y).cast("double")
    r = df.agg(F.regr_count(ys, xs).alias("n"), F.regr_slope(ys, xs).alias("b"),
               F.regr_intercept(ys, xs).alias("a"), F.regr_sxx(ys, xs).alias("sxx"),
               F.regr_syy(ys, xs).alias("syy"), F.regr_sxy(ys, xs).alias("sxy"),
               F.regr_avgx(ys, xs).alias("xbar"),
               F.min(F.when(ys.isNotNull(), xs)).alias("lo"), F.max(F.when(ys.isNotNull(), xs)).alias("hi")).first()
    return r.asDict()


def trend_line(df: DataFrame, x: str, y: str, grid: int = 80, level: float = 0.95) -> DataFrame:
    """Least-squares line with a pointwise confidence band on a ``grid``-point x grid."""
    f = trend_fit(df, x, y)
    n = f["n"]
    if not n or not f["sxx"]:
        raise ValueError(f"no line through {x!r}: it needs two different values beside {y!r}")
    sse = max(f["syy"] - f["b"] * f["sxy"], 0.0)
    s = math.sqrt(sse / (n - 2)) if n > 2 else float("nan")
    tcrit = qt(0.5 + level / 2, n - 2) if n > 2 else float("nan")
    spark = df.sparkSession
    step = (f["hi"] - f["lo"]) / (grid - 1)
    g = spark.range(grid).select(F.col("id").alias("idx"), (F.lit(f["lo"]) + F.col("id") * F.lit(step)).alias("x"))
    fit = F.lit(f["a"]) + F.lit(f["b"]) * F.col("x")
    se = F.lit(s) * F.sqrt(F.lit(1.0 / n) + (F.col("x") - F.lit(f["xbar"])) ** 2 / F.lit(f["sxx"]))
    return g.select("idx", "x", fit.alias("fit"), se.alias("se_fit"),
                    (fit - F.lit(tcrit) * se).alias("lower"), (fit + F.lit(tcrit) * se).alias("upper"))


# ----------------------------------------------------------------------- QQ
def ppoints_a(n: int) -> float:
    return 3.0 / 8.0 if n <= 10 else 0.5


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """Normal QQ points: every sorted value against ``qnorm((i - a) / (n + 1 - 2a))``.

    Ranks come from distinct-value counts; a tie group is expanded in chunks
    that are spread over tasks before the positions are generated, so a hot
    value does not land in one task.
    """
    rc = ranked_counts(df, qcol(col).cast("double"))
    n = rc.select("total").first()
    if n is None:
        return df.sparkSession.createDataFrame([], "position long, sample double, theoretical double")
    n = int(n[0])
    a = ppoints_a(n)
    pts = expand_positions(rc).select("position", F.col("value").alias("sample"))
    p = (F.col("position") - F.lit(a)) / F.lit(n + 1 - 2 * a)
    return pts.select("position", "sample", qnorm_col(p).alias("theoretical"))


def expand_positions(rc: DataFrame) -> DataFrame:
    """One row per sorted position from ranked distinct values ``(value, before, cnt, ...)``.

    A tie group is first cut into chunks of ``QQ_CHUNK`` positions that are
    hash-spread over tasks, then each chunk generates its positions, so a
    value holding a third of all rows is expanded by many tasks, not one.
    """
    chunks = rc.select("*", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("cnt") - 1) / F.lit(QQ_CHUNK)).cast("long"))).alias("_c"))
    spread_ = chunks.repartition("value", "_c")
    start = F.col("before") + F.col("_c") * F.lit(QQ_CHUNK) + 1
    stop = F.least(F.col("before") + F.col("cnt"), start + F.lit(QQ_CHUNK - 1))
    return spread_.select("*", F.explode(F.sequence(start, stop)).alias("position")).drop("_c")


QNORM_Q1 = -0.6744897501960817
QNORM_Q3 = 0.6744897501960817


def qq_line(df: DataFrame, col: str) -> DataFrame:
    """Line through the first and third quartiles of the sample against the normal quartiles."""
    q = quantiles_long(df, [col], [0.25, 0.75])
    slope = (F.col("q1") - F.col("q0")) / F.lit(QNORM_Q3 - QNORM_Q1)
    return q.select("column", F.col("q0").alias("q25"), F.col("q1").alias("q75"), slope.alias("slope"),
                    (F.col("q0") - slope * F.lit(QNORM_Q1)).alias("intercept"))


# ---------------------------------------------------------------- summaries
HIST_BINS = 8


def summary_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: missing, complete rate, mean, sd, p0/p25/p50/p75/p100, 8-bin histogram counts.

    Two passes for all columns: moments, range and quantile brackets, then the exact quantiles by selection together
    with the histogram counts.
    """
    cols = cols or numeric_columns(df)
    moments = [[F.count(F.lit(1)), F.avg(qcol(c).cast("double")), F.stddev_samp(qcol(c).cast("double"))] for c in cols]
    rows = []
    for c, f in selected(df, cols, (0.25, 0.5, 0.75), moments, HIST_BINS).items():
        n, mean, sd = f["more"]
        known = f["n"]
        hist = ",".join(str(k) for k in f["bins"]) if known else None
        rows.append((c, int(n - known), known / n if n else None, mean, sd, f["lo"], *f["q"], f["hi"], hist))
    schema = ("column string, n_missing long, complete_rate double, mean double, sd double, p0 double, "
              "p25 double, p50 double, p75 double, p100 double, hist string")
    return df.sparkSession.createDataFrame(rows, schema)


def summary_string(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per text column: missing, complete rate, min/max length, empty, distinct, whitespace-only counts."""
    from .profile import _distinct_counts

    cols = cols or string_columns(df)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = qcol(c)
        aggs += [F.sum(x.isNull().cast("long")).alias(f"_m{i}"), F.min(F.length(x)).alias(f"_lo{i}"),
                 F.max(F.length(x)).alias(f"_hi{i}"), F.sum((x == "").cast("long")).alias(f"_e{i}"),
                 F.sum(((F.length(x) > 0) & (F.trim(x) == "")).cast("long")).alias(f"_w{i}")]
    one = df.agg(*aggs)
    # distinct values per column through (column, value) cells, a missing one not counted; one number per column
    with_null = {r["position"]: r["n_unique"] for r in _distinct_counts(df.select(*[qcol(c).alias(c) for c in cols])).collect()}
    one = one.select("*", *[(F.lit(with_null.get(i, 0)) - (F.coalesce(F.col(f"_m{i}"), F.lit(0)) > 0).cast("int")).cast("long")
                            .alias(f"_u{i}") for i in range(len(cols))])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.coalesce(F.col(f"_m{i}"), F.lit(0)).cast("long").alias("n_missing"),
        (F.lit(1.0) - F.coalesce(F.col(f"_m{i}"), F.lit(0)) / F.col("_n")).alias("complete_rate"),
        F.col(f"_lo{i}").cast("long").alias("min_length"), F.col(f"_hi{i}").cast("long").alias("max_length"),
        F.coalesce(F.col(f"_e{i}"), F.lit(0)).cast("long").alias("n_empty"),
        F.col(f"_u{i}").cast("long").alias("n_unique"),
        F.coalesce(F.col(f"_w{i}"), F.lit(0)).cast("long").alias("n_whitespace"),
    ) for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def top_counts(df: DataFrame, cols: list[str], k: int = 4) -> DataFrame:
    """Top ``k`` values per column by count (ties: smaller value first).

    Value counts are distributed; the k-th largest count per column comes
    from the much smaller table of counts-of-counts, and only values at or
    above it (k plus ties) reach the final per-column ordering, so no task
    holds a whole column's distinct values.
    """
    long = df.select(*[qcol(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    vc = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    freq = vc.groupBy("column", "cnt").agg(F.count(F.lit(1)).alias("n_values"))
    w = Window.partitionBy("column").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    thr = (freq.withColumn("_above", F.coalesce(F.sum("n_values").over(w), F.lit(0)))
           .where(F.col("_above") < k).groupBy("column").agg(F.min("cnt").alias("_thr")))
    cand = vc.join(F.broadcast(thr), "column").where(F.col("cnt") >= F.col("_thr"))
    w2 = Window.partitionBy("column").orderBy(F.desc("cnt"), "value")
    return cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k) \
        .select("column", F.col("rank").cast("long"), "value", F.col("cnt").cast("long").alias("count"))


def summary_logical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Boolean columns: missing count, complete rate, share of TRUE (mean) and the TRUE/FALSE counts."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_missing long, complete_rate double, "
                                                   "mean double, n_true long, n_false long")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = qcol(c)
        aggs += [F.sum(x.isNull().cast("long")).alias(f"_m{i}"), F.avg(x.cast("double")).alias(f"_a{i}"),
                 F.sum(x.cast("long")).alias(f"_t{i}"), F.sum((~x).cast("long")).alias(f"_f{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.coalesce(F.col(f"_m{i}"), F.lit(0)).cast("long").alias("n_missing"),
        (F.lit(1.0) - F.coalesce(F.col(f"_m{i}"), F.lit(0)) / F.col("_n")).alias("complete_rate"),
        F.col(f"_a{i}").alias("mean"), F.coalesce(F.col(f"_t{i}"), F.lit(0)).cast("long").alias("n_true"),
        F.coalesce(F.col(f"_f{i}"), F.lit(0)).cast("long").alias("n_false")) for i, c in enumerate(cols)])
    return one.select(F.inline(rows))


def summary_other(df: DataFrame, factor_cols: list[str] | None = None, time_cols: list[str] | None = None
                  ) -> DataFrame:
    """Date/timestamp columns: min, max, median, distinct; factor (text) columns: distinct and top-4 counts.

    Boolean columns are summarised by :func:`summary_logical`.
    """
    spark = df.sparkSession
    time_cols = time_cols if time_cols is not None else [
        f.name for f in df.schema.fields if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    factor_cols = factor_cols if factor_cols is not None else []
    rows = []
    if time_cols:
        epoch = df.select(*[F.unix_micros(qcol(c).cast("timestamp")).cast("double").alias(c) for c in time_cols])
        med = {r["column"]: r["q0"] for r in quantiles_long(epoch, time_cols, [0.5]).collect()}
        st = df.agg(*[F.sum(qcol(c).isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(time_cols)],
                    *[F.min(qcol(c)).cast("string").alias(f"_lo{i}") for i, c in enumerate(time_cols)],
                    *[F.max(qcol(c)).cast("string").alias(f"_hi{i}") for i, c in enumerate(time_cols)],
                    *[F.count_distinct(qcol(c)).alias(f"_u{i}") for i, c in enumerate(time_cols)]).first()
        for i, c in enumerate(time_cols):
            rows.append((c, "time", int(st[f"_m{i}"] or 0), int(st[f"_u{i}"]), st[f"_lo{i}"], st[f"_hi{i}"],
                         med.get(c), None))
    if factor_cols:
        tops = top_counts(df, factor_cols).collect()
        st = df.agg(*[F.sum(qcol(c).isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(factor_cols)],
                    *[F.count_distinct(qcol(c)).alias(f"_u{i}") for i, c in enumerate(factor_cols)]).first()
        for i, c in enumerate(factor_cols):
            mine = sorted((r for r in tops if r["column"] == c), key=lambda r: r["rank"])
            text = ", ".join(f"{r['value'][:3]}: {r['count']}" for r in mine)
            rows.append((c, "factor", int(st[f"_m{i}"] or 0), int(st[f"_u{i}"]), None, None, None, text))
    schema = ("column string, kind string, n_missing long, n_unique long, min string, max string, "
              "median_epoch_us double, top_counts string")
    out = spark.createDataFrame(rows, schema)
    return out.select("column", "kind", "n_missing", "n_unique", "min", "max",
                      F.when(F.col("median_epoch_us").isNotNull(),
                             F.date_format(F.timestamp_micros(F.floor("median_epoch_us")), "yyyy-MM-dd HH:mm:ss"))
                      .alias("median"), "top_counts")

