"""Correlation matrices (upper triangle, diagonal included): Pearson, Spearman, Kendall tau-b.

All pairwise-complete: each pair uses the rows where both columns are present.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, qcol
from .clean import null_counts
from .discord import discordances
from .rank import average_rank, join_back, ranked_counts, table_size, written

#: aggregates per pass; keeps generated code under the JVM method size limit on wide tables
PAIRS_PER_PASS = 60


def _pairs(cols: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def _pearson_rows(df: DataFrame, cols: list[str], names: list[str]) -> list[tuple]:
    """Pairwise-complete Pearson from covariance and variances over the rows where both are present."""
    out = []
    pairs = _pairs(cols)
    for start in range(0, max(len(pairs), 1), PAIRS_PER_PASS):
        chunk = pairs[start:start + PAIRS_PER_PASS]
        aggs = []
        for k, (i, j) in enumerate(chunk):
            xi, xj = qcol(cols[i]).cast("double"), qcol(cols[j]).cast("double")
            both = xi.isNotNull() & xj.isNotNull()
            aggs += [F.covar_samp(F.when(both, xi), F.when(both, xj)).alias(f"c{k}"),
                     F.var_samp(F.when(both, xi)).alias(f"vx{k}"), F.var_samp(F.when(both, xj)).alias(f"vy{k}"),
                     F.count(F.when(both, F.lit(1))).alias(f"n{k}")]
        if not aggs:
            break
        row = df.agg(*aggs).first()
        for k, (i, j) in enumerate(chunk):
            c, vx, vy = row[f"c{k}"], row[f"vx{k}"], row[f"vy{k}"]
            r = c / math.sqrt(vx * vy) if c is not None and vx and vy else None
            if r is not None:
                r = max(-1.0, min(1.0, r))
            out.append((names[i], names[j], r, int(row[f"n{k}"])))
    vrow = df.agg(*[F.var_samp(qcol(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)],
                  *[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    for i in range(len(cols)):
        out.append((names[i], names[i], 1.0 if vrow[f"v{i}"] else None, int(vrow[f"n{i}"])))
    return out


def _frame(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, corr double, n long")


def corr_pearson(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix as ``(var1, var2, corr, n)`` rows for ``var1 <= var2`` in column order.

    Built from ``covar_samp``/``var_samp`` so a constant column gives NULL
    instead of a division error.
    """
    cols = cols or numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("need at least two numeric columns")
    return _frame(df, _pearson_rows(df, cols, cols))


#: aggregates in one pass over the ranked rows (four for each pair)
SPEARMAN_BATCH = 240


def corr_spearman(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Spearman matrix: average ranks on each pair's complete rows, then Pearson.

    Ranks come from one distributed ranking (no global sort); each column's
    rank table joins back on the value and also holds the ranks among the
    rows where a partner with missing cells is present.  More pairs than one
    pass of aggregates takes are counted from the written ranks.
    """
    cols = cols or numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("need at least two numeric columns")
    nulls = null_counts(df, cols)
    gaps = [j for j in range(len(cols)) if nulls[cols[j]] > 0]
    base = df.select(*[qcol(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    # one scan and one ranking: each distinct value of a column counts its rows, and those in which a
    # partner with gaps is present; both counts cumulate to ranks
    present = [F.col(f"_c{j}").isNotNull().cast("long").alias(f"p{j}") for j in gaps]
    cells = F.array(*[F.struct(F.lit(i).alias("_key"), F.col(f"_c{i}").alias("_v")) for i in range(len(cols))])
    long = base.select(F.inline(cells), *[F.col(f"_c{j}") for j in gaps]).select("_key", "_v", *present)
    rc = ranked_counts(long, "_v", by=["_key"], cumulate=[f"p{j}" for j in gaps])
    size = table_size(rc)
    joined = base
    for i in range(len(cols)):
        own = rc.where((F.col("_key") == F.lit(i)))
        ranks = [average_rank(own).alias(f"_r{i}")]
        ranks += [(F.col(f"before_p{j}") + (F.col(f"p{j}") + F.lit(1)) / F.lit(2.0)).alias(f"_r{i}_{j}") for j in gaps if j != i]
        rt = own.select(F.col("value").alias(f"_v{i}"), *ranks)
        joined = join_back(joined, rt, F.col(f"_c{i}") == F.col(f"_v{i}"), size, "left").drop(f"_v{i}")
    rows = []
    aggs = []
    pairs = _pairs(cols)
    for k, (i, j) in enumerate(pairs):
        a = F.col(f"_r{i}_{j}") if j in gaps else F.col(f"_r{i}")
        b = F.col(f"_r{j}_{i}") if i in gaps else F.col(f"_r{j}")
        both = F.col(f"_c{i}").isNotNull() & F.col(f"_c{j}").isNotNull()
        aggs += [F.covar_samp(F.when(both, a), F.when(both, b)).alias(f"c{k}"),
                 F.var_samp(F.when(both, a)).alias(f"vx{k}"), F.var_samp(F.when(both, b)).alias(f"vy{k}"),
                 F.count(F.when(both, F.lit(1))).alias(f"n{k}")]
    for i in range(len(cols)):
        aggs += [F.var_samp(F.col(f"_c{i}")).alias(f"v{i}"), F.count(F.col(f"_c{i}")).alias(f"m{i}")]
    if len(aggs) > SPEARMAN_BATCH:
        joined = written(joined, "spearman")
    row = {}
    for at in range(0, len(aggs), SPEARMAN_BATCH):
        row |= joined.agg(*aggs[at:at + SPEARMAN_BATCH]).first().asDict()
    for k, (i, j) in enumerate(pairs):
        c, vx, vy = row[f"c{k}"], row[f"vx{k}"], row[f"vy{k}"]
        r = c / math.sqrt(vx * vy) if c is not None and vx and vy else None
        rows.append((cols[i], cols[j], None if r is None else max(-1.0, min(1.0, r)), int(row[f"n{k}"])))
    for i in range(len(cols)):
        rows.append((cols[i], cols[i], 1.0 if row[f"v{i}"] else None, int(row[f"m{i}"])))
    return _frame(df, rows)


# -------------------------------------------------------------------- Kendall
def kendall_pairs(df: DataFrame, cols: list[str]) -> dict[tuple[int, int], tuple[float | None, int]]:
    """Exact tau-b and number of complete rows of all column pairs, in jobs shared by the pairs.

    Values are replaced by their column's row ranks (one distributed ranking;
    a rank over all rows keeps the order on any pair's complete rows), and
    equal ``(pair, x, y)`` rows collapse to counts.  Discordant pairs of rows
    are counted on a grid of rank ranges (:mod:`.discord`).  All pair sums are
    decimals: they outgrow 64 bits from about 3e9 rows.
    """
    base = df.select(*[qcol(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(i).alias("_key"), F.col(f"_c{i}").alias("_v")) for i in range(len(cols))])
    rc = ranked_counts(base.select(F.inline(cells)), "_v", by=["_key"])
    size = table_size(rc)
    ranked = base
    for i in range(len(cols)):
        rt = rc.where(F.col("_key") == F.lit(i)).select(F.col("value").alias(f"_v{i}"), F.col("before").alias(f"_r{i}"))
        ranked = join_back(ranked, rt, F.col(f"_c{i}") == F.col(f"_v{i}"), size, "left").drop(f"_v{i}")
    pairs = _pairs(cols)
    each = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"_r{i}").alias("rx"), F.col(f"_r{j}").alias("ry"))
                     for k, (i, j) in enumerate(pairs)])
    d = written(ranked.select(F.inline(each)).where(F.col("rx").isNotNull() & F.col("ry").isNotNull())
                .groupBy("pair", "rx", "ry").agg(F.count(F.lit(1)).alias("cnt")), "kendall")
    return kendall_from_counts(d, pairs)


def _pairs_within(t: str) -> Column:
    """Sum of t * (t - 1) / 2, exactly."""
    c = F.col(t).cast("decimal(19,0)")
    return F.sum((c * (c - F.lit(1).cast("decimal(19,0)"))).cast("decimal(38,0)"))


def kendall_from_counts(d: DataFrame, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[float | None, int]]:
    """Tau-b per pair from ``(pair, rx, ry, cnt)``: row ranks and how many rows hold them."""
    ties = {}
    for name, keys in (("x", ["rx"]), ("y", ["ry"]), ("xy", ["rx", "ry"])):
        for r in (d.groupBy("pair", *keys).agg(F.sum("cnt").alias("t"))
                  .groupBy("pair").agg(_pairs_within("t").alias("twice"), F.sum("t").alias("n")).collect()):
            ties[r["pair"], name] = r
    if not ties:
        return {p: (None, 0) for p in pairs}
    found = discordances(d)
    out: dict[tuple[int, int], tuple[float | None, int]] = {}
    for k, p in enumerate(pairs):
        n = int(ties[k, "x"]["n"]) if (k, "x") in ties else 0
        if n < 2:
            out[p] = (None, n)
            continue
        # exact integers: twice the number of all pairs, of ties in x, y and both, and of concordant minus discordant ones
        n0, n1, n2, n3 = n * (n - 1), *(int(ties[k, name]["twice"]) for name in ("x", "y", "xy"))
        score = n0 - n1 - n2 + n3 - 4 * found.get(k, 0)
        den = math.sqrt(n0 - n1) * math.sqrt(n0 - n2)
        out[p] = (score / den if den > 0 else None, n)
    return out


def corr_kendall(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Kendall tau-b matrix (pairwise complete)."""
    cols = cols or numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("need at least two numeric columns")
    rows = [(cols[i], cols[j], tau, n) for (i, j), (tau, n) in kendall_pairs(df, cols).items()]
    counts = df.agg(*[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                    *[(F.max(qcol(c).cast("double")) > F.min(qcol(c).cast("double"))).alias(f"u{i}") for i, c in enumerate(cols)]).first()
    for i, c in enumerate(cols):
        rows.append((c, c, 1.0 if counts[f"u{i}"] else None, int(counts[f"n{i}"])))
    return _frame(df, rows)
