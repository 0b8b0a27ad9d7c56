"""SQL text builders shared by several SQL twins (histogram, KDE, box statistics)."""

from __future__ import annotations

import math

from ..operators.explore import FINE_GRID
from .common import S

SQRT_2PI = math.sqrt(2.0 * math.pi)


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def histogram_sql(src: str, x: str, bins: int, group: str | None = None) -> str:
    """Equal-width histogram, first bin centred on the minimum, right-closed; all bins reported."""
    g = f"CAST({group} AS VARCHAR)" if group else "CAST(NULL AS VARCHAR)"
    return (
        f"WITH hb AS (SELECT {g} AS grp, CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL), "
        f"hs AS (SELECT min(x) AS lo, max(x) AS hi FROM hb), "
        f"hw AS (SELECT lo, hi, CASE WHEN hi = lo THEN 1 ELSE {bins} END AS nb, "
        f"CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / {bins - 1}.0 END AS w FROM hs), "
        f"hc AS (SELECT grp, CASE WHEN hw.nb = 1 THEN 0 ELSE CAST(least(greatest(ceil((x - lo) / w - 0.5), 0), "
        f"{bins - 1}) AS INTEGER) END AS bin, count(*) AS cnt FROM hb, hw GROUP BY ALL), "
        f"hg AS (SELECT grp, count(*) AS n_group FROM hb GROUP BY grp), "
        f"hgrid AS (SELECT grp, n_group, CAST(b AS INTEGER) AS bin FROM hg, hw, range(0, hw.nb) t(b)) "
        f"SELECT {'hgrid.grp AS \"group\", ' if group else ''}CAST(hgrid.bin AS BIGINT) AS bin, "
        f"{S('lo + hgrid.bin * w')} AS x, {S('lo + hgrid.bin * w - w / 2')} AS xmin, "
        f"{S('lo + hgrid.bin * w + w / 2')} AS xmax, CAST(coalesce(cnt, 0) AS BIGINT) AS count, "
        f"{S('coalesce(cnt, 0) / (n_group * w)')} AS density "
        f"FROM hgrid CROSS JOIN hw LEFT JOIN hc ON hgrid.grp IS NOT DISTINCT FROM hc.grp AND hgrid.bin = hc.bin"
    )


def density_sql(src: str, x: str, group: str | None = None, n_grid: int = 512, prefix: str = "") -> str:
    """Gaussian KDE on an n-point grid from min to max per group with bandwidth nrd0, values spread over a fine grid."""
    fine = FINE_GRID
    g = f"CAST({group} AS VARCHAR)" if group else "CAST(NULL AS VARCHAR)"
    p = prefix
    return (
        f"{p}db AS (SELECT {g} AS grp, CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL), "
        f"{p}ds AS (SELECT grp, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd, "
        f"quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM {p}db GROUP BY grp), "
        f"{p}dp AS (SELECT grp, n, lo, (hi - lo) / {n_grid - 1}.0 AS step, "
        f"0.9 * CASE WHEN least(coalesce(sd, 0), iqr / 1.34) > 0 THEN least(coalesce(sd, 0), iqr / 1.34) "
        f"WHEN coalesce(sd, 0) > 0 THEN sd WHEN lo <> 0 THEN abs(lo) ELSE 1.0 END * pow(n, -0.2) AS bw FROM {p}ds), "
        f"{p}da AS (SELECT d.grp, n, lo, step, bw, step * {n_grid - 1} AS span, CASE WHEN step > 0 THEN (x - lo) / (step * {n_grid - 1}) * {fine - 1} "
        f"ELSE 0.0 END AS pos FROM {p}dp d JOIN {p}db b ON d.grp IS NOT DISTINCT FROM b.grp), "
        f"{p}di AS (SELECT *, least(floor(pos), {fine - 2}) AS bin FROM {p}da), "
        f"{p}df AS (SELECT grp, n, lo, step, span, bw, b, sum(w) AS w FROM ("
        f"SELECT grp, n, lo, step, span, bw, bin AS b, 1.0 - (pos - bin) AS w FROM {p}di UNION ALL "
        f"SELECT grp, n, lo, step, span, bw, bin + 1, pos - bin FROM {p}di) GROUP BY ALL), "
        f"{p}dk AS (SELECT grp, i AS idx, lo + i * step AS gx, bw, n, "
        f"sum(w * exp(-0.5 * ((lo + i * step - (lo + b * (span / {fine - 1}.0))) / bw) * ((lo + i * step - (lo + b * (span / {fine - 1}.0))) / bw))) AS k "
        f"FROM {p}df, range(0, {n_grid}) t(i) GROUP BY grp, i, lo, step, bw, n) "
    )


def density_select(group: bool, prefix: str = "") -> str:
    p = prefix
    return (f"SELECT {'grp AS \"group\", ' if group else ''}CAST(idx AS BIGINT) AS idx, {S('gx')} AS x, "
            f"{S(f'k / (n * bw * {SQRT_2PI!r})')} AS density, {S('bw')} AS bandwidth FROM {p}dk")


def box_sql(src: str, x: str, group: str | None = None) -> str:
    g = f"CAST({group} AS VARCHAR)" if group else "CAST(NULL AS VARCHAR)"
    return (
        f"WITH bb AS (SELECT {g} AS grp, CAST({x} AS DOUBLE) AS v FROM {src} WHERE {x} IS NOT NULL), "
        "bq AS (SELECT grp, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
        "quantile_cont(v, 0.75) AS q3 FROM bb GROUP BY grp) "
        f"SELECT {'bq.grp AS \"group\", ' if group else ''}CAST(bq.n AS BIGINT) AS n, {S('bq.q1', 'q1')}, "
        f"{S('bq.median', 'median')}, {S('bq.q3', 'q3')}, "
        f"{S('min(CASE WHEN v >= bq.q1 - 1.5 * (bq.q3 - bq.q1) THEN v END)', 'whisker_low')}, "
        f"{S('max(CASE WHEN v <= bq.q3 + 1.5 * (bq.q3 - bq.q1) THEN v END)', 'whisker_high')}, "
        "CAST(sum(CASE WHEN v < bq.q1 - 1.5 * (bq.q3 - bq.q1) OR v > bq.q3 + 1.5 * (bq.q3 - bq.q1) THEN 1 ELSE 0 END)"
        " AS BIGINT) AS n_outliers FROM bb JOIN bq ON bb.grp IS NOT DISTINCT FROM bq.grp "
        "GROUP BY bq.grp, bq.n, bq.q1, bq.median, bq.q3")
