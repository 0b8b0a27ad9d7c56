"""Registered queries: periodograms of hourly event counts."""

from __future__ import annotations

from ..operators import spectrum as T
from .common import S, finish, table

QUERIES = {
    "periodogram": lambda s, sf: finish(T.periodogram(T.bucket_series(table(s, sf, "events"), "ts")), 6),
    "periodogram_smoothed": lambda s, sf: finish(
        T.periodogram(T.bucket_series(table(s, sf, "events"), "ts"), spans=T.DEFAULT_SPANS), 6),
    "periodogram_grouped": lambda s, sf: finish(
        T.periodogram(T.bucket_series(table(s, sf, "events"), "ts", by="event_type")), 6),
}


def _spectrum_sql(smooth: bool, group: str | None = None) -> str:
    g = f"CAST({group} AS VARCHAR)" if group else "'all'"
    w = [float(v) for v in T.daniell_weights(T.DEFAULT_SPANS)] if smooth else [1.0]
    half = len(w) // 2
    taps = " UNION ALL ".join(f"SELECT {j - half} AS off, {wj!r} AS w" for j, wj in enumerate(w))
    smooth_n = ("(SELECT min(m) FROM (SELECT pow(2, a) * pow(3, b) * pow(5, c) AS m FROM range(0, 40) ra(a), "
                "range(0, 26) rb(b), range(0, 18) rc(c)) WHERE m >= n0)")
    return (
        f"WITH h AS (SELECT {g} AS series, time_bucket(INTERVAL 1 HOUR, ts) AS t, count(*) AS c FROM events GROUP BY ALL), "
        "sp AS (SELECT series, min(t) AS t0, max(t) AS t1 FROM h GROUP BY series), "
        "grid AS (SELECT series, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS t FROM sp), "
        "s AS (SELECT g.series, row_number() OVER (PARTITION BY g.series ORDER BY g.t) AS i, "
        "CAST(coalesce(h.c, 0) AS DOUBLE) AS v FROM grid g LEFT JOIN h ON g.series = h.series AND g.t = h.t), "
        "n AS (SELECT series, count(*) AS n0, avg(v) AS mv FROM s GROUP BY series), "
        "tt AS (SELECT s.series, i, v, n0, mv, i - (n0 + 1) / 2.0 AS tc FROM s JOIN n USING (series)), "
        "sl AS (SELECT series, sum(v * tc) AS sxt FROM tt GROUP BY series), "
        "d AS (SELECT tt.series, i, n0, v - mv - sxt * tc / (n0 * (n0 * n0 - 1) / 12.0) AS x, "
        "CAST(floor(n0 * 0.1) AS BIGINT) AS m FROM tt JOIN sl USING (series)), "
        "tp AS (SELECT series, i, n0, x * CASE WHEN m > 0 AND i <= m THEN 0.5 * (1 - cos(pi() * (2 * i - 1) / (2 * m))) "
        "WHEN m > 0 AND i > n0 - m THEN 0.5 * (1 - cos(pi() * (2 * (n0 - i + 1) - 1) / (2 * m))) ELSE 1.0 END AS x FROM d), "
        f"nn AS (SELECT series, n0, {smooth_n} AS nt FROM n), "
        "ks AS (SELECT series, n0, nt, k FROM nn, range(0, CAST(nt AS BIGINT)) r(k) WHERE k <= nt / 2), "
        "dft AS (SELECT ks.series, k, ks.n0, ks.nt, (pow(sum(x * cos(2 * pi() * k * (i - 1) / ks.nt)), 2) + "
        "pow(sum(x * sin(2 * pi() * k * (i - 1) / ks.nt)), 2)) / ks.n0 AS p FROM ks JOIN tp USING (series) "
        "GROUP BY ks.series, k, ks.n0, ks.nt), "
        "full_ AS (SELECT series, k, nt, p FROM dft WHERE k > 0 UNION ALL "
        "SELECT series, nt - k, nt, p FROM dft WHERE k > 0 AND nt - k > nt / 2), "
        "p0 AS (SELECT series, 0 AS k, nt, p FROM full_ WHERE k = 1), "
        "allp AS (SELECT * FROM full_ UNION ALL SELECT * FROM p0), "
        f"taps AS ({taps}), "
        "sm AS (SELECT a.series, a.k, a.nt, sum(t.w * b.p) AS p FROM allp a, taps t, allp b "
        "WHERE b.series = a.series AND b.k = ((a.k + t.off) % a.nt + a.nt) % a.nt GROUP BY a.series, a.k, a.nt) "
        f"SELECT series, CAST(k AS BIGINT) AS freq_index, {S('k / nt', digits=6)} AS frequency, "
        f"{S(f'p / {1 - (5.0 / 8.0) * T.TAPER * 2!r}', digits=6)} AS power FROM sm WHERE k >= 1 AND k <= nt / 2"
    )


ORACLE = {
    "periodogram": _spectrum_sql(False),
    "periodogram_smoothed": _spectrum_sql(True),
    "periodogram_grouped": _spectrum_sql(False, "event_type"),
}
