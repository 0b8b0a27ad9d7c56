"""Engine-independent rounding.

Spark's ``round`` rounds the exact binary value of a double (0.15 -> 0.1) while
other engines scale first (0.15 -> 0.2).  These helpers round half-up after
scaling, written so that any engine evaluating the same IEEE operations gets
the same digits.  ``*_sql`` return the equivalent SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dp(c: Column, digits: int) -> Column:
    """Round half-up to ``digits`` decimals; NULL and NaN give NULL.

    Magnitudes from ``2**52 / scale`` up hold no digit to round and pass
    through unchanged (so do infinities).
    """
    scale = float(10 ** digits)
    x = c.cast("double")
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
            .when(F.abs(x) >= F.lit(2.0 ** 52 / scale), x)
            .otherwise(F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)))


def round_dp_sql(expr: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}"
    return (f"(CASE WHEN ({expr}) IS NULL OR isnan(CAST(({expr}) AS DOUBLE)) THEN NULL "
            f"WHEN abs({expr}) >= {2.0 ** 52 / 10 ** digits!r} THEN CAST(({expr}) AS DOUBLE) "
            f"ELSE CAST(floor(({expr}) * {scale} + 0.5) AS DOUBLE) / {scale} END)")


def sig_round(c: Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (half-up); 0, NULL pass through.

    Non-finite values pass through unchanged; magnitudes below 1e-12 (the
    size of floating cancellation noise) become 0.
    """
    x = c.cast("double")
    e = F.floor(F.log10(F.abs(x)))
    k = F.lit(digits - 1) - e  # decimal places to keep
    pos = F.floor(x * F.pow(F.lit(10.0), k) + F.lit(0.5)).cast("double") / F.pow(F.lit(10.0), k)
    neg = F.floor(x / F.pow(F.lit(10.0), -k) + F.lit(0.5)).cast("double") * F.pow(F.lit(10.0), -k)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(~finite | (x == 0), x)
            .when(F.abs(x) < F.lit(1e-12), F.lit(0.0))
            .when(k >= 0, pos)
            .otherwise(neg))


def sig_round_sql(expr: str, digits: int = 9) -> str:
    x = f"CAST(({expr}) AS DOUBLE)"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL "
        f"WHEN isnan({x}) OR isinf({x}) OR {x} = 0 THEN {x} "
        f"WHEN abs({x}) < 1e-12 THEN 0.0 "
        f"WHEN {k} >= 0 THEN CAST(floor({x} * pow(10.0, {k}) + 0.5) AS DOUBLE) / pow(10.0, {k}) "
        f"ELSE CAST(floor({x} / pow(10.0, -{k}) + 0.5) AS DOUBLE) * pow(10.0, -{k}) END)"
    )
