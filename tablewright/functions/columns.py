"""Column naming, type classes and missing-value normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)


def qcol(name: str) -> Column:
    """Column reference that survives dots, spaces and ``%`` in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    """Columns that can be imputed with a mode and encoded (text columns)."""
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not numeric counts as categorical."""
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def type_name(dtype: T.DataType) -> str:
    return dtype.simpleString()


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """NULL, and NaN for floating columns (both count as missing)."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in float/double columns so later steps test only NULL.

    A narrow projection: no shuffle, stays in whole-stage codegen.
    """
    exprs = []
    changed = False
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
            changed = True
        else:
            exprs.append(c)
    return df.select(*exprs) if changed else df


def as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast the given columns to double in place (keeps column order)."""
    wanted = set(cols)
    return df.select(*[
        (qcol(f.name).cast("double").alias(f.name) if f.name in wanted else qcol(f.name))
        for f in df.schema.fields
    ])


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}")
