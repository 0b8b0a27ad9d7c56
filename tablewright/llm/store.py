"""Inputs and written intermediate tables shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    Cuts the lineage: several consumers then read one narrow columnar table
    instead of recomputing the scan, and a lost executor only costs a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit name for a row by its id and text, nulls included; equal rows share it."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def rows_named(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose :func:`row_key` is in ``keys`` (one column), one of each set of repeated rows."""
    named = docs.withColumn("__row_key", row_key(id_col, text_col))
    met = named.join(keys.toDF("__row_key").distinct(), "__row_key", "left_semi")
    alike = Window.partitionBy("__row_key", f"`{id_col}`").orderBy("__row_key")
    return met.withColumn("__nth", F.row_number().over(alike)).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
