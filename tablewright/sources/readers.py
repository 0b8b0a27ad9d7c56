"""Table sources and sinks: CSV/TSV/JSON/Parquet/ORC scans, CSV sink, sampling, paging."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import normalize_missing, qcol
from .paging import PageIndex, page_table
from .records import read_csv_records, read_json_records

# Text read as a missing cell, and written for one.
NA_TEXT = "NA"

#: timestamps in JSON keep their microseconds
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

__all__ = ["PageIndex", "load", "page_table", "read_csv", "read_json", "read_tsv", "sample_fixed", "write_csv", "write_json", "write_parquet"]
FORMATS = ("csv", "tsv", "json", "parquet", "orc")


def _ext(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    if "." not in base:
        return ""
    return base.rsplit(".", 1)[1].lower()


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", schema: T.StructType | None = None,
             na_text: str = NA_TEXT, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header row; types inferred unless a schema is given.

    A quote inside a quoted field is doubled.  ``multi_line`` allows line
    breaks inside quoted fields: the files are cut into records by many tasks
    first (:mod:`.records`), which reads them three times and writes them
    once, so it is off by default.  ``NA`` and empty fields read as NULL.
    Schema inference costs one extra pass over the files; production jobs
    should pass ``schema``.
    """
    if multi_line:
        options = {"nullValue": na_text, "emptyValue": None, "escape": '"'}
        return normalize_missing(read_csv_records(spark, path, sep=sep, schema=schema, options=options))
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", na_text)
    reader = reader.option("emptyValue", None).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return normalize_missing(reader.csv(path))


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_csv(spark, path, sep="\t", **kw)


def read_json(spark: SparkSession, path: str, *, multi_line: bool | None = None,
              schema: T.StructType | None = None) -> DataFrame:
    """JSON records: either one array of records per file or JSON lines.

    With ``multi_line=None`` the layout is detected from the first characters
    of the first file, nothing more.  Arrays are cut into records by many
    tasks first (:mod:`.records`).
    """
    if multi_line is None:
        # up to the first closing brace: an array on one line isn't read whole
        first = spark.read.option("lineSep", "}").text(path).select(F.left(F.ltrim("value", F.lit(" \t\r\n")), F.lit(1)).alias("c")).first()
        multi_line = bool(first) and first["c"] == "["
    if multi_line:
        return normalize_missing(read_json_records(spark, path, schema=schema, options={}))
    reader = spark.read if schema is None else spark.read.schema(schema)
    return normalize_missing(reader.json(path))


def load(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    """Dispatch on the lower-cased file extension (or ``fmt``); unknown formats raise."""
    kind = (fmt or _ext(path)).lower()
    if kind == "csv":
        return read_csv(spark, path, **kw)
    if kind == "tsv":
        return read_tsv(spark, path, **kw)
    if kind == "json":
        return read_json(spark, path, **kw)
    if kind == "parquet":
        return normalize_missing(spark.read.parquet(path))
    if kind == "orc":
        return normalize_missing(spark.read.orc(path))
    raise ValueError(f"Unsupported file format: .{kind}")


def write_csv(df: DataFrame, path: str, *, sep: str = ",", na_text: str = NA_TEXT, mode: str = "overwrite") -> str:
    """CSV with a header, no row names, missing cells written as ``NA``; quotes in a field are doubled."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", na_text)
     .option("emptyValue", "").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    (df.write.mode(mode).option("ignoreNullFields", False).options(**JSON_TIMES).json(path))
    return path


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def sample_fixed(df: DataFrame, n: int, key: list[str] | None = None, *, seed: int = 42,
                 order: Column | None = None) -> DataFrame:
    """Fixed-size sample without replacement, reproducible.

    Rows are ranked by a hash of their key (or ``order``) and the first ``n``
    kept.  ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task
    keeps its own top ``n``, so there is no full sort or shuffle of the table.
    """
    if order is None:
        cols = key or df.columns
        order = F.xxhash64(F.lit(seed), *[qcol(c) for c in cols])
    return df.orderBy(order, *[qcol(c) for c in (key or [])]).limit(n)
