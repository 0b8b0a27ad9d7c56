"""A training corpus from ``documents``: five stages, each one operator of ``tablewright.llm``.

Each stage gets all rows that the one before kept, with the columns of
``documents``; only the last returns others.  An empty table, nulls in any
column, empty texts and repeated rows are handled as the operators' docstrings
say; a stage that keeps one row of a group keeps one of repeated rows, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tablewright.llm.store import rows_named, table, written

#: Target weights of the mix: the sources' rows to this power (1 would be the shares they have anyway).
MIX_ALPHA = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the non-negative positive-unlabelled scorer does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    judged = exact_dedup.dedup_exact(docs)
    return rows_named(docs, judged.filter(F.col("row_key") == F.col("keep_key")).select("row_key"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    judged = ngram_join.join_ngrams(docs)
    return rows_named(docs, judged.filter(F.col("row_key") == F.col("class_key")).select("row_key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order that gives every source its target weight of each stretch, to less than one block.

    The order is that of the written files and of the rows in them.
    """
    mixed = mixing.mix_sources(docs, alpha=MIX_ALPHA)
    return mixed.orderBy("slot", "source", "block", "block_row").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids, with the text they decode to and ``place``, the row's position in the files read (from 0).

    ``docs`` is read from Parquet files, so what the stage before wrote decides
    the places: rows before a file (one count a file) plus the row's number in it.
    """
    files = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # one row a file: the files of one write are numbered
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = files.join(starts, "file").withColumn("place", F.col("start") + F.col("row"))
    coded = bpe.encode_texts(placed.select(F.struct("doc_id", "place").alias("row"), "text"), id_col="row")
    return coded.select("doc_id.doc_id", *coded.columns[1:], "doc_id.place")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources to target weights", mix), ("BPE encoding and decoding", encode)]
#: Training a scorer, exact set joins of all near pairs and token ids can't be expressed in SQL; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
