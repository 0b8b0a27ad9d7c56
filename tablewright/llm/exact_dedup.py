"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

1. A text is normalised (six white space characters deleted) and cut into
   chunks where its own content says so: after a sentence mark, at least
   ``MIN_CHUNK`` and at most ``MAX_CHUNK`` code points long.
2. A chunk's identifier is a 64-bit hash.  Identifiers are *verified*: the
   distinct ``(identifier, SHA-256)`` pairs of the corpus are counted, and an
   identifier that stands for two contents is marked.
3. A document becomes its recipe, the ordered list of identifiers; equal
   recipes are equal texts.  Recipes holding a marked identifier are told
   apart by the whole text's digest as well.

Each text is read once; after that only recipes move (8 bytes per chunk).
Copies are pre-aggregated to one row per recipe and original length before
the grouping shuffle, so a group of any size costs one row per task, and the
rows meet their group's result in a join that can be split when skewed.

Defined cases: a null text counts as empty; all empty texts are equal; rows
with a null ``doc_id`` take part and lose ties against any id (``keep_id`` is
null only when every longest copy has a null id); repeated rows with the
staying id are all ``kept``; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import row_key, table, written

WHITE = r"[\x20\x09-\x0D]+"
MIN_CHUNK = 256
MAX_CHUNK = 2048


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    return f"(?s).{{{least},{most - 1}}}?[.!?;]|.{{1,{most}}}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """Per row: id, row key, original code points, digest of the normalised text, chunk identifiers and chunk digests."""
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    cut = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.length(raw).cast("long").alias("n_points"),
        F.regexp_replace(raw, F.lit(WHITE), F.lit("")).alias("norm"),
        row_key(id_col, text_col).alias("row_key"),
    ).select("doc_id", "row_key", "n_points", F.sha2("norm", 256).alias("text_sha256"),
             F.expr(f"regexp_extract_all(norm, '{chunk_pattern(least, most)}', 0)").alias("chunks"))
    return cut.select(
        "doc_id", "row_key", "n_points", "text_sha256",
        F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("proofs"))


def unverified(made: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk content (normally none)."""
    pairs = made.select(F.explode(F.arrays_zip("recipe", "proofs")).alias("c")).select("c.recipe", "c.proofs")
    return (pairs.distinct().groupBy(F.col("recipe").alias("chunk_id")).agg(F.count("*").alias("contents"))
            .filter("contents > 1").select("chunk_id"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row_key, keep_key``.

    ``keep_key`` names the one row of the group that stays by its
    :func:`~tablewright.llm.store.row_key`, also where an id is used twice.
    """
    made = written(recipes(docs, id_col, text_col, least, most), "recipes")
    # a recipe is named by its hash here; a false match would only add the digest to its group's key
    marked = (made.select("recipe").distinct()
              .select(F.xxhash64("recipe").alias("recipe_key"), F.explode(F.array_distinct("recipe")).alias("chunk_id"))
              .join(unverified(made), "chunk_id", "left_semi").select("recipe_key").distinct()
              .withColumn("marked", F.lit(True)))
    by_length = (made.groupBy("recipe", "text_sha256", "n_points")
                 .agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key")).alias("first"), F.count("*").alias("n")))
    groups = (by_length.withColumn("recipe_key", F.xxhash64("recipe")).join(marked, "recipe_key", "left")
              .groupBy("recipe", F.when(F.col("marked"), F.col("text_sha256")).alias("tie"))
              .agg(F.min("text_sha256").alias("text_sha256"), F.max_by("first", "n_points").alias("stays"),
                   F.sum("n").alias("group_size"))
              .select("recipe", "text_sha256", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row_key").alias("keep_key"), "group_size"))
    return (made.select("doc_id", "row_key", "recipe", "text_sha256").join(groups, ["recipe", "text_sha256"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256", "row_key", "keep_key"))


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The ``documents`` table's copies: which row of each group of equal texts stays."""
    return dedup_exact(table(spark, sf, "documents").select("doc_id", "text")).drop("row_key", "keep_key")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE = {"op10_exact_dedup": OP10_SQL}
