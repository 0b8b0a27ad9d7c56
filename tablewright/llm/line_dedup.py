r"""Line dedup by a log-template tree (DataFrame functions only).

Words holding a digit become ``<*>``.  A fixed-depth tree files each line under
its word count and its first ``depth`` words.  Within such a leaf, a word that
stands at its position in at least ``min_docs`` documents (counted over the
leaf's distinct lines) is constant there; other words generalise to ``<*>``.
A line's *template* is what remains.  It is valid if at most
``1 - similarity`` of its words were generalised (digit words aside) and some
constant word is left, or if one word was, beside ``SHORT_KEPT`` or more constant ones (a field in a line of four words).  Lines whose template occurs in ``min_docs`` or more
documents are dropped, all of them, as recurring boilerplate.

Scale: leaves are counted on 64-bit hashes; only lines in leaves that occur
often enough are looked into.  Line texts move once to meet those leaves (a
join that can be split when a line is frequent; equal lines are then counted
with a partial aggregation), and texts once to meet their dropped line numbers;
otherwise only hashes move.

Words are ``[^\x20\x09-\x0D]+``; lines with fewer than ``min_words`` words are
never dropped.  A document is a distinct (id, text) pair.

Defined cases: a null text stays null and has no lines; an empty text has one
line without words; a text whose lines are all dropped becomes empty; rows
with a null id take part by their text; repeated rows count as one document
and are cleaned alike; an empty table gives an empty result; input columns
named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, written

SPACE = r"\x20\x09-\x0D"
MIN_DOCS = 3
DEPTH = 3
MIN_WORDS = 3
SIMILARITY = 0.8
#: Constant words beside which one word may always generalise, so that lines of four words can form a template.
SHORT_KEPT = 3
OUTPUTS = ["n_lines", "n_dropped", "clean_text"]


def masked_lines(text: Column) -> Column:
    """The text's lines with words separated by one space and words holding a digit replaced by ``<*>``."""
    odd = r"\x20*[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20{2,}"
    # most texts hold no odd space and most lines no digit: a plain search is cheaper than a replacement
    some = F.lit(False)
    for mark in ("  ", "\t", "\x0b", "\f", "\r"):
        some = some | F.contains(text, F.lit(mark))
    one_space = F.when(some, F.regexp_replace(text, F.lit(odd), F.lit(" "))).otherwise(text)
    digits = rf"(^|[{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
    return F.transform(F.split(one_space, "\n"), lambda line: F.trim(
        F.when(line.rlike("[0-9]"), F.regexp_replace(line, F.lit(digits), F.lit("$1<*>"))).otherwise(line)))


def _leaf(line: str, depth: int) -> str:
    return f"xxhash64(size(split({line}, ' ')), slice(split({line}, ' '), 1, {depth}))"


def recurring_lines(texts: DataFrame, known: DataFrame, min_docs: int, depth: int, min_words: int, similarity: float) -> DataFrame:
    """``line_hash`` of every masked line whose template recurs.

    ``texts`` has the masked ``lines`` of every row, ``known`` its
    ``doc_id, text_hash`` and the lines' ``hashes`` and ``leaves``.
    """
    # leaves are counted on hashes alone; the text of lines moves once, and stays only where its leaf occurs often enough
    leaves = (known.select(F.explode(F.array_distinct(F.arrays_zip("hashes", "leaves"))).alias("x"))
              .groupBy(F.col("x.leaves").alias("leaf")).agg(F.count("*").alias("in_leaf"))
              .filter(F.col("in_leaf") >= min_docs).select("leaf"))
    lines = (texts.select(F.explode(F.array_distinct("lines")).alias("line"))
             .filter(f"size(split(line, ' ')) >= {min_words}").withColumn("leaf", F.expr(_leaf("line", depth))))
    filed = written(lines.join(leaves.hint("shuffle_hash"), "leaf", "left_semi")
                    .groupBy("leaf", "line").agg(F.count("*").alias("docs"))
                    .select(F.xxhash64("line").alias("line_hash"), "leaf", "docs", F.split("line", " ").alias("words")), "filed")
    at = filed.select("line_hash", "leaf", "docs", F.size("words").alias("n"), F.posexplode("words").alias("position", "word"))
    constant = (at.filter((F.col("position") >= depth) & (F.col("word") != "<*>"))
                .groupBy("leaf", "position", "word").agg(F.sum("docs").alias("support")).filter(F.col("support") >= min_docs)
                .select("leaf", "position", "word", F.lit(True).alias("constant")))
    # lines in enough documents keep every word: each of their words is constant at its place
    whole = filed.filter(F.col("docs") >= min_docs).select(
        "line_hash", F.xxhash64("leaf", "words").alias("template"), F.lit(0).alias("wild"),
        F.size(F.filter("words", lambda w: w != "<*>")).alias("kept"), F.size("words").alias("n"))
    parts = (at.filter(F.col("docs") < min_docs).join(constant, ["leaf", "position", "word"], "left")
             .withColumn("masked", F.col("word") == "<*>")
             .withColumn("stays", (F.col("position") < depth) | F.coalesce("constant", F.lit(False))))
    parts = (parts.groupBy("line_hash", "leaf", "n")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.when(F.col("stays"), F.col("word")).otherwise(F.lit("<*>")).alias("w")))),
                              lambda x: x.w).alias("words"),
                  F.count_if(~F.col("stays") & ~F.col("masked")).alias("wild"),
                  F.count_if(F.col("stays") & ~F.col("masked")).alias("kept"))
             .select("line_hash", F.xxhash64("leaf", "words").alias("template"), F.col("wild").cast("int"), F.col("kept").cast("int"), "n"))
    templates = (whole.unionByName(parts).filter((F.col("kept") > 0) & ((F.col("wild") <= F.lit(1 - similarity + 1e-9) * F.col("n")) | ((F.col("wild") == 1) & (F.col("kept") >= SHORT_KEPT))))
                 .select("line_hash", "template"))
    templates = written(templates, "templates")
    # documents per template, each counted once
    seen = (known.select("doc_id", "text_hash", F.explode(F.array_distinct("hashes")).alias("line_hash"))
            .join(templates, "line_hash").select("template", "doc_id", "text_hash").distinct()
            .groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("template"))
    return templates.join(seen, "template", "left_semi").select("line_hash").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                depth: int = DEPTH, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_lines``, ``n_dropped`` and ``clean_text``."""
    columns = [c for c in docs.columns if c not in OUTPUTS]
    text = F.col(f"`{text_col}`")
    # filtered on the text itself: a filter on its lines would cut every text twice
    named = docs.filter(text.isNotNull()).select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), masked_lines(text).alias("lines"))
    hashes = F.transform("lines", lambda line: F.xxhash64(line))
    leaves = F.expr("transform(lines, line -> " + _leaf("line", depth) + ")")
    known = written(named.select("doc_id", "text_hash", hashes.alias("hashes"), leaves.alias("leaves")), "line-hashes")
    dropped = recurring_lines(named.select("doc_id", "text_hash", "lines"), known, min_docs, depth, min_words, similarity)
    places = (known.drop("leaves").distinct().select("doc_id", "text_hash", F.posexplode("hashes").alias("at", "line_hash"))
              .join(dropped, "line_hash", "left_semi")
              .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("at").alias("__at")))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.xxhash64(text).alias("__text_hash"))
    met = rows.join(places, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    met = met.withColumn("__lines", F.split(text, "\n"))
    kept = F.when(F.col("__at").isNull(), F.col("__lines")).otherwise(
        F.filter("__lines", lambda line, i: ~F.array_contains("__at", i)))
    return met.select(*[F.col(f"`{c}`") for c in columns],
                      F.when(text.isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
                      F.when(F.col("__at").isNull(), 0).otherwise(F.size("__at")).cast("long").alias("n_dropped"),
                      F.when(text.isNotNull(), F.concat_ws("\n", kept)).alias("clean_text"))


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    return dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))


_WORDS = rf"list_transform(list_filter(string_split_regex(line, '[{SPACE}]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
w AS (SELECT doc_id, text, pos, line, {_WORDS} AS words FROM l),
u AS (SELECT words, count(*) AS docs FROM (SELECT DISTINCT doc_id, text, words FROM w WHERE len(words) >= {MIN_WORDS}) GROUP BY words),
f AS (SELECT *, len(words) AS n, words[1:{DEPTH}] AS lead_words, sum(docs) OVER (PARTITION BY len(words), words[1:{DEPTH}]) AS in_leaf FROM u),
p AS (SELECT words, n, lead_words, docs, unnest(words) AS word, unnest(range(n)) AS pos FROM f WHERE in_leaf >= {MIN_DOCS}),
c AS (SELECT *, word = '<*>' AS masked, pos < {DEPTH} OR (word <> '<*>' AND sum(docs) OVER (PARTITION BY n, lead_words, pos, word) >= {MIN_DOCS}) AS stays FROM p),
t AS (SELECT words, n, list(CASE WHEN stays THEN word ELSE '<*>' END ORDER BY pos) AS template,
             count(*) FILTER (WHERE NOT stays AND NOT masked) AS wild, count(*) FILTER (WHERE stays AND NOT masked) AS kept
      FROM c GROUP BY words, n),
v AS (SELECT words, template FROM t WHERE kept > 0 AND (wild <= {1 - SIMILARITY + 1e-9} * n OR (wild = 1 AND kept >= {SHORT_KEPT}))),
r AS (SELECT template FROM (SELECT DISTINCT doc_id, text, template FROM w JOIN v USING (words)) GROUP BY template HAVING count(*) >= {MIN_DOCS}),
x AS (SELECT words FROM v JOIN r USING (template)),
k AS (SELECT w.doc_id, w.text, count(*) AS n_lines, count(x.words) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE x.words IS NULL), '') AS clean_text
      FROM w LEFT JOIN x ON x.words = w.words GROUP BY w.doc_id, w.text)
SELECT doc_id, text, n_lines, n_dropped, clean_text FROM k
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE = {"op1_line_dedup": OP1_SQL}
