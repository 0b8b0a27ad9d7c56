r"""Line-first quality rules (DataFrame functions only).

Each line is judged on its own (punctuation, navigation, boilerplate); failing
lines are removed, and a document that loses too much of its text is rejected.
On top stand document-level base figures; a document failing them is rejected
whatever its lines say.

A word is ``[^\x20\x09-\x0D]+``.  Line rules, for a line with at least one word:

* punctuation: fails when more than ``max_symbol_share`` of its code points
  are ``#*$%&|<>{}[]\^~=_!`` (code points that are not white space count);
* navigation: fails when it has 3 or more entries between the separators
  ``|``, ``»``, ``›``, ``•`` or ``·``, or consists of one menu word or phrase;
* boilerplate: fails when it holds a stock phrase (cookies, JavaScript,
  subscriptions, ...).

Repeated 5-word windows are found per row on sorted 64-bit window hashes, so a
text of n words costs n log n and nothing is shuffled.

Defined cases: a null or empty text has no words, so ``base_failed`` is true
and ``kept`` false; lines without a word are neither judged nor counted; a
text whose lines all pass loses nothing; very long texts are read whole;
repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = r"[#*$%&|<>{}\[\]\\^~=_!]"
#: Menu words and stock phrases, lower case.
MENU = ["home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "contact", "contact us",
        "about", "about us", "sitemap", "next", "previous", "back to top", "read more", "share", "print", "skip to content"]
STOCK = ["cookie policy", "accept cookies", "we use cookies", "uses cookies", "enable javascript", "javascript is disabled",
         "terms of service", "terms of use", "privacy policy", "subscribe to our newsletter", "click here to",
         "page not found", "lorem ipsum", "all rights reserved", "follow us on"]


def menu_pattern() -> str:
    return "^(" + "|".join(MENU) + ")[.!:]?$"


def stock_pattern() -> str:
    return "(" + "|".join(STOCK) + ")"


def line_passes(line: Column, max_symbol_share: float = 0.2) -> Column:
    """Whether one line passes the three rules."""
    solid = F.length(F.regexp_replace(line, F.lit(SPACE), F.lit("")))
    symbols = solid - F.length(F.regexp_replace(line, F.lit(rf"({LINE_SYMBOLS}|[\x20\x09-\x0D])+"), F.lit("")))
    low = F.lower(line)
    entries = F.size(F.split(line, r"[|»›•·]"))
    return ((symbols <= F.lit(max_symbol_share) * solid) & (entries < 4)
            & ~F.trim(low).rlike(menu_pattern()) & ~low.rlike(stock_pattern()))


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the base figures and ``lines`` (the text's lines that hold a word)."""
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    step = docs.select(F.col(f"`{id_col}`").alias("doc_id"), raw.alias("text"))
    step = step.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    step = step.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    step = step.withColumn("windows", F.expr(
        f"transform(slice(hashes, 1, greatest(size(hashes) - {WINDOW - 1}, 0)), "
        f"(h, i) -> xxhash64(h, {', '.join(f'get(hashes, i + {k})' for k in range(1, WINDOW))}))"))
    # positions of windows found twice or more: neighbours in the order of (hash, position); only texts with a repeat pay for the sort
    step = step.withColumn("sorted", F.expr(
        "CASE WHEN size(array_distinct(windows)) = size(windows) THEN NULL "
        "ELSE array_sort(transform(windows, (h, i) -> struct(h, i))) END"))
    step = step.withColumn("starts", F.expr(
        "array_sort(transform(filter(sorted, (s, i) -> s.h = get(sorted, i - 1).h OR s.h = get(sorted, i + 1).h), s -> s.i))"))
    step = step.withColumn("n_repeat_words", F.expr(
        f"coalesce(aggregate(transform(starts, (p, i) -> least({WINDOW}, coalesce(get(starts, i + 1) - p, {WINDOW}))), "
        "0L, (a, x) -> a + x), 0L)"))
    lines = F.expr(r"filter(split(text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')")
    return step.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", F.lit(SPACE), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        "n_repeat_words", lines.alias("lines"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_symbol_share: float = 0.2,
                  max_lost_share: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Per row: id, base figures, ``n_lines``, ``n_lines_removed``, ``lost_chars``, ``clean_text`` and the verdicts.

    ``clean_text`` is the passing lines joined by one newline.  ``kept`` is
    false when the base fails or when removed lines hold more than
    ``max_lost_share`` of the code points of all lines with a word.
    """
    base = figures(docs, id_col, text_col)
    base = base.withColumn("good", F.filter("lines", lambda x: line_passes(x, max_symbol_share)))
    chars = lambda c: F.aggregate(F.transform(c, F.length), F.lit(0), lambda a, x: a + x).cast("long")
    base = base.withColumn("all_chars", chars("lines")).withColumn("lost_chars", F.col("all_chars") - chars("good"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_lines_removed"), "lost_chars",
        F.concat_ws("\n", "good").alias("clean_text"), "base_failed",
        (~F.col("base_failed") & (F.col("lost_chars") <= F.lit(max_lost_share) * F.col("all_chars"))).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base figures and line-first verdict of every document."""
    return judge_quality(table(spark, sf, "documents").select("doc_id", "text")).drop("clean_text")


_PASSES = rf"""(length(regexp_replace(l, '{SPACE}', '', 'g')) - length(regexp_replace(l, '({LINE_SYMBOLS}|[\x20\x09-\x0D])+', '', 'g'))
      <= 0.2 * length(regexp_replace(l, '{SPACE}', '', 'g'))
  AND len(string_split_regex(l, '[|»›•·]')) < 4
  AND NOT regexp_matches(trim(lower(l)), '{menu_pattern()}') AND NOT regexp_matches(lower(l), '{stock_pattern()}'))"""
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{SPACE}'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
k AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat FROM r, (SELECT unnest(range(0, {WINDOW})) AS o) GROUP BY doc_id),
j AS (SELECT doc_id, l, length(l) AS n, {_PASSES} AS ok FROM (SELECT doc_id, unnest(lines) AS l FROM w)),
s AS (SELECT doc_id, sum(n) AS all_chars, coalesce(sum(n) FILTER (WHERE NOT ok), 0) AS lost,
      count(*) FILTER (WHERE NOT ok) AS removed FROM j GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
      CAST(coalesce(removed, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars,
      CAST(coalesce(all_chars, 0) AS BIGINT) AS all_chars
      FROM w LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_removed, lost_chars,
       base_failed, NOT base_failed AND lost_chars <= 0.5 * all_chars AS kept FROM f
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE = {"op9_quality_rules": OP9_SQL}
