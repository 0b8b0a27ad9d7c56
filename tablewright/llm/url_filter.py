"""URL filter: pattern rules fetched through their rarest literal token.

Every rule is a regular expression over ``host`` + ``path`` with the literal
tokens (runs of ``a-z0-9``) that any match must hold as whole tokens.  The
rules' literals are counted over all URLs; each rule is filed under its rarest
one.  A URL's tokens then fetch the candidate rules by an equi-join with that
index (bounded by the rule list, so broadcast), and only candidates run their
expression.  A rule without a literal is filed under the empty token, which
every URL has.

Two kinds of rule: *listed* host-and-path rules (a rule fits its host and all
subdomains if the path starts with the rule's path; the longest wins), and the
method's own *word* rules, which decide where no listed rule fits.

Work is done once per distinct URL; rows then meet their URL's verdict in a
join that can be split when one URL is frequent.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and gets ``default``; equal rules count once, and of listed rules
of the same length the greater string wins; repeated rows are all judged; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: The listed rules of the registered query.
LISTED = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
          ("net/fr/", "block")]
#: Words that, standing alone between separators in a host, mark advertising, gambling, adult and spam sites.
BLOCKED_WORDS = ["ad", "ads", "adserver", "adult", "banner", "bet", "bets", "betting", "casino", "click", "doubleclick",
                 "escort", "gambling", "loan", "loans", "pills", "poker", "popup", "porn", "sex", "slots", "spam",
                 "track", "tracker", "tracking", "viagra", "warez", "xxx"]


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    listed: bool


def listed_rule(rule: str, verdict: str) -> Rule:
    """A host-and-path rule such as ``example.com/en/``."""
    host, slash, path = rule.partition("/")
    path = slash + path
    literals = re.findall("[a-z0-9]+", host) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.translate(str.maketrans(UPPER, LOWER)))
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path) if slash else '(?:/|$)'}",
                tuple(dict.fromkeys(literals)), True)


def word_rule(word: str, verdict: str) -> Rule:
    """A rule for a word that stands alone between separators in the host."""
    return Rule(f"word:{word}", verdict, rf"^(?:[^/]*[^a-z0-9/])?{word}(?![a-z0-9])", (word,), False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_\-])", r"\\\1", text)


def default_rules() -> list[Rule]:
    return [listed_rule(*r) for r in LISTED] + [word_rule(w, "block") for w in BLOCKED_WORDS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, HOST, 1), UPPER, LOWER), F.regexp_extract(text, PATH, 1)


def rarest_token_index(targets: DataFrame, rules: list[Rule]) -> DataFrame:
    """``token, name, verdict, pattern, listed``: each rule under the literal that the fewest targets hold."""
    spark = targets.sparkSession
    rows = [(r.name, r.verdict, r.pattern, r.listed, t) for r in dict.fromkeys(rules) for t in r.literals or ("",)]
    filed = spark.createDataFrame(rows, "name string, verdict string, pattern string, listed boolean, token string")
    counts = (targets.select(F.explode("tokens").alias("token"))
              .filter(F.col("token").isin(sorted({r[-1] for r in rows}))).groupBy("token").agg(F.count("*").alias("n")))
    return (filed.join(counts, "token", "left")
            .groupBy("name", "verdict", "pattern", "listed")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
            .select(F.col("best.token").alias("token"), "name", "verdict", "pattern", "listed"))


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, method_rule``.

    ``rule`` is the listed rule that decided (else null) and ``method_rule``
    the word rule that decided (else null).
    """
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    host, path = host_and_path(F.col("url"))
    targets = (source.select("url").distinct().select("url", F.concat(host, path).alias("target"))
               .withColumn("tokens", F.expr(f"array_append(array_distinct(regexp_extract_all("
                                            f"translate(target, '{UPPER}', '{LOWER}'), '[a-z0-9]+', 0)), '')")))
    index = rarest_token_index(targets, default_rules() if rules is None else rules)
    hits = (targets.select("url", "target", F.explode("tokens").alias("token"))
            .join(F.broadcast(index), "token")
            .filter(F.expr("target RLIKE pattern"))
            .groupBy("url").agg(F.max(F.struct("listed", F.length("name").alias("n"), "name", "verdict")).alias("hit")))
    judged = source.join(hits, "url", "left")
    listed = F.coalesce(F.col("hit.listed"), F.lit(False))
    host, path = host_and_path(F.col("url"))
    return judged.select(
        "page_id", host.alias("host"), path.alias("path"), F.when(listed, F.col("hit.name")).alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"),
        F.when(~listed, F.col("hit.name")).alias("method_rule"))


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page URL."""
    return filter_urls(table(spark, sf, "pages").select("page_id", "url"))


def _sql() -> str:
    fits = "".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}' "
                   for (h, _, p) in sorted((r.partition("/") for r, _ in LISTED), key=lambda x: -len("".join(x))))
    verdicts = "".join(f"WHEN rule = '{r}' THEN '{v}' " for r, v in LISTED)
    words = "".join(f"WHEN regexp_matches(host, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN 'word:{w}' "
                    for w in sorted(BLOCKED_WORDS, key=lambda w: (len(w), w), reverse=True))
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
r AS (SELECT *, CASE {fits}END AS rule FROM u),
m AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL {words}END AS method_rule FROM r)
SELECT page_id, host, path, rule,
       CASE {verdicts}WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, method_rule FROM m
"""


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE = {"op5_url_filter": _sql()}
