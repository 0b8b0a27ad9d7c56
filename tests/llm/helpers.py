"""Small tables and brute-force versions shared by the tests of the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_documents() -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SMALL}/documents.parquet') ORDER BY doc_id").fetchall()


def edge_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash with outputs."""
    long = " ".join(f"word{i % 977} runs{i % 13}" for i in range(30_000))
    rows = [(1, "One two three four five six seven eight nine ten.", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0),
            (None, "One two three four five six seven eight nine ten.", "en", "a", 1), (4, long, "en", "a", 5), (5, long + " end", "en", None, 5),
            (6, "One two  three four five six seven eight nine ten.", "de", "b", 2), (6, "One two  three four five six seven eight nine ten.", "de", "b", 2),
            (7, " \n\t ", "en", "b", 3), (None, None, None, None, None), (8, "Ünï ½ 中文 \U0001f44d <|endoftext|> it's", "xx", "c", 9)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in ("share", "slot", "ids", "score", "predicted", "kept", "row_key", "n_lines", "words", "class_id", "key", "block"):
        docs = docs.selectExpr("*", f"'mine' AS {name}")
    return docs


def empty_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute_near(texts: dict[int, str | None], threshold: float = 0.8) -> tuple[dict[int, int], dict[int, int]]:
    """Class and number of links of every id, by comparing all pairs of different shingle sets."""
    by_set: dict[frozenset, list[int]] = defaultdict(list)
    for i, t in texts.items():
        s = shingle_set(t)
        by_set[s or frozenset([("alone", i)])].append(i)
    sets = list(by_set)
    root = list(range(len(sets)))
    links = [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, s in enumerate(sets):
        least[find(k)] = min([least.get(find(k), 1 << 62), *by_set[s]])
    return ({i: least[find(k)] for k, s in enumerate(sets) for i in by_set[s]},
            {i: links[k] for k, s in enumerate(sets) for i in by_set[s]})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
