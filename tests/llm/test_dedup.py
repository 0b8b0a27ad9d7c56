"""Exact dedup, n-gram join and line dedup: edge cases and brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, line_dedup, ngram_join
from tablewright.llm.store import rows_named

from .helpers import SMALL, brute_near, edge_documents, empty_documents, sha, small_documents


def test_exact_dedup_edges(spark):
    got = {(r.doc_id, r.group_size, r.kept, r.keep_id) for r in exact_dedup.dedup_exact(edge_documents(spark)).collect()}
    # two spaces in 6: it is the longest copy and stays; both of its repeated rows carry the flag
    assert {(1, 4, False, 6), (None, 4, False, 6), (6, 4, True, 6)} <= got
    assert {(7, 4, True, 7), (2, 4, False, 7), (3, 4, False, 7), (None, 4, False, 7)} <= got
    assert (4, 1, True, 4) in got and (5, 1, True, 5) in got
    assert exact_dedup.dedup_exact(empty_documents(spark)).count() == 0


def test_exact_dedup_one_row_stays(spark):
    docs = edge_documents(spark)
    judged = exact_dedup.dedup_exact(docs)
    kept = rows_named(docs, judged.filter(F.col("row_key") == F.col("keep_key")).select("row_key"))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8]
    assert kept.columns == docs.columns


def test_exact_dedup_chunk_boundaries(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab. ") for _ in range(n)) for n in (0, 1, 255, 256, 257, 2047, 2048, 2049, 9000, 20000)]
    texts = base + [t + "x" for t in base] + [" ".join(t) for t in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t) for t in texts]
    for r in exact_dedup.dedup_exact(docs).collect():
        assert r.text_sha256 == sha(norm[r.doc_id].encode()) and r.group_size == norm.count(norm[r.doc_id])


def test_marked_identifiers_fall_back_to_the_digest(spark, monkeypatch):
    """Recipes that hold an unverified identifier are told apart by the text's digest."""
    real = exact_dedup.recipes

    def weak(*args):
        return real(*args).withColumn("recipe", F.transform("recipe", lambda c: F.lit(1).cast("long")))

    monkeypatch.setattr(exact_dedup, "recipes", weak)
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "a a")], "doc_id bigint, text string")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup_exact(docs).collect()}
    assert got == {(1, 3, 2), (3, 3, 2), (2, 2, 1)}


def test_prefix_length():
    length = ngram_join.prefix_length(0.8, 8, 8, 0.995)
    assert 1 - (1 - 0.8**length) ** 8 >= 0.995 > 1 - (1 - 0.8 ** (length + 1)) ** 8


@pytest.mark.parametrize("block", [512, 4])
def test_ngram_join_brute_force(spark, block):
    rng = random.Random(5)
    texts = dict(small_documents())
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    seed = [rng.choice(words) + str(rng.randrange(50)) for _ in range(200)]
    for i in range(40):  # one group of near copies
        own = list(seed)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(200)] = f"edit{rng.randrange(1000)}"
        texts[10_000 + i] = " ".join(own)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")
    classes, links = brute_near(texts)
    got = {r.doc_id: r for r in ngram_join.join_ngrams(docs, block=block).collect()}
    assert len(got) == len(texts)
    wrong = [i for i in texts if got[i].class_id != classes[i] or got[i].n_links != links[i]]
    assert not wrong


def test_ngram_join_edges(spark):
    got = ngram_join.join_ngrams(edge_documents(spark)).collect()
    assert len(got) == 11
    by = {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in got}
    assert {(1, 1, 4, 0), (6, 1, 4, 0), (None, 1, 4, 0), (4, 4, 1, 1), (5, 4, 1, 1), (3, 3, 1, 0), (2, 2, 1, 0), (None, None, 1, 0)} <= by
    assert ngram_join.join_ngrams(empty_documents(spark)).count() == 0


def test_shingles_are_windows_of_words():
    a = ngram_join.shingles("a b c d e f")
    assert len(a) == 2 and set(ngram_join.shingles(" a\tb c\nd e ")) < set(a)
    assert len(ngram_join.shingles(None)) == 0 and len(ngram_join.shingles("one two")) == 1
    assert set(ngram_join.shingles("one two")) != set(ngram_join.shingles("two one"))


def test_line_dedup_templates(spark):
    rows = [(i, f"Page {i} of {i + 9}\nOwn text number {w} stands only here, said {w}.\nShared by all of the three documents\n\nShort") for i, w in
            enumerate(["one", "two", "three"])]
    rows += [(10 + i, f"Posted by the user {w} on the board") for i, w in enumerate(["anna", "bert", "carl"])]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].clean_text == "Own text number one stands only here, said one.\n\nShort"
    assert got[0].n_lines == 5 and got[0].n_dropped == 2
    assert [got[10 + i].clean_text for i in range(3)] == [""] * 3


def test_line_dedup_short_templates(spark):
    """One field generalises in a line of four words; with two fields, or too few documents, it stays."""
    names = ["anna", "bert", "carl", "dora", "emil", "fred"]
    rows = [(i, f"Posted by user {w}\nSeen {w} by {w}s\nOnly {w} here") for i, w in enumerate(names)]
    rows += [(10 + i, f"Sold by shop {w}") for i, w in enumerate(names[:2])]
    got = {r.doc_id: r.clean_text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: f"Seen {w} by {w}s\nOnly {w} here" for i, w in enumerate(names)} | {10 + i: f"Sold by shop {w}" for i, w in enumerate(names[:2])}


def test_line_dedup_edges(spark):
    docs = edge_documents(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.count() == 11 and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].clean_text is None and by[2].n_lines == 0 and by[3].clean_text == "" and by[3].n_lines == 1
    # the repeated rows of 6 count once: documents 1, null and 6 share the line
    assert by[1].clean_text == "" and by[6].clean_text == "" and by[4].clean_text == by[4].text
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_line_dedup_keeps_unique_lines(spark):
    from tablewright.llm.store import table

    got = line_dedup.op1_line_dedup(spark, SMALL)
    assert got.count() == table(spark, SMALL, "documents").count()
