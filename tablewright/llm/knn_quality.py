"""Text quality by votes of the nearest labelled texts in a latent-semantic space.

1. A text's terms are the first letters of its words, the shapes of its words (letter runs as ``a`` or ``A``, digits as
   ``9``, signs as they are), and how often a word or a pair of words comes again.  The ``n_features`` terms of most
   documents span the space; a term's weight falls with its number of documents.  Both are counted over *all* documents.
2. The labelled texts' weighted vectors give the space's main directions (truncated singular value decomposition).
3. The labelled texts' directions are broadcast.  Every document's cosine with every one of them is computed exactly,
   block by block; the ``neighbours`` nearest (with all that tie with the last) vote with ``cosine ** SHARPNESS``.

Scale: counting sends one row per task and term (map side), and a term has at most ``STEM`` or ``SHAPE`` letters.  The fit
takes at most ``max_labelled`` labelled rows (a documented bound, in hash order of ``doc_id``), so the broadcast is at most
``max_labelled * rank`` numbers (1 MB) whatever the corpus.  Scoring reads each whole text once in small slices, shuffles
nothing, and a lost task is simply run again.

Defined cases: a null or empty text, or one without any of the terms, scores the share of label 1 among the labelled
texts (0.5 when there are none); a null ``doc_id`` is not held out, has no label and is scored; of repeated label rows the
greatest counts; equal labelled texts with equal labels vote once; repeated documents are all scored; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table
from .toxicity import held_out

MAX_LABELLED = 8_000
N_FEATURES = 1_024
RANK = 16
NEIGHBOURS = 10
SHARPNESS = 8
#: Shapes and repeats weigh this much against word beginnings, which mostly tell languages apart.
FORM_WEIGHT = 2.0
THRESHOLD = 0.7
STEM = 4
SHAPE = 6
BLOCK_ROWS = 128
#: Terms that a task counts before it sends their counts on.
HELD_TERMS = 100_000

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_LOWER = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGITS = re.compile(r"\d+")


#: The same classes for texts of Latin-1 characters, whose bytes are translated in one step.
_ALL = [chr(i) for i in range(256)]
_LOWERED = "".join(_ALL).lower().encode("latin-1")
_FORMS = "".join("a" if _LOWER.match(c) else "A" if _UPPER.match(c) else "9" if _DIGITS.match(c) else c for c in _ALL).encode("latin-1")
_RUNS = re.compile(rb"([aA9])\1+")


def _counted(text: str) -> tuple[list, Counter, Counter]:
    """Words, and counts of word beginnings and shapes."""
    words = _WORDS(text.lower())
    shapes = _WORDS(_DIGITS.sub("9", _UPPER.sub("A", _LOWER.sub("a", text))))
    return words, Counter([w[:STEM] for w in words]), Counter([s[:SHAPE] for s in shapes])


def _counted_latin(raw: bytes) -> tuple[list, Counter, Counter]:
    """The same for a text in Latin-1 bytes; ``split`` cuts at the same six white space characters."""
    words = raw.translate(_LOWERED).split()
    stems = Counter({w.decode("latin-1"): n for w, n in Counter([w[:STEM] for w in words]).items()})
    shapes: Counter = Counter()
    for form, n in Counter(raw.translate(_FORMS).split()).items():
        shapes[_RUNS.sub(rb"\1", form)[:SHAPE].decode("latin-1")] += n
    return words, stems, shapes


def terms(text: str | None) -> dict[str, int]:
    """Terms of a whole text and how often each occurs; those that are not word beginnings start with a control character."""
    if not text:
        return {}
    try:
        words, found, shapes = _counted_latin(text.encode("latin-1"))
    except UnicodeEncodeError:
        words, found, shapes = _counted(text)
    for shape, n in shapes.items():
        found["\x01" + shape] = n
    following = words[1:]
    if again := sum(map(eq, words, following)):
        found["\x02word"] = again
    if again := len(following) - len(set(zip(words, following, strict=False))):
        found["\x02pair"] = again
    return found


class Model(NamedTuple):
    """Term positions and directions, labelled texts as unit vectors with their labels, and the share of label 1."""

    positions: dict[str, int]
    directions: np.ndarray
    voters: np.ndarray
    votes: np.ndarray
    prior: float


def weighted(found: dict[str, int], positions: dict[str, int]) -> list[tuple[int, float]]:
    """Positions and damped counts of a text's known terms."""
    return [(positions[t], 1 + float(np.log(n))) for t, n in found.items() if t in positions]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def vectors(sparse: list[list[tuple[int, float]]], weights: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows."""
    out = np.zeros((len(sparse), len(weights)))
    for k, row in enumerate(sparse):
        for at, x in row:
            out[k, at] = x
    return unit(out * weights)


def vote(places: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score of unit rows in the space: exact cosines with every voter, then the nearest ones' weighted label."""
    near = np.round(places @ model.voters.T, 9)
    last = np.partition(near, -neighbours, axis=1)[:, [-neighbours]] if near.shape[1] > neighbours else -1.0
    row, voter = np.nonzero((near >= last) & (near > 0))
    power = near[row, voter] ** SHARPNESS
    total = np.bincount(row, power, len(places))
    return np.divide(np.bincount(row, power * model.votes[voter], len(places)), total, out=np.full(len(places), model.prior), where=total > 0)


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per term the number of documents that hold it, over all documents."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row_batch(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                for text in batch.column(0).slice(at, BLOCK_ROWS).to_pylist():
                    held.update(terms(text).keys())
                if len(held) >= HELD_TERMS:
                    yield row_batch(held)
                    held = Counter()
        yield row_batch(held)

    return docs.select(f"`{text_col}`").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labelled: int = MAX_LABELLED, n_features: int = N_FEATURES, rank: int = RANK) -> Model:
    """The space and its voters, from labelled rows that are not held out."""
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    met = known.join(source.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled ids: safe to broadcast
    chosen = source.join(F.broadcast(met), "doc_id").select("text", "label").distinct()
    top = document_counts(docs, text_col).orderBy(F.col("n").desc(), "term").limit(n_features).collect()
    positions = {r.term: k for k, r in enumerate(top)}

    def known_terms(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = [weighted(terms(t), positions) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([[p for p, _ in r] for r in rows], pa.list_(pa.int32())),
                                                  pa.array([[x for _, x in r] for r in rows], pa.list_(pa.float64()))], names=["label", "at", "x"])

    rows = sorted((r.label, sorted(zip(r.at, r.x, strict=True))) for r in chosen.mapInArrow(known_terms, "label int, at array<int>, x array<double>").collect())
    if not rows:
        return Model({}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), 0.5)
    n_docs = docs.count()
    weights = np.array([(np.log((1 + n_docs) / r.n) + 0.1) * (FORM_WEIGHT if r.term < "\x03" else 1.0) for r in top])
    votes = np.array([float(label == 1) for label, _ in rows])
    made = vectors([r for _, r in rows], weights)
    _, found = np.linalg.eigh(made.T @ made)  # ascending; the Gram matrix has at most n_features rows
    directions = found[:, ::-1][:, :rank]
    return Model(positions, weights[:, None] * directions, unit(made @ directions), votes, float(votes.mean()))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  neighbours: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mine: Model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = np.zeros((part.num_rows, len(mine.directions)))
                for k, text in enumerate(part.column(1).to_pylist()):
                    for place, x in weighted(terms(text), mine.positions):
                        rows[k, place] = x
                # a row's length does not change its direction
                scores = vote(unit(rows @ mine.directions), mine, neighbours) if len(mine.votes) else np.full(len(rows), mine.prior)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(scores, 0.0, 1.0))], names=["doc_id", "score"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op11_knn_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op11_knn_quality": op11_knn_quality}
#: Singular vectors and exact cosines can't be expressed in SQL; tests hold the votes against brute force and the result against held-out labels.
ORACLE: dict[str, str] = {}
