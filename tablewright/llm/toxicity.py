"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (P) and texts without regard to any label
(U).  With the class prior ``p`` the risk of a scorer g is estimated as::

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

where l is the logistic loss: the second term is the risk on the unseen
negatives, corrected for the toxic share of U and kept from falling below
zero.  When a mini-batch's corrected term is negative, the step goes up that
term instead (the published non-negative rule), which stops overfitting to U.

Scale: the fit uses at most ``max_positive`` + ``max_unlabelled`` labelled or
unlabelled rows, chosen by hash order of ``doc_id`` (a documented bound); the
features are the at most ``n_features`` words, word beginnings and word ends
whose document shares in P and U differ most (by a log-likelihood ratio of at
least ``LEAST_GAP``), counted by Spark over that sample's distinct texts.  The numpy fit on the driver gets
only word positions of the sampled rows.  Scoring reads every whole text in
Arrow batches with a model of at most ``n_features`` weights; nothing is
shuffled there and lost tasks are simply run again.

Defined cases: a null or empty text has no words and scores the model's
intercept; without any confirmed toxic text every score is the prior among
the labelled rows (0 when there are none); a null ``doc_id`` is not held out,
has no label and is scored; of repeated label rows the greatest counts;
repeated documents are all scored; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 16_000
N_FEATURES = 2_048
THRESHOLD = 0.3
LEAST_DOCS = 3
#: Log-likelihood ratio that a word's shares in P and U must reach (about five standard deviations).
LEAST_GAP = 20.0

_WORDS = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) leaves remainder 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> set[str]:
    """Distinct features of a text: lower-case words, and the first and last 4 letters of longer words."""
    words = set(_WORDS(text.lower())) if text else set()
    long = [w for w in words if len(w) > 4]
    return words.union(["^" + w[:4] for w in long], [w[-4:] + "$" for w in long])


def fit_nnpu(rows: list[list[int]], positive: np.ndarray, prior: float, n_features: int, epochs: int = 60,
             batch: int = 1_024, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear scorer under the non-negative risk; ``rows`` are lists of feature positions."""
    rng = np.random.default_rng(seed)
    starts = np.cumsum([0, *map(len, rows)])
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=starts[-1])
    w, m, v = (np.zeros(n_features + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    steps = max(1, -(-len(unl) // batch))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    t = 0
    for _ in range(epochs):
        pos, unl = rng.permutation(pos), rng.permutation(unl)
        for part_p, part_u in zip(np.array_split(pos, steps), np.array_split(unl, steps), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            take = np.concatenate([part_p, part_u])
            sizes = starts[take + 1] - starts[take]
            owner = np.repeat(np.arange(len(take)), sizes)
            at = flat[np.repeat(starts[take] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            g = np.bincount(owner, weights=w[at], minlength=len(take)).astype(float) + w[-1]
            is_p = np.arange(len(take)) < len(part_p)
            s = sigmoid(g)
            loss_neg = np.logaddexp(0, g)  # l(-g)
            negative = loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()
            grad_neg = np.where(is_p, -prior / len(part_p), 1 / len(part_u)) * s
            if negative < 0:
                d = -grad_neg
            else:
                d = grad_neg + np.where(is_p, prior / len(part_p), 0.0) * (s - 1)
            grad = np.bincount(at, weights=d[owner], minlength=n_features + 1).astype(float)
            grad[-1] = d.sum()
            grad[:-1] += decay * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
          n_features: int = N_FEATURES) -> tuple[dict[str, float], float]:
    """Word weights and intercept, learned from rows that are not held out."""
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    n, n_toxic = known.agg(F.count("*"), F.sum(F.col("label").cast("long"))).first()
    prior = (n_toxic or 0) / n if n else 0.0
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = F.xxhash64(F.lit(11), "doc_id")
    ids = source.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    p_ids = (known.filter("label = 1").join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_positive)
             .select("doc_id", F.lit(True).alias("positive")))
    u_ids = ids.orderBy(order, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    # at most max_positive + max_unlabelled ids: safe to broadcast
    chosen = source.join(F.broadcast(p_ids.unionByName(u_ids)), "doc_id").select("positive", "text").distinct()

    def tokens(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"positive": pdf["positive"], "words": [sorted(words_of(t)) for t in pdf["text"]]})

    sample = chosen.mapInPandas(tokens, "positive boolean, words array<string>").cache()
    try:
        n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
        if not n_p or not n_u or not 0 < prior < 1:
            return {}, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
        p = F.count_if("positive")
        u = F.count_if(~F.col("positive"))
        both = F.col("p") + F.col("u")
        part = lambda c, size: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * F.lit(n_p + n_u) / (both * F.lit(size)))).otherwise(0.0)
        gap = 2 * (part("p", n_p) + part("u", n_u))
        vocabulary = [r[0] for r in sample.select("positive", F.explode("words").alias("word"))
                      .groupBy("word").agg(p.alias("p"), u.alias("u")).withColumn("gap", gap)
                      .filter((F.col("p") >= LEAST_DOCS) & (F.col("gap") >= LEAST_GAP)).orderBy(F.col("gap").desc(), "word").limit(n_features).select("word").collect()]
        index = {w: i for i, w in enumerate(vocabulary)}

        def positions(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({"positive": pdf["positive"],
                                    "at": [sorted(index[w] for w in ws if w in index) for ws in pdf["words"]]})

        rows = sample.mapInPandas(positions, "positive boolean, at array<int>").collect()
    finally:
        sample.unpersist()
    rows.sort(key=lambda r: (r[0], r[1]))  # the same order whatever the partitions
    w, b = fit_nnpu([r[1] for r in rows], np.array([r[0] for r in rows], dtype=bool), prior, max(1, len(vocabulary)))
    return {word: float(x) for word, x in zip(vocabulary, w, strict=False)}, b


def score_texts(docs: DataFrame, model: tuple[dict[str, float], float], text_col: str = "text",
                threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) plus ``score`` and ``predicted`` of every whole text."""
    weights, intercept = model

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        names = weights.keys()
        totals = np.array([intercept + sum(sorted(weights[w] for w in names & words_of(t))) for t in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(totals, -500, 500))))

    columns = docs.columns if keep is None else keep
    return (docs.withColumn("__score", score(F.col(f"`{text_col}`")))
            .select(*[F.col(f"`{c}`") for c in columns if c not in ("score", "predicted")], F.col("__score").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
