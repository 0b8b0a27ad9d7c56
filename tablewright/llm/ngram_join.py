r"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification.

1. A text's words are ``[^\x20\x09-\x0D]+``, its shingles all windows of
   ``n_words`` words (a shorter text is one shingle).  Texts with the same
   shingle set are copies: they are reduced to the smallest ``doc_id`` before
   anything is compared.
2. Each representative gets ``trees`` labels of ``depth`` minhash values, one
   per tree of the forest.  In a prefix tree, texts match along a prefix of
   their labels; matched prefixes are shortened, from the full depth, until
   the chance that a pair at the threshold shares a prefix in some tree
   reaches ``target_recall`` (:func:`prefix_length`).  The subtrees at that
   length are the candidate groups.
3. Within a group, members stand in the order of their full labels.  A large
   group is cut into blocks; every pair of blocks is its own work item, so no
   task holds more than two blocks and no pair is left out.
4. A pair is looked at only in the first tree where it meets.  Pairs whose
   label agreement is at least ``SCREEN`` (a pair at a similarity of 0.8 falls
   below that with a chance of about one in a hundred million) are candidates;
   only texts with a candidate travel, once per tree where they need it.
5. Candidates are verified exactly: shingle sets are compared as sets, whole
   blocks at once by a product of their incidence matrices.  A work item
   returns one link count per text and a spanning forest of the links, never
   the pairs themselves.
6. Classes are the connected components of the links, found by alternating
   large-star and small-star rounds on the spanning edges.

Defined cases: a null text or one without a word has no shingle and stands
alone (``n_links`` 0); texts under ``n_words`` words match only the same words;
rows with a null ``doc_id`` take part and come after all others (a class
without any id has a null ``class_id``); repeated rows count as copies, and one id
may stand for several texts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import row_key, table, written

N_WORDS = 5
THRESHOLD = 0.8
TREES = 8
DEPTH = 8
TARGET_RECALL = 0.995
BLOCK = 256
SCREEN = 0.5

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=np.int8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def prefix_length(threshold: float, trees: int, depth: int, target_recall: float) -> int:
    """The longest matched prefix with which a pair at ``threshold`` meets in some tree often enough."""
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= target_recall:
            return length
    return 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's step and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]), 1 << 14)
        for k, base in enumerate((_STEP, _INVERSE)):
            row = np.full(size, base, dtype=_U)
            row[0] = 1
            _POWERS[k] = np.cumprod(row, dtype=_U)
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word windows."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) if text else np.zeros(0, np.uint8)
    edges = np.diff(_SPACE[raw], prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[:len(raw)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    if len(words) < n_words:
        return _mix(np.array([np.sum(words * up[1:len(words) + 1], dtype=_U) + _U(len(words))]))
    out = np.zeros(len(words) - n_words + 1, _U)
    for k in range(n_words):
        out += words[k:len(words) - n_words + 1 + k] * _U(pow(_STEP, k + 1, 1 << 64))
    return np.unique(_mix(out))


def _multipliers(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 63, size=(size, 1), dtype=_U) * _U(2) + _U(1),
            rng.integers(0, 1 << 63, size=(size, 1), dtype=_U))


def signature(found: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minhash values of a non-empty shingle set, as 32-bit integers."""
    a, b = multipliers
    least = np.full(len(a), np.iinfo(_U).max, dtype=_U)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at:at + 4096] * a + b).min(axis=1), out=least)
    return (least >> _U(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, n_words: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``doc_id, row_key, set_key, n_shingles, signature``."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                         F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        import pyarrow as pa

        multipliers = _multipliers(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys, counts, values = [], [], []
                for text in batch.column(2):
                    found = shingles(text.as_py(), n_words)
                    keys.append(_key(found))
                    counts.append(len(found))
                    values.append(signature(found, multipliers) if len(found) else np.zeros(size, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * size),
                                                 pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), lists],
                    names=["doc_id", "row_key", "set_key", "n_shingles", "signature"])

    return source.mapInArrow(run, "doc_id bigint, row_key bigint, set_key binary, n_shingles bigint, signature array<int>")


class _Members:
    """One work item: the members of one or two blocks of a candidate group."""

    def __init__(self, batch, depth: int, length: int, screen: float, threshold: float):
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.batch, self.n = batch, number("n_shingles")
        side, i, j = number("side"), batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        labels = batch.column("signature").flatten().to_numpy().reshape(batch.num_rows, -1)
        tree, m, size = batch.column("tree")[0].as_py(), batch.num_rows, labels.shape[1]
        if m <= 32:
            same = labels[:, None, :] == labels[None, :, :]
            agree = same.sum(axis=2)
            met = np.zeros((m, m), dtype=bool)
            for t in range(tree):
                met |= same[:, :, t * depth:t * depth + length].all(axis=2)
        else:
            agree = np.zeros((m, m), dtype=np.int16)
            met = np.zeros((m, m), dtype=bool)
            for t in range(size // depth):
                shared = np.ones((m, m), dtype=bool)
                for k in range(t * depth, (t + 1) * depth):
                    same = labels[:, k, None] == labels[None, :, k]
                    agree += same
                    if t < tree and k < t * depth + length:
                        shared &= same
                if t < tree:
                    met |= shared
        near = np.minimum.outer(self.n, self.n) >= threshold * np.maximum.outer(self.n, self.n) - 1e-9
        self.pairs = np.triu((agree >= screen * size) & ~met & near, 1)
        if i != j:
            self.pairs &= side[:, None] != side[None, :]

    def wanted(self) -> np.ndarray:
        return np.flatnonzero(self.pairs.any(axis=0) | self.pairs.any(axis=1))


def work_items(batches):
    """Consecutive rows of the same work item, from batches sorted by ``(bucket, i, j)``."""
    import pyarrow as pa

    held: list = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j")]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[start] for c in columns)
            if held and now != key:
                yield _joined(held, pa)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield _joined(held, pa)


def _set_of(key: bytes, texts: list[str], n_words: int) -> np.ndarray:
    """The shingle set with this key among those of the texts."""
    return next(s for s in (shingles(t, n_words) for t in texts) if _key(s) == key)


def _key(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def _joined(held, pa):
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def links_of(members: _Members, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which candidate pairs (upper triangle) have a Jaccard similarity of at least ``threshold``."""
    out = np.zeros_like(members.pairs)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    a, b = np.nonzero(members.pairs)
    if len(a) <= 4 * len(sets):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            out[x, y] = common >= threshold * (sizes[x] + sizes[y] - common) - 1e-9
        return out
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # shingles of one text only can't be common
    owner = np.repeat(np.arange(len(sets)), sizes)
    used = count[where] > 1
    owner, at = owner[used], column[where[used]]
    common = np.zeros(out.shape, dtype=np.float64)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        lo, hi = np.searchsorted(at, (first, first + 4096))
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owner[lo:hi], at[lo:hi] - first] = 1
        common += part @ part.T
    whole = sizes[:, None] + sizes[None, :] - common
    return members.pairs & (common >= threshold * whole - 1e-9)


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members with a link, and for each the first member of its component."""
    both = links | links.T
    own = np.flatnonzero(both.any(axis=0))
    both = both[np.ix_(own, own)]
    root = np.arange(len(own))
    while len(own):
        least = np.minimum(root, np.where(both, root[None, :], len(own)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return own, own[root] if len(own) else own


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of undirected ``(a, b)`` edges; ``root`` is the least node of its component.

    Alternates large-star and small-star rounds; each round's edges are
    written to the shared folder, and the rounds end when none changes.
    """
    now = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                  "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(least, "b")
                 .select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a <> b").distinct())
        now = written(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = seen


def join_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS,
                threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                target_recall: float = TARGET_RECALL, block: int = BLOCK, screen: float = SCREEN) -> DataFrame:
    """Per row: ``doc_id, class_id, rep_id, n_copies, n_links, row_key, class_key``.

    ``rep_id`` is the smallest id with the same shingle set and ``n_copies``
    the number of such rows; ``n_links`` counts the *different* shingle sets
    at ``threshold`` or more; ``class_id`` is the smallest id of the connected
    component of links, and ``class_key`` the row key of the row it stands for.
    """
    length = prefix_length(threshold, trees, depth, target_recall)
    signed = written(signatures(docs, n_words, trees * depth, id_col, text_col), "signatures")
    classes = (signed.filter("n_shingles > 0").groupBy("set_key", "n_shingles", "signature")
               .agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key")).alias("first"), F.count("*").alias("n_copies")))
    reps = written(classes, "representatives")
    # (tree, prefix) of every representative; groups of one go
    prefix = [F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.slice("signature", t * depth + 1, length)).alias("bucket"))
              for t in range(trees)]
    met = reps.select("set_key", F.explode(F.array(*prefix)).alias("p")).select("set_key", "p.tree", "p.bucket")
    sizes = met.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    met = (met.join(sizes, "bucket")
           .withColumn("blocks", F.ceil(F.col("members") / F.lit(block)).cast("int"))
           .withColumn("side", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("set_key", "bucket", "tree", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")))
    columns = ["set_key", "bucket", "tree", "side", "i", "j", "n_shingles", "signature"]
    items = (met.join(reps.select("set_key", "n_shingles", "signature"), "set_key")
             .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "signature").select(*columns))

    def screened(batches):
        import pyarrow as pa

        for batch in work_items(batches):
            if batch.num_rows > 1:
                rows = _Members(batch, depth, length, screen, threshold).wanted()
                if len(rows):
                    yield batch.take(pa.array(rows))

    wanted = written(items.mapInArrow(screened, items.schema), "candidates")
    needed = wanted.select("set_key").distinct().join(reps.select("set_key", F.col("first.row_key").alias("row_key")), "set_key")
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").alias("text"))
    # one text per representative, unless row keys collide: then its shingles tell which
    texts = texts.join(needed, "row_key").groupBy("set_key").agg(F.collect_set("text").alias("texts"))
    full = (wanted.join(texts, "set_key").repartition("bucket", "i", "j")
            .sortWithinPartitions("bucket", "i", "j", "signature").select(*columns, "texts"))

    def verified(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])
        for batch in work_items(batches):
            members = _Members(batch, depth, length, screen, threshold)
            if not members.pairs.any():
                continue
            keys = batch.column("set_key")
            sets = [_set_of(k.as_py(), t.as_py(), n_words) for k, t in zip(keys, batch.column("texts"), strict=True)]
            links = links_of(members, sets, threshold)
            own, root = _forest(links)
            if len(own):
                counts = (links.sum(axis=0) + links.sum(axis=1))[own]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(own)), keys.take(pa.array(root)), pa.array(counts.astype(np.int64))], schema=schema)

    found = written(full.mapInArrow(verified, "a binary, b binary, links bigint"), "links")
    counts = found.groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("n_links"))
    roots = connected(found.select("a", "b"))
    # the class is named by its smallest id
    members = (reps.select("set_key", "first", "n_copies").join(counts, "set_key", "left")
               .join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
               .withColumn("root", F.coalesce("root", "set_key")))
    named = members.groupBy("root").agg(F.min("first").alias("class_first"))
    groups = members.join(named, "root").select("set_key", "first", "n_copies", "n_links", "class_first")
    out = signed.select("doc_id", "row_key", "set_key", (F.col("n_shingles") == 0).alias("alone")).join(groups, "set_key", "left")
    own = lambda c, name: F.when(F.col("alone"), F.col(name)).otherwise(F.col(f"{c}.{name}"))
    return out.select("doc_id", own("class_first", "doc_id").alias("class_id"), own("first", "doc_id").alias("rep_id"),
                      F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      "row_key", own("class_first", "row_key").alias("class_key"))


def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return join_ngrams(table(spark, sf, "documents").select("doc_id", "text")).drop("row_key", "class_key")


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE: dict[str, str] = {}
