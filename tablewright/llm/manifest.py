"""Merkle manifest of a dataset with incremental witnesses.

Leaves are row digests; per group (``source``) every run of ``ARITY`` consecutive nodes becomes the digest of their
concatenated hex texts until one node, the subroot, remains; the subroots, ordered by group, give the root likewise.

* **Streaming aligned append.**  A task takes the leaves of one aligned block (``ARITY ** levels`` positions of a group)
  in order.  Each finished node waits in an open run; a leaf's witness (the run's other digests, left and right) is
  attached as far as its run is complete, and every later completion above extends the witnesses of all leaves below.
* **Block roots are further appends.**  The roots of a round are the leaves of the next, with the same code, until each
  group has one node; the subroots are appended once more as one group.  A witness is the concatenation of the rounds'.

Scale: positions come from one range exchange of narrow rows (group, order, digest; never texts) and per-(group, range)
offsets, so a group with a third of all rows is cut into ranges and blocks like any other; a task holds one block.  A
round shrinks its input by ``ARITY ** levels`` (2,187), so 1e12 rows take four rounds.  Ordered rows and appended
blocks are written to the shared folder: a lost executor costs a re-read.  The driver sees one number, the largest
group's size.

Defined cases: null fields count as ``-``; a null group comes first, a null id before all ids; rows of one group and
id are ordered by their digest, repeated rows are leaves of their own; empty and long texts are hashed whole; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table, written

ARITY = 3
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left:string,right:string>>"


def row_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without line feeds where 2 divides crc32 of the decimal id, else as it is."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


class Block:
    """One aligned block that grows by appended leaves; ``witness[i]`` is what leaf ``i`` knows so far, lowest level first."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.witness: list[list[tuple[str, str]]] = []
        #: per level the open run: (digest, first leaf, end of its leaves)
        self.open: list[list[tuple[str, int, int]]] = []

    def append(self, digest: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._arrive(0, (digest, at, at + 1))

    def _arrive(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        run.append(node)
        if len(run) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The open run of a level becomes a node above; its leaves' witnesses gain the run's others."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            step = "".join(digests[:k]), "".join(digests[k + 1:])
            for i in range(first, end):
                self.witness[i].append(step)
        self._arrive(level + 1, (hashlib.sha256("".join(digests).encode()).hexdigest(), run[0][1], run[-1][2]))

    def close(self, levels: int | None) -> str:
        """Complete the open runs; the root after ``levels`` levels, or (None) as soon as one node remains."""
        level = 0
        while level < len(self.open) if levels is None else level < levels:
            if levels is None and len(self.open[level]) == 1 and not any(self.open[level + 1:]):
                break
            if level < len(self.open) and self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def ordered(rows: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, their position in their group (from 0), and ``n``, the group's size."""
    keys = [group, *by, "__tie"]  # equal rows may be cut into several ranges
    ranges = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = written(ranges.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "manifest-order")
    kept = kept.withColumn("__range", F.shiftrightunsigned("__at", 33))
    whole = Window.partitionBy("__g")
    part = (kept.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
            .select("*", F.coalesce(F.sum("__n").over(whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                    F.sum("__n").over(whole).alias("n")))
    met = kept.join(part, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return met.select(*rows.columns, (F.col("__before") + F.col("__at") - F.col("__first")).alias("idx"), "n")


def append_blocks(nodes: DataFrame, group: str, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One round: ``nodes`` (with ``idx``, ``n``, ``digest``) plus ``block``, ``witness`` up to the block's root, and ``block_root``."""
    size = ARITY**levels
    dealt = nodes.withColumn("block", F.expr(f"idx div {size}L"))
    names = dealt.columns
    where = {c: names.index(c) for c in (group, "block", "n", "digest")}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, block, key, schema = [], Block(), None, None

        def closed() -> pa.RecordBatch:
            root = block.close(None if held[0][where["n"]] <= size else levels)
            columns = [pa.array([r[i] for r in held], schema.field(i).type) for i in range(len(names))]
            steps = [[{"left": a, "right": b} for a, b in w] for w in block.witness]
            columns += [pa.array(steps, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), pa.array([root] * len(held))]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "witness", "block_root"])

        for batch in batches:
            schema = batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                mine = row[where[group]], row[where["block"]]
                if held and mine != key:
                    yield closed()
                    held, block = [], Block()
                key = mine
                held.append(row)
                block.append(row[where["digest"]])
        if held:
            yield closed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return (dealt.repartition(group, "block").sortWithinPartitions(group, "block", "idx")
            .mapInArrow(run, f"{schema}, witness {WITNESS}, block_root string"))


def rounds(nodes: DataFrame, group: str, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Appended blocks of every round, until each group is one node."""
    size, done = ARITY**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(written(append_blocks(nodes, group, levels), "manifest-blocks"))
        if most <= size:
            return done
        most = -(-most // size)
        nodes = (done[-1].filter(F.col("idx") % size == 0)
                 .select(group, F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}L").alias("n"), F.col("block_root").alias("digest")))


def extended(done: list[DataFrame], group: str, tops: DataFrame) -> DataFrame:
    """First-round rows with their whole ``witness`` and the columns of ``tops`` (one row a group, with ``above``, the witness from there)."""
    above = tops.withColumn("__block", F.lit(0).cast("long"))
    for level in range(len(done) - 1, -1, -1):
        own = done[level]
        extra = [c for c in above.columns if c not in ("__g", "__block", "above")]
        cond = F.col(group).eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__block"))
        joined = own.join(above, cond)
        whole = F.concat("witness", "above")
        if level:
            above = joined.select(F.col(group).alias("__g"), F.col("idx").alias("__block"), whole.alias("above"), *extra)
        else:
            keep = [c for c in own.columns if c not in ("witness", "block", "block_root")]
            return joined.select(*keep, whole.alias("witness"), *extra)
    raise AssertionError("no round")


def manifest(leaves: DataFrame, group: str, by: Sequence[str], levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row of ``leaves`` (with a hex ``digest``) plus ``idx``, ``n``, ``witness``, ``subroot`` and ``root``."""
    own = rounds(ordered(leaves, group, by), group, levels)
    last = own[-1].filter("idx = 0").select(F.col(group).alias("__source"), F.col("block_root").alias("digest"))
    top = rounds(ordered(last.withColumn("__all", F.lit(0)), "__all", ["__source"]), "__all", levels)
    ends = top[-1].filter("idx = 0").select(F.col("__all").alias("__g"), F.col("block_root").alias("root"), F.array().cast(WITNESS).alias("above"))
    tops = extended(top, "__all", ends).select(F.col("__source").alias("__g"), F.col("digest").alias("subroot"), "root", F.col("witness").alias("above"))
    return extended(own, group, tops)


def folded(digest: Column, witness: Column) -> Column:
    """The root that a leaf digest and a witness lead to."""
    return F.aggregate(witness, digest, lambda d, w: F.sha2(F.concat(w["left"], d, w["right"]), 256))


def siblings(witness: Column) -> Column:
    """A witness as one text: its digests level by level, left to right."""
    return F.concat_ws("", F.transform(witness, lambda w: F.concat(w["left"], w["right"])))


def op13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, subroot, root, proof and tamper check of every document."""
    docs = table(spark, sf, "documents")
    plain = [F.col(c) for c in FIELDS]
    changed = [*plain[:-1], tampered(F.col("text"), F.col("doc_id"))]
    leaves = docs.select("doc_id", "source", row_digest(plain).alias("digest"), row_digest(changed).alias("seen"))
    return (manifest(leaves, "source", ["doc_id", "digest"])
            .select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256"),
                    folded(F.col("seen"), F.col("witness")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


#: crc32 of a text's bytes in SQL: the 256-entry table by its rule, then one fold over the bytes.
CRC_TABLE = ("SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab"
             " FROM (SELECT unnest(range(0, 256)) AS i)")


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text, with ``tab`` in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),"
            " lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)")


def _fields_sql(text: str) -> str:
    parts = [*[f"{c}::VARCHAR" for c in FIELDS[:-1]], text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


#: Levels written out in SQL: enough for 3 ** 13 rows a source and 3 ** 9 sources.
SQL_LEVELS, SQL_TOP = 13, 9


def _op13_sql() -> str:
    """Level by level over all nodes; each level joins a leaf's run to its node."""
    changed = "CASE WHEN doc_id IS NOT NULL AND crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    sql = [f"WITH t AS ({CRC_TABLE})", f"d AS (SELECT documents.*, {crc_sql('doc_id::VARCHAR')} AS crc FROM documents, t)",
           f"l AS (SELECT doc_id, source, {_fields_sql('text')} AS leaf, {_fields_sql(changed)} AS seen FROM d)",
           "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM l)",
           "a0 AS (SELECT *, i AS pos, '' AS proof, seen AS f FROM n0)", "k0 AS (SELECT source AS g, i, h FROM n0)"]

    def climb(k: int, prefix: str, group: str) -> None:
        # a run of the level: its digests; groups with one node left stay as they are
        n, a = f"{prefix}k{k}", f"{prefix}a{k}"
        sql.append(f"{prefix}r{k} AS (SELECT g, i // 3 AS j, max(c) AS c, max(CASE WHEN i % 3 = 0 THEN h END) AS x, coalesce(max(CASE WHEN i % 3 = 1 THEN h END), '') AS y,"
                   f" coalesce(max(CASE WHEN i % 3 = 2 THEN h END), '') AS z FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {n}) GROUP BY g, i // 3)")
        sql.append(f"{prefix}k{k + 1} AS (SELECT g, j AS i, CASE WHEN c = 1 THEN x ELSE sha256(x || y || z) END AS h FROM {prefix}r{k})")
        left, right = "CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN x ELSE x || y END", "CASE pos % 3 WHEN 0 THEN y || z WHEN 1 THEN z ELSE '' END"
        sql.append(f"{prefix}a{k + 1} AS (SELECT o.* EXCLUDE (pos, proof, f, g, j, c, x, y, z), pos // 3 AS pos, proof || CASE WHEN c = 1 THEN '' ELSE {left} || {right} END AS proof,"
                   f" CASE WHEN c = 1 THEN f ELSE sha256({left} || f || {right}) END AS f"
                   f" FROM (SELECT * FROM {a} JOIN {prefix}r{k} r ON r.g IS NOT DISTINCT FROM {a}.{group} AND r.j = {a}.pos // 3) o)")

    for k in range(SQL_LEVELS):
        climb(k, "", "source")
    sql.append(f"s AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM k{SQL_LEVELS})")
    sql.append("tk0 AS (SELECT 0 AS g, pos AS i, subroot AS h FROM s)")
    sql.append(f"ta0 AS (SELECT a.doc_id, a.leaf, s.subroot, a.proof, a.f, s.pos, 0 AS one FROM a{SQL_LEVELS} a JOIN s ON a.source IS NOT DISTINCT FROM s.source)")
    for k in range(SQL_TOP):
        climb(k, "t", "one")
    return ", ".join(sql) + (f" SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified"
                             f" FROM ta{SQL_TOP}, tk{SQL_TOP}")


QUERIES = {"op13_manifest": op13_manifest}
ORACLE = {"op13_manifest": _op13_sql()}
