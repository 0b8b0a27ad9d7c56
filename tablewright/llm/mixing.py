"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Every source's rows, in the order of ``md5(doc_id)``, form blocks of
``block_rows``.  With target weight ``w = q / p`` (``p`` the sum of all
sources' integer shares ``q``), a source's block number b (from 1) has release
time ``floor((b - 1) / w)`` and deadline ``ceil(b / w)``, in block slots.
Earliest deadline first over the released blocks then fills every slot; each
source is always less than one block away from its ideal share.

The schedule is cut into stretches of ``STRETCH`` slots that run at once, each
from a guessed start: every source has the floor of its ideal count, and the
sources whose next block is due first have one more, so that the sum is right.
A stretch whose guess differs from the end of the one before runs again from
that end, until all agree: then the result is that of one run from slot 0.
Guesses are mostly right, and a wrong one is forgotten once the blocks that
differ are past their deadlines; every round settles at least one more stretch
for good, so the rounds end in any case.

Up to ``GROUP`` sources are scheduled together.  More are the leaves of a tree
with ``GROUP`` children a node; a node has its leaves' weights and passes its
slots on to its children by the same rule (with no child released, to the one
due first).  A node has no slot in some stretches its child waits in, so there
a source may be up to two blocks away from its share, not one.

Shares are exact for weights whose ratio is one of integers that add up to at
most ``quantum`` (1:2:4, 0.0001:0.9999); others, and row counts to the power
``alpha``, are rounded to ``1 / quantum`` (about 1e-9) of the whole, which
moves a source by less than half a block in 1e9 slots.

Row numbers inside a source need no task that holds a source: rows are counted
per source and hash range (``2**16`` ranges), ranges get their offsets from a
running sum of counts, and rows are numbered within their range only.

Defined cases: a null source is a source of its own; a null ``doc_id`` sorts
as the empty string; sources missing from given weights, or with weight 0, are
not scheduled: they keep null ``release``, ``deadline`` and ``slot``; the mix
ends at the slot in which the first source has no block left: blocks not taken
by then are not ``in_mix`` but are all returned, with the last slot of their
window as ``slot`` (sources may share one); equal ids are numbered in any
order; an empty table gives an empty result; input columns named like an
output column are replaced.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table, written

BLOCK_ROWS = 16
QUANTUM = 2 ** 30
STRETCH = 512
GROUP = 32
RANGE_HEX = 4
OUTPUTS = ["share", "period", "block", "block_row", "release", "deadline", "slot", "in_mix"]


def source_key(source: Column) -> Column:
    """A non-null key for a source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def integer_weights(weights: dict[str | None, float], quantum: int) -> dict[str, int]:
    """Weights above 0 as integers by key: exact if they add up to at most ``quantum``, else rounded to it."""
    given = {("" if k is None else "=" + k): Fraction(str(v)) for k, v in weights.items() if v > 0}
    if not given:
        raise ValueError("no source has a weight above 0")
    scale = Fraction(lcm(*[v.denominator for v in given.values()]))
    if sum(given.values()) * scale > quantum:
        scale = quantum / sum(given.values())
    return {k: max(1, round(v * scale)) for k, v in given.items()}


def shares(rows_per_source: DataFrame, weights: dict[str | None, float] | None, alpha: float, quantum: int) -> DataFrame:
    """``key, n, share``: integer shares in proportion to the given weights, or to ``n ** alpha``; null if not scheduled."""
    if weights is not None:
        cases = " ".join(f"WHEN {_text(k)} THEN {v}L" for k, v in integer_weights(weights, quantum).items())
        return rows_per_source.select("key", "n", F.expr(f"CASE key {cases} END").alias("share"))
    if alpha < 0:
        raise ValueError("alpha is negative")
    n = F.col("n").cast("double")
    weighted = rows_per_source.withColumn("weight", F.sqrt(n) if alpha == 0.5 else F.pow(n, F.lit(float(alpha))))
    # a sum of integers, so that it doesn't depend on the order of rows
    total = weighted.agg(F.sum(F.floor(F.col("weight") * 1024 + 0.5)).alias("total"))
    # one row against the sources: the total is a single value
    return (weighted.join(F.broadcast(total), F.lit(True), "left")
            .select("key", "n", F.greatest(F.lit(1), F.floor(F.col("weight") * F.lit(quantum * 1024.0) / F.col("total") + 0.5))
                    .cast("long").alias("share")))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def leaves(shared: DataFrame, block_rows: int) -> DataFrame:
    """``key, share, blocks, leaf``: scheduled sources numbered from 0 in the order of ``md5(key)``, by ranges of it."""
    hashed = (shared.filter("share > 0").withColumn("hash", F.md5(F.encode("key", "UTF-8")))
              .withColumn("range", F.substring("hash", 1, 3)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows
    offsets = hashed.groupBy("range").agg(F.count("*").alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("hash", "key")
    return (hashed.withColumn("nth", F.row_number().over(inside)).join(offsets, "range")
            .select("key", "share", F.expr(f"(n + {block_rows - 1}) div {block_rows}").alias("blocks"),
                    (F.col("nth") - 1 + F.col("before")).cast("long").alias("leaf")))


def _ceil(a: str, b: str) -> str:
    return f"(({a} + {b} - 1) div {b})"


def run_stretches(stretches: DataFrame, period: int) -> DataFrame:
    """``node, part, n0, slots, q, start`` with the children's counts at the ``end`` and who ``took`` each slot."""
    # of the released children the one due first (ties: the first child)
    pick = (f"array_min(transform(s.done, (d, i) -> named_struct('early', d * {period}L div q[i] > t, "
            f"'due', {_ceil(f'(d + 1) * {period}L', 'q[i]')}, 'i', i, 'turn', d)))")
    step = ("element_at(transform(array(" + pick + "), k -> named_struct("
            "'done', transform(s.done, (d, i) -> IF(i = k.i, d + 1, d)), "
            "'took', array_append(s.took, named_struct('i', k.i, 'turn', k.turn)))), 1)")
    first = "named_struct('done', start, 'took', CAST(array() AS array<struct<i:int,turn:bigint>>))"
    ran = stretches.withColumn("run", F.expr(f"aggregate(slots, {first}, (s, t) -> {step})"))
    return ran.select("node", "part", "n0", "slots", "q", "start", F.col("run.done").alias("end"), F.col("run.took").alias("took"))


def split_turns(stretches: DataFrame, children: DataFrame, period: int) -> DataFrame:
    """``node, turn, slot`` of the level below: each turn of a node goes to one child, earliest deadline first.

    ``stretches`` holds ``node, part, slots`` (``STRETCH`` successive turns),
    ``children`` the shares ``q`` of a node's children.
    """
    low = f"transform(q, x -> slots[0] * x div {period}L)"
    # children that are not at a whole count, by the deadline of the block that they are in
    due = (f"array_sort(filter(transform(q, (x, i) -> named_struct('due', {_ceil(f'(low[i] + 1) * {period}L', 'x')}, 'i', i)), "
           f"y -> slots[0] * q[y.i] % {period}L > 0))")
    ready = (stretches.join(children, "node").withColumn("n0", F.col("part") * STRETCH).withColumn("low", F.expr(low))
             .withColumn("more", F.expr("cast(greatest(0L, n0 - aggregate(low, 0L, (a, x) -> a + x)) AS int)"))
             .withColumn("ahead", F.expr(f"transform(slice({due}, 1, more), y -> y.i)"))
             .withColumn("start", F.expr("IF(part = 0, transform(q, x -> 0L), transform(low, (x, i) -> IF(array_contains(ahead, i), x + 1, x)))")))
    ran = written(run_stretches(ready, period), "mixing-level")
    while True:
        ends = ran.select("node", (F.col("part") + 1).alias("part"), F.col("end").alias("real"))
        wrong = written(ran.join(ends, ["node", "part"]).filter("start != real")
                        .select("node", "part", "n0", "slots", "q", F.col("real").alias("start")), "mixing-wrong")
        if wrong.isEmpty():
            break
        ran = written(ran.join(wrong.select("node", "part"), ["node", "part"], "left_anti").unionByName(run_stretches(wrong, period)), "mixing-level")
    return (ran.select("node", F.explode(F.arrays_zip("slots", "took")).alias("x"))
            .select((F.col("node") * GROUP + F.col("x.took.i")).alias("node"), F.col("x.took.turn").alias("turn"), F.col("x.slots").alias("slot")))


def schedule(sources: DataFrame) -> tuple[DataFrame, int]:
    """``leaf, turn, slot`` of every slot up to the one where a source must have run out, and the period.

    That is fewer than twice as many slots as there are blocks and sources.
    """
    count, period = sources.agg(F.count("*"), F.coalesce(F.sum("share"), F.lit(1))).first()
    horizon = sources.agg(F.min(F.expr(_ceil(f"(blocks + 1) * {period}L", "share")))).first()[0] or 0
    depth = 1
    while GROUP ** depth < count:
        depth += 1
    stretches = (sources.sparkSession.range(-(-horizon // STRETCH)).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("part"))
                 .withColumn("slots", F.expr(f"sequence(part * {STRETCH}, least({horizon}L, (part + 1) * {STRETCH}) - 1)")))
    for below in range(depth - 1, -1, -1):
        at = F.expr(f"leaf div {GROUP ** below}L")
        children = (sources.groupBy(at.alias("child")).agg(F.sum("share").alias("share"))
                    .groupBy(F.expr(f"child div {GROUP}L").alias("node"))
                    .agg(F.expr("transform(array_sort(collect_list(struct(child, share))), x -> x.share)").alias("q")))
        turns = split_turns(stretches, children, period)
        stretches = turns.groupBy("node", F.expr(f"turn div {STRETCH}").alias("part")).agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return turns.withColumnRenamed("node", "leaf"), period


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 1.0,
                quantum: int = QUANTUM, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id",
                source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` plus ``share, period, block, block_row, release, deadline, slot, in_mix``.

    The mixed order is ``slot, source, block, block_row``.  Weights are given
    by source, or follow the sources' row counts to the power ``alpha`` (1:
    their own shares, 0: equal).
    """
    columns = [c for c in docs.columns if c not in OUTPUTS]
    order = F.md5(F.encode(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "UTF-8"))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], source_key(F.col(f"`{source_col}`")).alias("__key"), order.alias("__order"))
    rows = rows.withColumn("__range", F.substring("__order", 1, RANGE_HEX))
    keyed = docs.select(source_key(F.col(f"`{source_col}`")).alias("key"), F.substring(order, 1, RANGE_HEX).alias("range"))
    # read by every level of the tree, so written once
    counted = written(keyed.groupBy("key", "range").agg(F.count("*").alias("n")), "mixing-ranges")
    sources = written(leaves(shares(counted.groupBy("key").agg(F.sum("n").alias("n")), weights, alpha, quantum), block_rows), "mixing-sources")
    turns, period = schedule(sources)
    plan = written(turns.join(sources, "leaf").select("key", "share", "blocks", (F.col("turn") + 1).alias("block"), "slot"), "mixing-plan")
    # the slot in which the first source has no block left
    end = plan.filter("block > blocks").agg(F.min("slot")).first()[0] or 0
    # at most 2**16 ranges a source, whatever its rows
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .withColumn("first", F.expr(f"before div {block_rows} + 1")))
    # a range's slots travel with its offset, so that rows move once
    slots = (ranges.select("key", "range", F.explode(F.expr(f"sequence(first, (before + n - 1) div {block_rows} + 1)")).alias("block"))
             .join(plan.filter(F.col("slot") < end).select("key", "block", "slot"), ["key", "block"])
             .groupBy("key", "range").agg(F.map_from_entries(F.collect_list(F.struct("block", "slot"))).alias("slots")))
    offsets = (ranges.join(slots, ["key", "range"], "left").join(sources.select("key", "share"), "key", "left")
               .select(F.col("key").alias("__key"), F.col("range").alias("__range"), F.col("before").alias("__before"),
                       "share", F.col("slots").alias("__slots")))
    inside = Window.partitionBy("__key", "__range").orderBy("__order", F.col(f"`{id_col}`"))
    placed = (rows.withColumn("__row", F.row_number().over(inside))
              .join(offsets, ["__key", "__range"])
              .withColumn("__row", F.col("__row") + F.col("__before") - 1)
              .withColumn("block", F.expr(f"__row div {block_rows} + 1"))
              .withColumn("block_row", F.expr(f"__row % {block_rows}"))
              .withColumn("period", F.expr(f"IF(share IS NULL, NULL, {period}L)"))
              .withColumn("release", F.expr("((block - 1) * period) div share"))
              .withColumn("deadline", F.expr(_ceil("block * period", "share")))
              .withColumn("in_mix", F.expr("coalesce(__slots[block] IS NOT NULL, false)"))
              .withColumn("slot", F.expr("coalesce(__slots[block], deadline - 1)")))
    return placed.select(*[F.col(f"`{c}`") for c in columns], *OUTPUTS)


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed order of all documents, sources weighted by the square root of their rows."""
    return mix_sources(table(spark, sf, "documents").select("doc_id", "source"), alpha=0.5)


# written out for up to GROUP sources
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
c AS (SELECT key, count(*) AS n FROM d GROUP BY key),
h AS (SELECT key, (n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks, row_number() OVER (ORDER BY md5(key), key) AS leaf,
        CAST(greatest(1, floor(sqrt(CAST(n AS DOUBLE)) * {QUANTUM * 1024.0} / (SELECT sum(floor(sqrt(CAST(n AS DOUBLE)) * 1024 + 0.5)) FROM c) + 0.5)) AS BIGINT) AS share FROM c),
p0 AS (SELECT CAST(sum(share) AS BIGINT) AS p, list(share ORDER BY leaf) AS q FROM h),
g AS (SELECT p, q, (SELECT min(((blocks + 1) * p0.p + share - 1) // share) FROM h) AS stop FROM p0),
e(t, done, leaf, turn) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(q, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: CASE WHEN j = k THEN x + 1 ELSE x END), k, done[k] FROM (
    SELECT t, done, list_min(list_filter(list_transform(done, lambda x, j: CASE WHEN x * p // q[j] <= t + 1
      THEN {{'due': ((x + 1) * p + q[j] - 1) // q[j], 'j': CAST(j AS BIGINT)}} END), lambda x: x IS NOT NULL)).j AS k
    FROM e, g WHERE t + 1 < stop)),
s AS (SELECT h.key, e.turn + 1 AS block, e.t AS slot, e.turn >= h.blocks AS out FROM e JOIN h ON h.leaf = e.leaf),
x AS (SELECT min(slot) AS stop FROM s WHERE out),
r AS (SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY o, doc_id) - 1 AS i FROM d),
b AS (SELECT *, i // {BLOCK_ROWS} + 1 AS block, i % {BLOCK_ROWS} AS block_row FROM r),
f AS (SELECT b.doc_id, b.source, h.share, g.p AS period, b.block, b.block_row, ((b.block - 1) * g.p) // h.share AS release,
        (b.block * g.p + h.share - 1) // h.share AS deadline, s.slot FROM b JOIN h ON h.key = b.key CROSS JOIN g CROSS JOIN x
      LEFT JOIN s ON s.key = b.key AND s.block = b.block AND s.slot < x.stop)
SELECT doc_id, source, share, period, block, block_row, release, deadline, coalesce(slot, deadline - 1) AS slot, slot IS NOT NULL AS in_mix FROM f
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {"op4_mixing": OP4_SQL}
