"""Any page of a sorted table without sorting the pages before it.

``offset`` keeps all earlier rows of the order in one task.  A :class:`PageIndex` holds borders in the sort order and the
number of rows between them, as a tree: a node is cut at the quantiles of a bounded sample of its keys and its parts
are counted in one pass (map-side combined).  A page walks down to the leaves that hold its positions, and only their
rows, found by a filter on the sort columns, are sorted.  Nodes are cut when a page first needs them and kept for the
next one, so a page costs two passes over ever smaller ranges for each level, and nothing once they are known.

The order is the given columns (nulls first when ascending, last when descending, as Spark sorts) and then a hash of the
whole row, so rows that tie stand in the same order on every page and a tie group of any size is cut like other rows;
rows equal in every column can't be told apart.  The driver holds ``FAN`` borders for each node that was cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol

#: Rows that a leaf may hold, which is what a page sorts.
LEAF_ROWS = 100_000
#: Parts of a node, and sampled keys for each part.
FAN, SAMPLED = 64, 32


@dataclass
class _Node:
    low: tuple | None
    high: tuple | None
    before: int
    rows: int
    parts: list[_Node] | None = None
    whole: bool = field(default=False)  # one key only: can't be cut


class PageIndex:
    """Lazy index over ``df`` in the order of ``order_by``."""

    def __init__(self, df: DataFrame, order_by: Sequence[str], descending: Sequence[bool] | None = None, leaf_rows: int = LEAF_ROWS):
        self.df, self.leaf_rows = df, leaf_rows
        self.names = [*order_by, "__page_row"]
        self.down = [*(descending or [False] * len(order_by)), False]
        plain = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
        self.keyed = df.withColumn("__page_row", F.xxhash64(*[qcol(c) for c in plain]))
        self.order = [qcol(c).desc() if d else qcol(c).asc() for c, d in zip(self.names, self.down, strict=True)]
        self.root = _Node(None, None, 0, -1)
        self.passes = 0

    def _literal(self, k: int, value: object) -> Column:
        kind = self.keyed.schema[self.names[k]].dataType
        return F.lit(str(value)).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(value)

    def _under(self, border: tuple) -> Column:
        """Whether a row stands before a border."""
        out = F.lit(False)
        for k in range(len(border) - 1, -1, -1):
            c, down = qcol(self.names[k]), self.down[k]
            if border[k] is None:
                less, equal = (c.isNotNull() if down else F.lit(False)), c.isNull()
            else:
                b = self._literal(k, border[k])
                less = F.coalesce(c > b, F.lit(False)) if down else F.coalesce(c < b, F.lit(True))
                equal = c.eqNullSafe(b)
            out = less | (equal & out)
        return out

    def _between(self, low: tuple | None, high: tuple | None) -> DataFrame:
        rows, name = self.keyed, qcol(self.names[0])
        for border, first in ((low, True), (high, False)):
            if border is None:
                continue
            rows = rows.where(~self._under(border) if first else self._under(border))
            b = border[0]
            if b is not None:  # the same on the first column alone, which a scan can use
                b = self._literal(0, b)
                rows = rows.where(name >= b if self.down[0] == (not first) else (name <= b) | name.isNull())
        return rows

    def _cut(self, node: _Node) -> None:
        rows = self._between(node.low, node.high)
        if node.rows < 0:
            node.rows = rows.count()
            self.passes += 1
            if node.rows <= self.leaf_rows:
                return
        chance = F.xxhash64(F.lit(17), *[qcol(c) for c in self.names])
        sample = (rows.select(*[qcol(c) for c in self.names]).orderBy(chance).limit(FAN * SAMPLED)
                  .orderBy(*self.order).collect())
        borders: list[tuple] = []
        for k in range(SAMPLED, len(sample), SAMPLED):
            b = tuple(sample[k])
            if b != tuple(sample[0]) and (not borders or b != borders[-1]):
                borders.append(b)
        self.passes += 1
        if not borders:
            node.whole = True
            return

        def part(lo: int, hi: int) -> Column:  # binary search among the borders
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(self._under(borders[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

        counts = {r["part"]: r["count"] for r in rows.groupBy(part(0, len(borders)).alias("part")).count().collect()}
        self.passes += 1
        ends = [node.low, *borders, node.high]
        node.parts, before = [], node.before
        for k in range(len(borders) + 1):
            node.parts.append(_Node(ends[k], ends[k + 1], before, counts.get(k, 0)))
            before += counts.get(k, 0)

    def _leaf(self, position: int) -> _Node:
        node = self.root
        while True:
            if node.parts is None and not node.whole and (node.rows < 0 or node.rows > self.leaf_rows):
                self._cut(node)
            if node.parts is None:
                return node
            node = next((p for p in node.parts if p.before <= position < p.before + p.rows), node.parts[-1])

    def rows(self, start: int, size: int) -> DataFrame:
        """Rows ``start`` to ``start + size - 1`` of the order."""
        first = last = self._leaf(start)
        if start >= self.root.rows:
            return self.df.limit(0)
        while last.before + last.rows < min(start + size, self.root.rows):
            last = self._leaf(last.before + last.rows)
        held = self._between(first.low, last.high)
        return held.orderBy(*self.order).offset(start - first.before).limit(size).drop("__page_row")

    def page(self, page: int, page_size: int = 15) -> DataFrame:
        return self.rows((page - 1) * page_size, page_size)


def searched(df: DataFrame, search: str) -> DataFrame:
    """Rows in which any column's text holds ``search``, whatever the case."""
    hits = [F.coalesce(F.lower(qcol(c).cast("string")).contains(search.lower()), F.lit(False)) for c in df.columns]
    return df.where(reduce(Column.__or__, hits, F.lit(False)))


def page_table(df: DataFrame, *, search: str | None = None, order_by: list[str] | None = None, descending: list[bool] | None = None,
               page: int = 1, page_size: int = 15, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One page of a table: free-text search over all columns, sort, offset and limit.

    A page that ends within ``leaf_rows`` rows is a top-k; a deeper one goes through a :class:`PageIndex`, which readers
    of many pages make once.  Both use the same order, ties included.
    """
    out = searched(df, search) if search else df
    start = (page - 1) * page_size
    if not order_by:
        return out.offset(start).limit(page_size)
    index = PageIndex(out, order_by, descending, leaf_rows)
    if start + page_size <= leaf_rows:
        return index.keyed.orderBy(*index.order).offset(start).limit(page_size).drop("__page_row")
    return index.page(page, page_size)
