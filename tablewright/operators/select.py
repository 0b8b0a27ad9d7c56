"""Exact order statistics by selection: brackets from a sketch, then one counting pass.

Ranking a whole column to read off a few quantiles moves (and writes) every distinct value.  Selection moves almost
nothing:

1. ``percentile_approx`` gives, for every wanted position, two values that bracket it (its rank error is bounded, and
   the brackets are several errors wide).  All columns share one aggregation.
2. One counting pass: a value inside a bracket is counted under itself, all others under the gap between two brackets
   they lie in.  Map-side combining leaves a few rows per column and task; a window over these *cells*, ordered by
   each cell's least value, gives the exact number of rows before every bracketed value.
3. Brackets still expected to hold more than ``MOVE_ROWS`` rows are narrowed first, by a sketch of the rows inside them
   (about 250-fold a pass), so the cells of a column stay bounded however long it is.

The counts prove the result: a wanted position that falls into a gap (the sketch was worse than promised) sends its
column to the full ranking.  Nothing is written, and nothing depends on how rows are partitioned, as only the width of
the brackets does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol

#: Rank error of the sketch is ``1 / ACCURACY`` of the rows; brackets reach ``SLACK`` errors to both sides.
ACCURACY = 10_000
SLACK = 2
#: Rows that a bracket may be expected to hold in the counting pass.
MOVE_ROWS = 1_000_000
GRID = 1_000
#: columns per aggregation, so that generated code stays compiled
BATCH = 40



class MissedError(LookupError):
    """A wanted position lies outside the brackets of the sketch."""


Bracket = tuple[object, object]


def _rough(v: object, side: int) -> object:
    """A sketched value moved outwards by its rounding: the sketch holds whole numbers as doubles."""
    return v + side * (abs(v) >> 52) if isinstance(v, int) else v


def _sketched(df: DataFrame, values: Sequence[Column], probs: Sequence[float], more: Sequence[Sequence[Column]] = ()) -> list[dict]:
    """Per value column: rows ``n``, least and greatest value, a bracket for each probability, and the results of ``more``."""
    reach = SLACK / ACCURACY
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-reach, reach)]
    out = []
    for at in range(0, len(values), BATCH):
        part = range(at, min(at + BATCH, len(values)))
        aggs = [a.alias(f"{k}_{i}") for i in part for k, a in enumerate(
            [F.count(values[i]), F.min(values[i]), F.max(values[i]), F.percentile_approx(values[i], ends, ACCURACY), *(more[i] if more else ())])]
        row = df.agg(*aggs).first()
        for i in part:
            n, lo, hi, marks = (row[f"{k}_{i}"] for k in range(4))
            brackets = [(lo if p - reach <= 0 else _rough(marks[2 * j], -1), hi if p + reach >= 1 else _rough(marks[2 * j + 1], 1))
                        for j, p in enumerate(probs)] if n else []
            out.append({"n": n, "lo": lo, "hi": hi, "brackets": brackets, "more": [row[f"{4 + k}_{i}"] for k in range(len(more[i]))] if more else []})
    return out


def _narrowed(df: DataFrame, value: Column, found: dict, wanted: Sequence[tuple[int, int]]) -> None:
    """Narrow the brackets of one long column in place until each holds about ``MOVE_ROWS`` rows (or one value)."""
    held = [found["n"] * 2 * SLACK / ACCURACY] * len(wanted)
    for _ in range(8):
        wide = [j for j, (a, b) in enumerate(found["brackets"]) if held[j] > MOVE_ROWS and a != b]
        if not wide:
            return
        grid, aggs = [k / GRID for k in range(GRID + 1)], []
        for j in wide:
            a, b = found["brackets"][j]
            inside = F.when((value >= F.lit(a)) & (value <= F.lit(b)), value)
            aggs += [F.count_if(value < F.lit(a)).alias(f"below{j}"), F.count(inside).alias(f"n{j}"), F.percentile_approx(inside, grid, ACCURACY).alias(f"at{j}")]
        row = df.agg(*aggs).first()
        for j in wide:
            below, n, marks = row[f"below{j}"], row[f"n{j}"], row[f"at{j}"]
            first, last = wanted[j][0] - below, wanted[j][1] - below
            if first < 0 or last >= n:  # the sketch was worse than promised
                found["brackets"][j], held[j] = (found["lo"], found["hi"]), found["n"]
                continue
            low, high = math.floor(first * GRID / n) - 1, math.ceil(last * GRID / n) + 1
            a, b = found["brackets"][j]
            found["brackets"][j] = (_rough(marks[low], -1) if low > 0 else a, _rough(marks[high], 1) if high < GRID else b)
            held[j] = n * (high - low) / GRID


def _merged(brackets: Sequence[Bracket]) -> list[Bracket]:
    out: list[Bracket] = []
    for a, b in sorted(brackets):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def literal(v: object) -> str:
    """SQL text of a bracket end (numbers only)."""
    if isinstance(v, float):
        return f"double('{v!r}')"
    return f"{v}BD" if isinstance(v, Decimal) else f"{v}L"


def _cell(x: str, brackets: Sequence[Bracket]) -> str:
    """Odd inside a bracket, even in a gap, growing with the value: a binary search as SQL text (one call to the JVM)."""

    def place(lo: int, hi: int) -> str:  # brackets lo to hi - 1
        if lo == hi:
            return str(2 * lo)
        mid = (lo + hi) // 2
        a, b = brackets[mid]
        return f"CASE WHEN {x} < {literal(a)} THEN {place(lo, mid)} WHEN {x} <= {literal(b)} THEN {2 * mid + 1} ELSE {place(mid + 1, hi)} END"

    return place(0, len(brackets))


def counted_cells(df: DataFrame, values: Sequence[Column], brackets: Sequence[Sequence[Bracket]], tags: Sequence[Column] = ()) -> DataFrame:
    """Cells ``(i, value, inside, tag, cnt, before)`` of every value column ``i``.

    A bracketed value is a cell of its own; a gap is one cell whose ``value`` is the gap's least.  ``tags`` (integers
    that never fall as the value grows) cut gaps further.
    """
    flat = df.select(*[x.alias(f"x{i}") for i, x in enumerate(values)], *[t.cast("int").alias(f"t{i}") for i, t in enumerate(tags)])
    whole = [f"struct({i} AS i, {_cell(f'x{i}', _merged(b))} AS cell, x{i} AS x, {f't{i}' if tags else '0'} AS tag)" for i, b in enumerate(brackets)]
    rows = flat.selectExpr(f"inline(array({', '.join(whole)}))").where("x IS NOT NULL")
    inside = F.col("cell") % 2 == 1
    cells = rows.groupBy("i", "cell", "tag", F.when(inside, F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("cnt"), F.min("x").alias("value"))
    order = Window.partitionBy("i").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("i", "value", inside.alias("inside"), "tag", "cnt", F.coalesce(F.sum("cnt").over(order), F.lit(0)).alias("before"))


def type7(n: int, p: float) -> tuple[int, int, float]:
    """Positions and weight of the type-7 quantile among ``n`` ordered values."""
    h = (n - 1) * float(p)
    return math.floor(h), math.ceil(h), h - math.floor(h)


def _picked(cells: list, n: int, p: float) -> float | None:
    """The quantile from a column's collected cells; None if a position lies in a gap."""
    lo, hi, share = type7(n, p)
    at = [next((r["value"] for r in cells if r["before"] <= k < r["before"] + r["cnt"] and r["inside"]), None) for k in (lo, hi)]
    return None if None in at else at[0] + share * (at[1] - at[0])


def selected(df: DataFrame, cols: Sequence[str], probs: Sequence[float], more: Sequence[Sequence[Column]] = (), bins: int = 0) -> dict[str, dict]:
    """Type-7 quantiles of whole columns: ``{column: {n, lo, hi, q, more, bins}}``.

    ``q`` holds one quantile per probability (None without values), ``more`` further aggregates made in the first pass,
    and ``bins`` counts of equal-width bins over the range, made in the second.
    """
    from .rank import ranked_quantiles

    if not cols:
        return {}
    values = [qcol(c).cast("double") for c in cols]
    found = _sketched(df, values, probs, more)
    for x, f in zip(values, found, strict=True):
        if f["n"]:
            _narrowed(df, x, f, [type7(f["n"], p)[:2] for p in probs])
    tags = []
    for x, f in zip(values, found, strict=True):
        width = (f["hi"] - f["lo"]) / bins if bins and f["n"] and f["hi"] > f["lo"] else 1.0
        tags.append(F.least(F.floor((x - F.lit(f["lo"])) / F.lit(width)), F.lit(bins - 1)) if bins and f["n"] else F.lit(0))
    kept: dict[int, list] = {}
    counts: dict[int, dict[int, int]] = {}
    for at in range(0, len(cols), BATCH):
        part = slice(at, at + BATCH)
        cells = counted_cells(df, values[part], [f["brackets"] for f in found[part]], tags[part])
        # positions wanted: at most two for each probability
        ranks = [(i, k) for i, f in enumerate(found[part]) if f["n"] for p in probs for k in type7(f["n"], p)[:2]]
        wanted = F.expr(" OR ".join(f"(i = {i} AND before <= {k}L AND before + cnt > {k}L)" for i, k in sorted(set(ranks))) or "false")
        if bins:
            whole = cells.groupBy("i", "tag").agg(F.sum("cnt").alias("cnt"), F.collect_list(F.when(wanted, F.struct("value", "inside", "before", "cnt"))).alias("hits"))
            for r in whole.collect():
                counts.setdefault(at + r["i"], {})[r["tag"]] = r["cnt"]
                kept.setdefault(at + r["i"], []).extend(r["hits"])
        else:
            for r in cells.where(wanted).collect():
                kept.setdefault(at + r["i"], []).append(r)
    out = {}
    for i, (c, f) in enumerate(zip(cols, found, strict=True)):
        q = [_picked(kept.get(i, []), f["n"], p) if f["n"] else None for p in probs]
        out[c] = {"n": f["n"], "lo": f["lo"], "hi": f["hi"], "q": q, "more": f["more"], "bins": [counts.get(i, {}).get(k, 0) for k in range(bins)]}
    lost = [c for c in cols if out[c]["n"] and None in out[c]["q"]]
    if lost:
        for r in ranked_quantiles(df, lost, probs).collect():
            out[r["column"]]["q"] = [r[f"q{k}"] for k in range(len(probs))]
    return out


def block_starts(df: DataFrame, value: Column, n_known: int, total: int, blocks: int) -> list[tuple[int, object]]:
    """``(block, first value)`` where rows in value order are cut into ``blocks`` of ``total`` rows and equal values stay together.

    A block's first value is the one at its first position, or else the next greater one: a bracketed value or the
    least value of the gap that follows, hence always the start of a cell.
    """
    if not n_known:
        return []
    first = [-(-b * total // blocks) for b in range(blocks)]
    wanted = [(k, k) for k in first if k < n_known]
    (found,) = _sketched(df, [value], [k / max(1, n_known - 1) for k, _ in wanted])
    _narrowed(df, value, found, wanted)
    cells = counted_cells(df, [value], [found["brackets"]])
    rows = cells.groupBy(F.floor(F.col("before") * F.lit(blocks) / F.lit(total)).cast("long").alias("block")).agg(
        F.min(F.struct("before", "value")).alias("first"),
        F.collect_list(F.when(~F.col("inside"), F.struct(F.col("before"), (F.col("before") + F.col("cnt")).alias("end")))).alias("gaps")).collect()
    gaps = [g for r in rows for g in r["gaps"]]
    if any(g["before"] < k < g["end"] for k, _ in wanted for g in gaps):
        raise MissedError("a bracket missed its position")
    return sorted((r["block"], r["first"]["value"]) for r in rows)
