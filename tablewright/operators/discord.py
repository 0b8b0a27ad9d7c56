"""Discordant pairs of rows by a grid of strips.

Rows ``(x, y, cnt)`` of a part (at first, one column pair) are laid on a grid
of ``strips`` x-ranges and y-ranges.  Two rows that differ in both ranges are
discordant or not by their cells alone: prefix sums over the grid's cell
counts give their number.  The others meet inside one x-strip, or inside one
y-strip with different x-strips.  So every x-strip is a part again, and so is every
y-strip with the x-strip's number in place of x, where equal rows collapse.
Parts of at most ``local_rows`` distinct rows are counted in one task;
each round divides one of a part's ranges by ``strips``, so rows move about
2 log(n / local_rows) / log(strips) times.

Values may be any 64-bit integers whose range times ``strips`` stays below
2^63 (row ranks).  A part with one x or one y has no discordant pair and goes,
whatever its size.  Sums are exact integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import join_back, written

STRIPS = 1024
LOCAL_ROWS = 1_000_000


def inversions(x, y, cnt) -> int:
    """Number of pairs of counted rows with ``x_i < x_j`` and ``y_i > y_j``, in one array pass per bit of the y-rank."""
    import numpy as np

    y = np.unique(y, return_inverse=True)[1]
    order = np.argsort(x, kind="stable")
    x, y, cnt = x[order], y[order], cnt[order]
    wide = int(cnt.sum()) ** 2 >= 1 << 63
    total = 0
    for b in reversed(range(int(y.max(initial=0)).bit_length())):
        # rows stand by (y without its lower bits, x); the pairs looked at differ first at bit b
        prefix, one = y >> (b + 1), (y >> b) & 1
        ones = cnt * one
        before = np.cumsum(ones) - ones
        new = np.ones(len(y), dtype=bool)
        new[1:] = prefix[1:] != prefix[:-1]
        tie = new.copy()
        tie[1:] |= x[1:] != x[:-1]
        smaller = before[tie][np.cumsum(tie) - 1] - before[new][np.cumsum(new) - 1]
        low = one == 0
        a, c = cnt[low], smaller[low]
        total += sum(map(int.__mul__, a.tolist(), c.tolist())) if wide else int(a @ c)
        order = np.argsort(y >> b, kind="stable")
        x, y, cnt = x[order], y[order], cnt[order]
    return total


def between_cells(gx, gy, cnt) -> int:
    """The same number for rows in different x-strips and different y-strips, from cell counts."""
    import numpy as np

    grid = np.zeros((int(gx.max()) + 1, int(gy.max()) + 1), dtype=np.int64)
    grid[gx, gy] = cnt
    left = np.zeros_like(grid)  # counts of lower x-strips
    left[1:] = np.cumsum(grid, axis=0)[:-1]
    above = np.zeros_like(grid)  # of these, in higher y-strips
    above[:, :-1] = np.cumsum(left[:, ::-1], axis=1)[:, ::-1][:, 1:]
    return sum(map(int.__mul__, cnt.tolist(), above[gx, gy].tolist()))


def discordances(counts: DataFrame, strips: int = STRIPS, local_rows: int = LOCAL_ROWS) -> dict[int, int]:
    """Discordant pairs of rows per ``pair``, from written ``(pair, rx, ry, cnt)`` with distinct ``(pair, rx, ry)``."""
    def local(rows):
        import pandas as pd

        found = inversions(*(rows[c].to_numpy() for c in ("x", "y", "cnt")))
        return pd.DataFrame({"pair": rows["pair"].iloc[:1], "disc": [str(found)]})

    def between(cells):
        import pandas as pd

        found = between_cells(*(cells[c].to_numpy() for c in ("gx", "gy", "cnt")))
        return pd.DataFrame({"pair": cells["pair"].iloc[:1], "disc": [str(found)]})

    out: dict[int, int] = {}

    def add(found: DataFrame) -> None:
        for r in found.groupBy("pair").agg(F.sum(F.col("disc").cast("decimal(38,0)")).alias("disc")).collect():
            out[r["pair"]] = out.get(r["pair"], 0) + int(r["disc"])

    result = "pair bigint, disc string"
    strip = lambda v, lo, hi: F.expr(f"({v} - {lo}) * {strips} div ({hi} - {lo} + 1)")
    work = counts.select(F.col("pair").cast("bigint").alias("pair"), F.col("pair").cast("bigint").alias("part"),
                         F.col("rx").cast("bigint").alias("x"), F.col("ry").cast("bigint").alias("y"), F.col("cnt").cast("bigint").alias("cnt"))
    while True:
        # parts beyond one task's size: at most (rows / local_rows) of them
        large = (work.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("xlo"), F.max("x").alias("xhi"),
                                          F.min("y").alias("ylo"), F.max("y").alias("yhi"))
                 .where(F.col("rows") > local_rows))
        large = written(large.select(F.col("part").alias("of"), (F.row_number().over(Window.orderBy("part")) - 1).cast("bigint").alias("no"),
                                     "xlo", "xhi", "ylo", "yhi"), "discord-parts")
        n_large = large.count()
        met = join_back(work, large, F.col("part") == F.col("of"), n_large, "left") if n_large != 0 else work.withColumn("of", F.lit(None))
        add(met.where(F.col("of").isNull()).select("pair", "part", "x", "y", "cnt").groupBy("part").applyInPandas(local, result))
        if n_large == 0:
            return out
        laid = (met.where("xlo < xhi AND ylo < yhi")
                .withColumn("gx", strip("x", "xlo", "xhi")).withColumn("gy", strip("y", "ylo", "yhi")))
        add(laid.groupBy("pair", "no", "gx", "gy").agg(F.sum("cnt").alias("cnt")).groupBy("no").applyInPandas(between, result))
        name = lambda axis, at: F.col("no") * (2 * strips) + F.lit(axis * strips) + F.col(at)
        ways = F.array(F.struct(name(0, "gx").alias("part"), F.col("x").alias("x")), F.struct(name(1, "gy").alias("part"), F.col("gx").alias("x")))
        work = written(laid.select("pair", F.explode(ways).alias("w"), "y", "cnt").select("pair", "w.part", "w.x", "y", "cnt")
                       .groupBy("pair", "part", "x", "y").agg(F.sum("cnt").alias("cnt")), "discord")
