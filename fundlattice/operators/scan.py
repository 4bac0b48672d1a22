"""Scans over ordered rows of a code without arrays of its history: exponential means, and largest falls of sliding windows.

Rows fall into blocks. What a block adds up to is a small summary that merges with others, so a row needs its own block up
to itself and a summary or two of blocks before it. Work is linear in rows, whatever the window, and windows spill to disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of an exponential mean. Two blocks before a row's own hold all that a double can tell apart: with a weight of
#: 1/28, the slowest in use, what lies further back counts for less than 1e-32.
BLOCK = 1_024


def blocked(df: DataFrame) -> DataFrame:
    """df with _block, the block of each row: by it and i, windows of rows and exponential means share one sort."""
    return df.withColumn("_block", F.floor(F.col("i") / BLOCK))


def by_block() -> Window:
    """The rows of a code in their order, as blocked() has them."""
    return Window.partitionBy("code").orderBy("_block", "i")


def exponential_means(df: DataFrame, means: dict[str, tuple[str, int, float]]) -> DataFrame:
    """WIN-4: df (code, i, ...) with the exponential mean of a column up to each row, for each name: (column, first row, weight).

    A mean begins with its first row's value: m = v there, then m = weight * v + (1 - weight) * m. A step is an affine map, and
    steps of a block compose to one: within a block the mean is a running sum of weighted values, and what came before
    is the last mean of the block before it, faded. i counts a code's rows from 0, without gaps. A df that is blocked() stays so.
    """
    inside = Window.partitionBy("code", "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    block_before = lambda k: Window.partitionBy("code").orderBy("_block").rangeBetween(-k, -k)
    kept = "_block" in df.columns
    out = (df if kept else blocked(df)).withColumn("_place", (F.col("i") % BLOCK).cast("double"))
    fade = lambda a, n: F.pow(F.lit(1 - a), n)
    part = lambda v, first, a: F.when(F.col("i") == first, F.col(v)).when(F.col("i") > first, F.col(v) * a).otherwise(0.0)
    out = out.withColumns({f"_{n}": F.sum(part(v, first, a) * fade(a, -F.col("_place"))).over(inside) * fade(a, F.col("_place")) for n, (v, first, a) in means.items()})
    out = out.withColumns({f"_{n}_end": F.when(F.col("_place") == BLOCK - 1, F.col(f"_{n}")) for n in means})
    earlier = lambda n, a: F.coalesce(F.max(f"_{n}_end").over(block_before(1)), F.lit(0.0)) + (1 - a) ** BLOCK * F.coalesce(F.max(f"_{n}_end").over(block_before(2)), F.lit(0.0))
    out = out.withColumns({n: F.when(F.col("i") >= first, F.col(f"_{n}") + fade(a, F.col("_place") + 1) * earlier(n, a)) for n, (_, first, a) in means.items()})
    return out.drop(*([] if kept else ["_block"]), "_place", *[f"_{n}" for n in means], *[f"_{n}_end" for n in means])


def largest_falls(df: DataFrame, windows: dict[str, tuple[Column, int, Window | None]], value: str = "nav") -> DataFrame:
    """WIN-5: df (code, i, value, ...) with the largest fall from a peak to a later row, as a share of the peak, within a window.

    For each name: (position, length, frame); without a frame, of `length` rows, which needs no sort of its own. The frame of a row holds those of its code's rows whose positions (whole numbers that
    don't fall with i) are the row's own or up to length - 1 less; so do i and rows, or dates and days. Positions fall into blocks
    of that length, and a frame is the end of one block and the beginning of the next. Of both the peak or the trough and the largest fall are
    known, and merge: a fall lies in one of the two, or from the peak of the first to the trough of the second.
    """
    v = F.col(value)
    for name, (position, length, frame) in windows.items():
        block = Window.partitionBy("code", "_part").orderBy("i")
        begun, rest = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
        df = df.withColumn("_part", F.floor(position / length))
        df = df.withColumns({"_peak": F.max(v).over(begun), "_low": F.min(v).over(begun), "_later_peak": F.max(v).over(rest), "_later_low": F.min(v).over(rest)})
        df = df.withColumns({"_fall": F.max(1 - v / F.col("_peak")).over(begun), "_later_fall": F.max(1 - F.col("_later_low") / v).over(rest)})
        first = F.first(F.struct("_part", "_later_peak", "_later_fall")).over(frame or Window.partitionBy("code").orderBy("_part", "i").rowsBetween(1 - length, 0))
        df = df.withColumn("_first", first)
        both = F.greatest("_fall", F.col("_first._later_fall"), 1 - F.col("_low") / F.col("_first._later_peak"))
        df = df.withColumn(name, F.when(F.col("_first._part") == F.col("_part"), F.col("_fall")).otherwise(both))
        df = df.drop("_part", "_peak", "_low", "_later_peak", "_later_low", "_fall", "_later_fall", "_first")
    return df
