"""Column helpers: safe numbers, clamps, folds over arrays, ordered decision tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The rows that an exponential mean can tell apart: with a weight of 1/28, the slowest in use, a row so far back counts for
#: less than 1e-23 of the mean, which a double does not show.
EXACT_ROWS = 1_500


def safe_double(col: Column | str, default: float | None = 0.0) -> Column:
    """The value as a finite double, else default (null if None)."""
    x = F.col(col) if isinstance(col, str) else col
    x = x.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ema(values: Column, span: float) -> Column:
    """The last exponential mean of an array, begun with its first element."""
    a = 2 / (span + 1)
    return F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), lambda s, v: F.lit(a) * v + F.lit(1 - a) * s)


def wilder(values: Column, window: int) -> Column:
    a = 1.0 / window
    return F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), lambda s, v: F.lit(a) * v + F.lit(1 - a) * s)


def max_drawdown(values: Column) -> Column:
    """The largest fall from a running peak, as a share of the peak."""
    start = F.struct(F.element_at(values, 1).alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc: Column, v: Column) -> Column:
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.greatest(acc["dd"], (peak - v) / peak).alias("dd"))

    return F.aggregate(values, start, step, lambda acc: acc["dd"])


def macd_states(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """(dif, dea) of the last three bars, newest first, from one fold: array of structs."""
    first = F.element_at(values, 1)
    zero = F.struct(F.lit(0.0).alias("dif"), F.lit(0.0).alias("dea"))
    start = F.struct(first.alias("f"), first.alias("s"), F.lit(0.0).alias("dea"), F.array(zero, zero, zero).alias("last"))

    def step(acc: Column, v: Column) -> Column:
        f = v * (2 / (fast + 1)) + acc["f"] * (1 - 2 / (fast + 1))
        s = v * (2 / (slow + 1)) + acc["s"] * (1 - 2 / (slow + 1))
        dea = (f - s) * (2 / (signal + 1)) + acc["dea"] * (1 - 2 / (signal + 1))
        now = F.struct((f - s).alias("dif"), dea.alias("dea"))
        return F.struct(f.alias("f"), s.alias("s"), dea.alias("dea"), F.array(now, acc["last"][0], acc["last"][1]).alias("last"))

    return F.aggregate(F.slice(values, 2, F.size(values)), start, step, lambda acc: acc["last"])


def first_distinct(values: Column, most: int) -> Column:
    """The first elements of an array, each once, at most so many."""
    return F.slice(F.array_distinct(values), 1, most)


def first_true(*rules: tuple[Column, object], otherwise: object) -> Column:
    """An ordered decision table: the value of the first condition that holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def round_half_up(x: Column, places: int) -> Column:
    """floor(x 10^n + 1/2) / 10^n, which every engine computes alike."""
    return F.floor(x * 10**places + 0.5) / 10**places
