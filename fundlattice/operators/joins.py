"""As-of and forward-fill joins, holdings by quarter, baskets of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTORS = ("factor_return_1d", "factor_return_5d", "factor_return_20d", "factor_position_30d", "factor_above_ma20", "factor_volatility_20d")


def as_of_join(left: DataFrame, right: DataFrame, key: str = "code", time: str = "d", values: tuple[str, ...] = FACTORS, fill: bool = True) -> DataFrame:
    """JOIN-2, WIN-6: each left row with the last right row at or before its time.

    Both sides are united and ordered once by key and time, right rows first on ties; the last right row is carried as
    one struct, so its nulls count as nulls. With fill, a null then takes the last value seen by an earlier left
    row. One exchange, no range join; hot keys stay bounded as the window only carries one row.
    """
    packed = F.struct(*values).alias("__right")
    cols = left.columns
    a = left.select(*cols, F.lit(None).cast(right.select(packed).schema["__right"].dataType).alias("__right"), F.lit(1).alias("__side"))
    b = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], packed, F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where("__side = 1").select(*cols, *[F.col("__right")[v].alias(v) for v in values])
    if not fill:
        return out
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})


def with_factors(rows: DataFrame, panel: DataFrame, factors: DataFrame, behind: int) -> DataFrame:
    """PRD-3: rows (code, i, ...) with the factors known at the panel's row i - behind of the code, null where there are none yet."""
    known = as_of_join(panel.select("code", "d", "i"), factors).drop("d").withColumn("i", F.col("i") + behind)
    return rows.join(known, ["code", "i"], "left")


def quarter_key(text: Column) -> Column:
    """REL-4: year * 10 + quarter of a text like 2023年4季度...; 0 without one."""
    year, quarter = (F.regexp_extract(text, r"(\d{4})年(\d+)季度", k).try_cast("int") for k in (1, 2))
    return F.coalesce(year * 10 + quarter, F.lit(0))


def latest_holdings(h: DataFrame, k: int = 8) -> DataFrame:
    """REL-3 to REL-5: each fund's newest quarter, one row for each stock, the k heaviest."""
    q = h.withColumn("q", quarter_key(F.col("quarter")))
    newest = q.withColumn("newest", F.max("q").over(Window.partitionBy("fund"))).where("q = newest")
    once = newest.withColumn("rn", F.row_number().over(Window.partitionBy("fund", "stock").orderBy(F.desc("weight_pct")))).where("rn = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("weight_pct"), "stock"))).where(F.col("rank") <= k).select("fund", "stock", "q", "weight_pct", "rank")


def baskets(top: DataFrame, prices: DataFrame, least_stocks: int = 2) -> DataFrame:
    """INC-10, JOIN-1: weighted sum of prices rebased to each stock's first value: fund, d, factor_nav.

    Prices stay long: on every date of any of the fund's stocks each stock carries its last price forward. Weights
    are shares of the sum over stocks that have prices; all equal where they sum to nothing.
    """
    known = top.join(prices.select("stock").distinct(), "stock", "left_semi")
    total = F.sum("weight_pct").over(Window.partitionBy("fund"))
    count = F.count("*").over(Window.partitionBy("fund"))
    weighted = known.select("fund", "stock", F.when(total > 0, F.col("weight_pct") / total).otherwise(1.0 / count).alias("w"), count.alias("n")).where(F.col("n") >= least_stocks).drop("n")
    own = weighted.join(prices, "stock")
    dates = own.select("fund", "d").distinct()
    grid = dates.join(weighted, "fund").join(own.select("fund", "stock", "d", "close"), ["fund", "stock", "d"], "left")
    w = Window.partitionBy("fund", "stock").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumns({"last": F.last("close", ignorenulls=True).over(w), "first": F.first("close", ignorenulls=True).over(w)})
    return filled.groupBy("fund", "d").agg(F.sum(F.col("last") / F.col("first") * F.col("w")).alias("factor_nav")).where("factor_nav is not null")


def basket_features(b: DataFrame, key: str = "fund") -> DataFrame:
    """INC-9: returns, position, moving average and volatility of a basket, with at least 5 rows in a frame."""
    w = Window.partitionBy(key).orderBy("d")
    nav = F.col("factor_nav")
    frame = lambda n: w.rowsBetween(-(n - 1), 0)
    enough = lambda n: F.count("factor_nav").over(frame(n)) >= 5
    out = b.withColumn("r", nav / F.lag("factor_nav").over(w) - 1)
    low, high = F.min("factor_nav").over(frame(30)), F.max("factor_nav").over(frame(30))
    return out.select(
        key, "d",
        *[((nav / F.lag("factor_nav", k).over(w) - 1) * 100).alias(f"factor_return_{k}d") for k in (1, 5, 20)],
        F.when(enough(30) & (high > low), (nav - low) / (high - low) * 100).otherwise(50.0).alias("factor_position_30d"),
        F.when(enough(20) & (nav >= F.avg("factor_nav").over(frame(20))), 1.0).otherwise(0.0).alias("factor_above_ma20"),
        F.when(F.count("r").over(frame(20)) >= 5, F.stddev_samp("r").over(frame(20)) * F.sqrt(F.lit(252.0)) * 100).alias("factor_volatility_20d"),
    )


def outer_prices(prices: DataFrame, stocks: list[str]) -> DataFrame:
    """JOIN-1 as a table: one row for each date of any price, a column for each stock, filled forward.

    Prices are filled while they are long, by stock, and then turned; no chain of joins and no window over all dates.
    """
    grid = prices.select("d").distinct().withColumn("stock", F.explode(F.array(*map(F.lit, stocks))))
    w = Window.partitionBy("stock").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(prices, ["stock", "d"], "left").withColumn("close", F.last("close", ignorenulls=True).over(w))
    return filled.groupBy("d").agg(*[F.max(F.when(F.col("stock") == s, F.col("close"))).alias(s) for s in stocks])


def positional_join(left: DataFrame, right: DataFrame, key: str = "code", time: str = "d") -> DataFrame:
    """JOIN-3: the n-th row of each key with the n-th row of the other side."""
    w = Window.partitionBy(key).orderBy(time)
    return left.withColumn("__n", F.row_number().over(w)).join(right.withColumn("__n", F.row_number().over(w)).drop(time), [key, "__n"], "left").drop("__n")
