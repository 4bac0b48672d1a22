"""Indicators of a panel (code, d, nav, i, r) as of every row.

Three families differ on purpose: calendar ("_a", frames of days, null where history is short), trading ("_b",
frames of rows, neutral defaults) and short-term ("_c"). All frames are bounded and share one exchange by code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlattice.functions.numeric import EXACT_ROWS, macd_states, wilder
from fundlattice.operators.scan import largest_falls

YEAR = 250.0


def in_order() -> Window:
    return Window.partitionBy("code").orderBy("d")


def rows(n: int, end: int = 0) -> Window:
    """The last n rows, up to the row `end` before this."""
    return in_order().rowsBetween(-(n - 1) - end, -end)


def days(n: int) -> Window:
    """Rows of the last n days, both ends included."""
    return Window.partitionBy("code").orderBy(F.unix_date("d")).rangeBetween(-n, 0)


def _or_tail(n: int, least: int, build) -> Column:
    """build(frame) over n days, or over the last max(least, n // 2) rows where the days hold fewer than least."""
    return F.when(F.count("nav").over(days(n)) < least, build(rows(max(least, n // 2)))).otherwise(build(days(n)))


def lagged(k: int) -> Column:
    return F.lag("nav", k).over(in_order())


def returns_trading(p: DataFrame) -> DataFrame:
    """IND-10, INB-2: returns over k rows; "_a" falls back to the oldest row, "_b" to 0."""
    out = p
    for k in (1, 5, 10, 20, 60):
        oldest = F.first("nav").over(rows(k + 1))
        out = out.withColumn(f"ret_{k}_a", F.when(F.col("i") >= 1, (F.col("nav") / oldest - 1) * 100))
        out = out.withColumn(f"ret_{k}_b", F.when(F.col("i") >= k, (F.col("nav") / lagged(k) - 1) * 100).otherwise(0.0))
    return out.drop("r", "nav")


def as_of(n: int, col: str = "nav") -> Column:
    """JOIN-4: the value of the last row at least n days ago."""
    return F.last(col).over(Window.partitionBy("code").orderBy(F.unix_date("d")).rangeBetween(Window.unboundedPreceding, -n))


def returns_calendar(p: DataFrame, periods=(7, 30, 60, 90), col: str = "nav") -> DataFrame:
    """IND-2: returns of a column since the last row at least n days ago, with that row's date."""
    out = p
    for n in periods:
        start = as_of(n, col)
        out = out.withColumn(f"start_{n}", F.when(F.col("i") >= 2, as_of(n, "d"))).withColumn(f"ret_{n}", F.when((F.col("i") >= 2) & (start != 0), (F.col(col) - start) / start * 100))
    return out.drop("r", "nav")


def ma(k: int) -> Column:
    return F.when(F.col("i") >= k - 1, F.avg("nav").over(rows(k)))


def sma_trend(p: DataFrame) -> DataFrame:
    """IND-18, IND-19: moving averages and the trend label of family a."""
    out = p.select("code", "d", "i", "nav", *[ma(k).alias(f"ma_{k}") for k in (5, 10, 20, 60)])
    nav, m5, m10, m20, m60 = (F.col(c) for c in ("nav", "ma_5", "ma_10", "ma_20", "ma_60"))
    trend = (
        F.when(F.col("i") < 29, "数据不足，无法判断趋势")
        .when((nav > m5) & (m5 > m10) & (m10 > m20) & (m20 > m60), "多头排列（上升趋势）")
        .when((nav < m5) & (m5 < m10) & (m10 < m20) & (m20 < m60), "空头排列（下降趋势）")
        .when((nav > m20) & (m5 > m20), "偏多震荡")
        .when((nav < m20) & (m5 < m20), "偏空震荡")
        .otherwise("横盘整理")
    )
    return out.withColumn("trend", trend).drop("nav")


def trend_b_label(nav: Column, m5: Column, m10: Column, m20: Column, m60: Column) -> Column:
    """INB-4: the trend label of family b, from averages rounded to four places."""
    all4 = m5.isNotNull() & m10.isNotNull() & m20.isNotNull() & m60.isNotNull()
    return (
        F.when(all4 & (m5 > m10) & (m10 > m20) & (m20 > m60) & (nav > m5), "多头排列")
        .when(all4 & (m5 < m10) & (m10 < m20) & (m20 < m60) & (nav < m5), "空头排列")
        .when(all4 & (m5 > m10) & (m20 > m60), "偏多震荡")
        .when(all4 & (m5 < m10) & (m20 < m60), "偏空震荡")
        .when((m5 > m10) & (nav > m5), "偏多震荡")
        .when((m5 < m10) & (nav < m5), "偏空震荡")
        .otherwise("横盘整理")
    )


def four_places(x: Column) -> Column:
    return F.floor(x * 1e4 + 0.5) / 1e4


def trend_b(p: DataFrame) -> DataFrame:
    """INB-3, INB-4."""
    out = p.select("code", "d", "i", "nav", *[four_places(ma(k)).alias(f"ma_{k}") for k in (5, 10, 20, 60)])
    return out.withColumn("trend", trend_b_label(*(F.col(c) for c in ("nav", "ma_5", "ma_10", "ma_20", "ma_60")))).drop("nav")


def vol_windows(p: DataFrame) -> DataFrame:
    """IND-4, IND-5, WIN-2: annual volatility and downside volatility over calendar days."""
    out = p
    negative = F.when(F.col("r") < 0, F.col("r"))
    for n in (30, 60, 90):
        enough = _or_tail(n, 5, lambda f: F.count("r").over(f)) >= 3
        out = out.withColumn(f"vol_{n}", F.when(enough, _or_tail(n, 5, lambda f: F.stddev_samp("r").over(f)) * F.sqrt(F.lit(YEAR)) * 100))
        if n < 90:
            few = _or_tail(n, 5, lambda f: F.count(negative).over(f)) < 2
            value = F.when(few, 0.0).otherwise(_or_tail(n, 5, lambda f: F.stddev_samp(negative).over(f)) * F.sqrt(F.lit(YEAR)) * 100)
            out = out.withColumn(f"down_{n}", F.when(enough, value))
    return out.drop("r", "nav")


def drawdown_calendar(p: DataFrame) -> DataFrame:
    """IND-3: the largest fall within n days, as a negative percentage; within some rows where the days hold fewer than three."""
    spans = (7, 30, 60, 90)
    windows = {f"_days_{n}": (F.unix_date("d"), n + 1, days(n)) for n in spans} | {f"_rows_{n}": (F.col("i"), max(3, n // 2), rows(max(3, n // 2))) for n in spans}
    out = largest_falls(p, windows)
    out = out.withColumns({f"dd_{n}": F.when(F.count("nav").over(days(n)) < 3, F.col(f"_rows_{n}")).otherwise(F.col(f"_days_{n}")) * -100 for n in spans})
    return out.drop("r", "nav", *windows)


def drawdown_trading(p: DataFrame) -> DataFrame:
    """IND-11 (negative, null below three rows) and INB-5 (positive, 0 below two)."""
    out = largest_falls(p, {f"_{n}": (F.col("i"), n, rows(n)) for n in (5, 6, 20, 21, 40, 60, 61)})
    a = {f"dd_{n - 1}_a": F.when(F.col("i") >= 2, F.col(f"_{n}") * -100) for n in (6, 21, 61)}
    b = {f"dd_{n}_b": F.when(F.col("i") >= 1, F.col(f"_{n}") * 100).otherwise(0.0) for n in (5, 20, 40, 60)}
    return out.withColumns(a | b).drop("r", "nav", *[f"_{n}" for n in (5, 6, 20, 21, 40, 60, 61)])


def _position(f: Window) -> Column:
    low, high = F.min("nav").over(f), F.max("nav").over(f)
    return F.when(high == low, 50.0).otherwise((F.col("nav") - low) / (high - low) * 100)


def range_position(p: DataFrame) -> DataFrame:
    """IND-6, INB-9: where the value stands between the lowest and the highest."""
    out = p
    for n in (7, 30, 60, 90):
        out = out.withColumn(f"pos_{n}_a", _or_tail(n, 5, _position))
    for n in (5, 20, 40, 60):
        out = out.withColumn(f"pos_{n}_b", F.when(F.col("i") >= 1, _position(rows(n))).otherwise(50.0))
    return out.drop("r", "nav")


def rebound_pullback(p: DataFrame) -> DataFrame:
    """IND-7, INB-10: rise from the low and fall from the high of a frame."""
    out = p
    up = lambda f: (F.col("nav") - F.min("nav").over(f)) / F.min("nav").over(f) * 100
    down = lambda f: (F.max("nav").over(f) - F.col("nav")) / F.max("nav").over(f) * 100
    for n in (7, 30):
        enough = F.count("nav").over(days(n)) >= 5
        out = out.withColumn(f"rebound_{n}_a", F.when(enough, up(days(n)))).withColumn(f"pullback_{n}_a", F.when(enough, down(days(n))))
    for n in (5, 20):
        out = out.withColumn(f"rebound_{n}_b", F.when(F.col("i") >= 1, up(rows(n))).otherwise(0.0)).withColumn(f"pullback_{n}_b", F.when(F.col("i") >= 1, down(rows(n))).otherwise(0.0))
    return out.drop("r", "nav")


def sharpe_calmar(p: DataFrame) -> DataFrame:
    """IND-8, IND-9, INB-19."""
    windows = {f"_days_{n}": (F.unix_date("d"), n + 1, days(n)) for n in (60, 90)} | {f"_rows_{n}": (F.col("i"), n // 2, rows(n // 2)) for n in (60, 90)} | {f"_b_{n}": (F.col("i"), n, rows(n)) for n in (40, 60)}
    out = largest_falls(p, windows)
    for n in (30, 60):
        mean, std = (_or_tail(n, 5, lambda f, g=g: g("r").over(f)) for g in (F.avg, F.stddev_samp))
        enough = _or_tail(n, 5, lambda f: F.count("r").over(f)) >= 5
        out = out.withColumn(f"sharpe_{n}_a", F.when(enough, F.when(std == 0, 0.0).otherwise(mean / std * F.sqrt(F.lit(YEAR)))))
    for n in (60, 90):
        dd = F.when(F.count("nav").over(days(n)) < 3, F.col(f"_rows_{n}")).otherwise(F.col(f"_days_{n}"))
        enough = _or_tail(n, 5, lambda f: F.count("r").over(f)) >= 3
        out = out.withColumn(f"calmar_{n}_a", F.when(enough & (dd > 0), F.abs(_or_tail(n, 5, lambda f: F.avg("r").over(f)) * YEAR / dd)))
    for n in (40, 60):
        dd = F.col(f"_b_{n}") * 100
        out = out.withColumn(f"calmar_{n}_b", F.when((F.col("i") >= 2) & (dd > 0), F.avg("r").over(rows(n)) * YEAR * 100 / dd).otherwise(0.0))
    return out.drop("r", "nav", *windows)


def win_rate_stats(p: DataFrame) -> DataFrame:
    """IND-12, IND-13, INB-21 over rows with a return."""
    out = p
    positive, negative = F.count_if(F.col("r") > 0), F.count_if(F.col("r") < 0)
    for n in (20, 60):
        f = rows(n)
        out = out.withColumn(f"win_{n}", F.when(F.count("r").over(f) >= 3, positive.over(f) / F.count("r").over(f) * 100))
    f = rows(20)
    enough = F.count("r").over(f) >= 3
    for name, g in (("mean", F.avg), ("max", F.max), ("min", F.min)):
        out = out.withColumn(f"day_{name}", F.when(enough, g("r").over(f) * 100))
    return out.withColumn("up_days", F.when(enough, positive.over(f))).withColumn("down_days", F.when(enough, negative.over(f))).drop("r", "nav")


def momentum_accel(p: DataFrame) -> DataFrame:
    """IND-14 (5 against 5 rows), INB-15 (2 against 2), INC-7 (3 against 3)."""
    nav, at = F.col("nav"), lagged
    return p.select(
        "code", "d", "i",
        F.when(F.col("i") >= 10, ((nav / at(5) - 1) - (at(5) / at(10) - 1)) * 100).alias("accel_a"),
        F.when(F.col("i") >= 5, (nav / at(2) - 1) * 100 - (at(3) / at(5) - 1) * 100).otherwise(0.0).alias("accel_b"),
        F.when(F.col("i") >= 6, (nav / at(3) - 1) * 100 - (at(3) / at(6) - 1) * 100).otherwise(0.0).alias("accel_c"),
    )


def _ewma(returns: Column) -> Column:
    first = F.element_at(returns, 1)
    return F.sqrt(F.aggregate(F.slice(returns, 2, F.size(returns)), first * first, lambda s, v: s * 0.94 + v * v * 0.06)) * F.sqrt(F.lit(YEAR)) * 100


def ewma_vol(p: DataFrame) -> DataFrame:
    """IND-15 (21 rows, at least 5 returns) and INB-16 (20 returns)."""
    a, b = F.collect_list("r").over(rows(21)), F.collect_list("r").over(rows(20))
    return p.select("code", "d", "i", F.when(F.size(a) >= 5, _ewma(a)).alias("ewma_a"), F.when(F.size(b) >= 2, _ewma(b)).otherwise(0.0).alias("ewma_b"))


#: Rows and ranks of a block of rank_so_far.
RANK_BLOCK = 64


def rank_so_far(df: DataFrame, value: str) -> DataFrame:
    """df (code, i, value, ...) with place (1, 2, ... in the order of i) and below: how many values up to the row's are at most its own.

    Places and ranks by value fall into blocks. Earlier blocks of places and lower blocks of ranks are counted by a running
    sum over a grid of blocks; what shares the row's block of places, or of ranks, is looked at one by one. So a row
    costs its blocks and its share of the grid, not its whole history.
    """
    w = Window.partitionBy("code")
    rows_of = df.withColumns({"place": F.row_number().over(w.orderBy("i")), "rank": F.row_number().over(w.orderBy(value, "i"))})
    block = lambda c: F.floor((F.col(c) - 1) / RANK_BLOCK).cast("int")
    rows_of = rows_of.withColumns({"at": block("place"), "level": block("rank")})
    earlier = Window.partitionBy("code", "at").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    beside = F.collect_list("rank").over(earlier)
    level = F.collect_list(F.struct("at", "rank")).over(Window.partitionBy("code", "level"))
    rows_of = rows_of.withColumn("near", F.size(F.filter(beside, lambda x: x <= F.col("rank"))) + F.size(F.filter(level, lambda x: (x["at"] < F.col("at")) & (x["rank"] <= F.col("rank")))))
    cells = rows_of.groupBy("code", "at", "level").count()
    last = cells.groupBy("code").agg(F.max("at").alias("last"))
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col("last"))).alias(name)
    grid = last.select("code", "last", upto("at")).select("code", "at", upto("level")).join(cells, ["code", "at", "level"], "left")
    before = lambda keys, order: Window.partitionBy("code", keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("in_level", F.sum(F.coalesce("count", F.lit(0))).over(before("level", "at"))).withColumn("far", F.sum("in_level").over(before("at", "level")))
    out = rows_of.join(grid.select("code", "at", "level", F.coalesce("far", F.lit(0)).alias("far")), ["code", "at", "level"])
    return out.withColumn("below", F.col("near") + F.col("far")).drop("at", "level", "rank", "near", "far")


def vol_percentile(p: DataFrame) -> DataFrame:
    """IND-16, IND-17: share of all rolling 30-return volatilities so far that are at most the present one, from row 40 on."""
    v = p.withColumn("v", F.when(F.col("i") >= 30, F.stddev_samp("r").over(rows(30)))).select("code", "d", "i", "v")
    ranked = rank_so_far(v.where("v is not null").select("code", "i", "v"), "v").select("code", "i", (F.col("below") / F.col("place") * 100).alias("pct"))
    out = v.drop("v").join(ranked.where("i >= 40"), ["code", "i"], "left").select("code", "d", "i", "pct")
    return out.withColumn("regime", F.when(F.col("pct").isNull(), "未知").when(F.col("pct") >= 75, "高波动").when(F.col("pct") <= 25, "低波动").otherwise("常态波动"))


def _percentile_b(lookback: int) -> Column:
    """Share of the lookback's rolling 20-return volatilities below the present one; needs columns v20 and i."""
    hist = F.collect_list("v20").over(rows(lookback - 20))
    return F.size(F.filter(hist, lambda x: x < F.col("v20"))) / F.size(hist) * 100


def vol_percentile_b(p: DataFrame, lookback: int = 90) -> DataFrame:
    """INB-17, INB-18 over a lookback of rows."""
    v = p.withColumn("v20", F.when(F.col("i") >= 20, F.stddev_samp("r").over(rows(20)))).withColumn("pct", _percentile_b(lookback))
    out = v.where(F.col("i") >= lookback - 1).select("code", "d", "i", "pct")
    return out.withColumn("regime", F.when(F.col("pct") > 75, "高波动").when(F.col("pct") < 25, "低波动").otherwise("正常"))


def _streak(p: DataFrame, sign: Column, order: Window | None = None) -> DataFrame:
    """Length of the run of equal signs that ends in each row (gaps and islands)."""
    order = order or in_order()
    s = p.withColumn("sign", sign)
    begins = F.when(~F.col("sign").eqNullSafe(F.lag("sign").over(order)) | F.lag("i").over(order).isNull(), F.col("i"))
    s = s.withColumn("island", begins).withColumn("island", F.max("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn("run", F.col("i") - F.col("island") + 1)


def streaks(p: DataFrame) -> DataFrame:
    """INB-20 (sign of the last change) and IND-20 (daily return beyond 0.01 %, small moves at the end skipped).

    Family a looks at 30 returns: a fold from the newest to the oldest.
    """
    b = _streak(p.where("i >= 1"), F.signum("r"))
    word = F.when(F.col("sign") > 0, "上涨").when(F.col("sign") < 0, "下跌").otherwise("平")
    recent = F.reverse(F.collect_list(F.col("r") * 100).over(rows(30)))

    def step(acc: Column, x: Column) -> Column:
        s = F.when(x > 0.01, 1).when(x < -0.01, -1).otherwise(0)
        begins, goes_on = (acc["n"] == 0) & (s != 0), (acc["n"] > 0) & (s == acc["s"])
        n = F.when(acc["over"], acc["n"]).when(begins | goes_on, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(n.alias("n"), F.when(~acc["over"] & begins, s).otherwise(acc["s"]).alias("s"), (acc["over"] | ((acc["n"] > 0) & ~goes_on)).alias("over"))

    fold = F.aggregate(recent, F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(False).alias("over")), step)
    out = b.withColumn("recent", recent).withColumn("fold", fold)
    a_word = F.when(F.size("recent") < 2, "未知").when(F.col("fold.s") > 0, "上涨").when(F.col("fold.s") < 0, "下跌").otherwise("平盘")
    return out.select("code", "d", "i", word.alias("dir_b"), F.when(F.col("sign") == 0, 0).otherwise(F.col("run")).cast("long").alias("days_b"), a_word.alias("dir_a"), F.when(F.size("recent") < 2, 0).otherwise(F.col("fold.n")).cast("long").alias("days_a"))


def streak_c(p: DataFrame) -> DataFrame:
    """INC-5: the run of rises or falls that ends in each row; a flat row counts 1, a first row 0."""
    days = F.when(F.col("i") == 0, 0).when(F.col("sign") == 0, 1).otherwise(F.col("run")).cast("long")
    word = F.when(F.col("sign") > 0, "up").when(F.col("sign") < 0, "down").otherwise("flat")
    return _streak(p, F.signum("r")).select("code", "d", "i", days.alias("days"), word.alias("direction"))


def range_60(p: DataFrame) -> DataFrame:
    """INC-8: return over the last 60 rows (0 with fewer) and the place between their lowest and highest value."""
    return p.select("code", "d", "i", F.when(F.col("i") >= 59, (F.col("nav") / lagged(59) - 1) * 100).otherwise(0.0).alias("ret_60"), _position(rows(60)).alias("pos_60"))


def summary(p: DataFrame) -> DataFrame:
    """IND-1, PRD-2: rows, first and last day and last value of each code; below 5 rows an error and none of these."""
    out = p.groupBy("code").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.max_by("nav", "d").alias("nav"))
    return out.select("code", *summary_columns(F.col("n"), F.col("first"), F.col("last"), F.col("nav")))


def summary_columns(n: Column, first: Column, last: Column, nav: Column) -> list[Column]:
    """data_days, data_start, data_end, latest_nav and error of a code of n rows."""
    enough = lambda x: F.when(n >= 5, x)
    error = F.when(n < 5, F.concat(F.lit("净值数据不足（仅 "), n.cast("string"), F.lit(" 条）")))
    return [n.cast("long").alias("data_days"), enough(F.date_format(first, "yyyy-MM-dd")).alias("data_start"), enough(F.date_format(last, "yyyy-MM-dd")).alias("data_end"), enough(four_places(nav)).alias("latest_nav"), error.alias("error")]


def one_year(p: DataFrame) -> DataFrame:
    """FLT-6: rows of the 365 days before each code's last one."""
    last = F.max("d").over(Window.partitionBy("code"))
    return p.withColumn("last", last).where(F.col("d") >= F.date_sub("last", 365)).drop("last")


#: PRJ-2: older names of the calendar returns and drawdowns.
ALIASES = {"ret_7": "return_7d", "ret_30": "return_30d", "ret_60": "return_60d", "ret_90": "return_90d", "dd_7": "max_drawdown_7d", "dd_30": "max_drawdown_30d", "dd_60": "max_drawdown_60d", "dd_90": "max_drawdown_90d"}


def with_aliases(df: DataFrame) -> DataFrame:
    """PRJ-2: the columns of df that have older names under these as well."""
    return df.withColumns({alias: F.col(c) for c, alias in ALIASES.items() if c in df.columns})


def latest(p: DataFrame) -> DataFrame:
    """The end of each code's history as arrays in the order of dates: code, navs, rets.

    Exponential means are all that is taken of them, and rows further back than EXACT_ROWS do not show in these.
    """
    rows_of = F.array_sort(F.collect_list(F.struct("i", "nav", "r")))
    newest = F.max("i").over(Window.partitionBy("code"))
    return p.withColumn("newest", newest).where(F.col("i") > F.col("newest") - EXACT_ROWS).groupBy("code").agg(rows_of.alias("h")).select("code", F.transform("h", lambda x: x["nav"]).alias("navs"), F.filter(F.transform("h", lambda x: x["r"]), lambda x: x.isNotNull()).alias("rets"))


def rsi_wilder(p: DataFrame) -> DataFrame:
    """IND-21 at the latest row: exponential means of gains and losses of daily returns over the whole history."""
    out = latest(p)
    for w in (6, 14, 28):
        gain = wilder(F.transform("rets", lambda x: F.greatest(x * 100, F.lit(0.0))), w)
        loss = wilder(F.transform("rets", lambda x: F.greatest(x * -100, F.lit(0.0))), w)
        out = out.withColumn(f"rsi_{w}", F.when((F.size("rets") > w) & (loss != 0), 100 - 100 / (1 + gain / loss)))
    return out.drop("navs", "rets")




def rsi_simple(p: DataFrame) -> DataFrame:
    """INB-11, INC-2: sums of gains and losses of the last w changes."""
    out = p.withColumn("change", F.col("nav") - lagged(1))
    for w in (6, 14, 28):
        gain, loss = (F.sum(F.greatest(F.col("change") * s, F.lit(0.0))).over(rows(w)) for s in (1, -1))
        out = out.withColumn(f"rsi_{w}", F.when(F.col("i") >= w, F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + gain / loss))))
    return out.drop("nav", "r", "change")


def macd_a(p: DataFrame) -> DataFrame:
    """IND-22 at the latest row, over the whole history."""
    out = latest(p).withColumn("m", macd_states(F.col("navs")))
    dif, dea = (lambda k: F.col("m")[k]["dif"]), (lambda k: F.col("m")[k]["dea"])
    hist = lambda k: dif(k) - dea(k)
    cross = F.when((dif(2) < dea(2)) & (dif(0) > dea(0)), "golden").when((dif(2) > dea(2)) & (dif(0) < dea(0)), "dead").otherwise("none")
    way = F.when(hist(0) > hist(1), "rising").when(hist(0) < hist(1), "falling").otherwise("flat")
    return out.where(F.size("navs") >= 37).select("code", dif(0).alias("macd_line"), dea(0).alias("signal_line"), hist(0).alias("histogram"), hist(1).alias("histogram_prev"), cross.alias("crossover"), way.alias("direction"))


def macd_b(p: DataFrame, lookback: int = 90) -> DataFrame:
    """INB-12 over each lookback of rows."""
    out = p.select("code", "d", "i", F.collect_list("nav").over(rows(lookback)).alias("h")).where(F.col("i") >= lookback - 1).withColumn("m", macd_states(F.col("h")))
    return out.select("code", "d", "i", *macd_b_columns(F.col("m")))


def macd_b_columns(m: Column) -> list[Column]:
    dif, dea = (lambda k: m[k]["dif"]), (lambda k: m[k]["dea"])
    hist = lambda k: (dif(k) - dea(k)) * 2
    cross = F.when((dif(1) <= dea(1)) & (dif(0) > dea(0)), "golden").when((dif(1) >= dea(1)) & (dif(0) < dea(0)), "dead").otherwise("none")
    way = F.when((hist(0) > hist(1)) & (hist(1) > hist(2)), "rising").when((hist(0) < hist(1)) & (hist(1) < hist(2)), "falling").otherwise("flat")
    return [hist(0).alias("histogram"), cross.alias("crossover"), way.alias("direction")]


def bollinger(p: DataFrame) -> DataFrame:
    """IND-23 (unclamped, with bands), INB-13 (clamped), INC-3 (population deviation)."""
    f = rows(20)
    nav, mean, s1, s0 = F.col("nav"), F.avg("nav").over(f), F.stddev_samp("nav").over(f), F.stddev_pop("nav").over(f)
    place = lambda s: F.when(s == 0, 50.0).otherwise((nav - (mean - s * 2)) / (s * 4) * 100)
    full = F.col("i") >= 19
    return p.select(
        "code", "d", "i",
        F.when(full, place(s1)).alias("pos_a"), F.when(full, s1 * 4 / mean * 100).alias("width_a"),
        F.when(full, mean + s1 * 2).alias("upper"), F.when(full, mean - s1 * 2).alias("lower"),
        F.when(full, F.greatest(F.lit(0.0), F.least(F.lit(100.0), place(s1)))).otherwise(50.0).alias("pos_b"),
        F.when(full, s1 * 4 / mean * 100).otherwise(10.0).alias("width_b"),
        F.when(full, place(s0)).alias("pos_c"),
    )


def skews(p: DataFrame) -> DataFrame:
    """IND-24 (bias-adjusted, 60 returns, at least 30) and INB-14 (40 returns, deviation with n - 1)."""
    n60, n40 = F.count("r").over(rows(60)).cast("double"), F.count("r").over(rows(40)).cast("double")
    a = F.skewness("r").over(rows(60)) * F.sqrt(n60 * (n60 - 1)) / (n60 - 2)
    b = F.skewness("r").over(rows(40)) * F.pow((n40 - 1) / n40, F.lit(1.5))
    return p.select("code", "d", "i", F.when(n60 >= 30, a).alias("skew_a"), F.when(n40 >= 3, b).otherwise(0.0).alias("skew_b"))


def short_features(p: DataFrame) -> DataFrame:
    """INC-1, INC-4, INC-6, INC-8 (but for range_60): returns, means, support, 10-row deviation, yearly deviation with 252 days."""
    nav = F.col("nav")
    out = p.select(
        "code", "d", "i",
        *[F.when(F.col("i") >= k, (nav / lagged(k) - 1) * 100).alias(f"ret_{k}") for k in (1, 3, 5, 10)],
        *[ma(k).alias(f"ma_{k}") for k in (3, 5, 10, 20)],
        F.min("nav").over(rows(30)).alias("support"), F.max("nav").over(rows(30)).alias("resistance"),
        F.when(F.col("i") >= 10, F.stddev_pop("r").over(rows(10)) * 100).alias("vol_10"),
        F.when(F.col("i") >= 19, (nav / lagged(4) - 1) * 100).alias("llm_ret_7d"), F.when(F.col("i") >= 19, (nav / lagged(19) - 1) * 100).alias("llm_ret_30d"),
        F.when(F.col("i") >= 20, F.stddev_pop("r").over(rows(20)) * F.sqrt(F.lit(252.0)) * 100).alias("llm_vol"),
    )
    return out
