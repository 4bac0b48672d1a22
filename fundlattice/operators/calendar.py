"""Family "a" as a whole: the indicators that risk, forecasts and decisions rest on, as of every row of a panel.

Windows are of calendar days where the family says so, of rows elsewhere. What a history is too short for is null; neutral()
gives what scores take for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlattice.functions.numeric import round_half_up
from fundlattice.operators import indicators as ind
from fundlattice.operators.indicators import YEAR, days, in_order, lagged, ma, rows
from fundlattice.operators.scan import exponential_means, largest_falls

# fixed values: rows that any indicator needs; windows; weights of the exponential means; what scores take for a missing value
LEAST_ROWS = 5
RSI_ROWS = (6, 14, 28)
FAST, SLOW, SIGNAL, MACD_ROWS = 12, 26, 9, 37
NEUTRAL = {
    **dict.fromkeys("ret_1 ret_5 ret_7d ret_10 ret_20 ret_30d ret_60 ret_60d ret_90d dd_7 dd_30 dd_60 dd_90 vol_30 vol_60 vol_90 down_30 down_60 sharpe_30 sharpe_60".split(), 0.0),
    **dict.fromkeys("rebound_7 rebound_30 pullback_7 pullback_30 accel ewma calmar_60 calmar_90 macd_hist skew".split(), 0.0),
    **dict.fromkeys("win_30 win_60 pos_7 pos_30 pos_60 pos_90 rsi_6 rsi_14 rsi_28 bb_pos".split(), 50.0),
    "bb_width": 10.0, "macd_cross": "none", "macd_dir": "flat", "streak_dir": "未知", "streak_days": 0,
}


def _rsi() -> dict[str, Column]:
    return {f"rsi_{w}": F.when((F.col("i") > w) & (F.col(f"_loss_{w}") > 0), 100 - 100 / (1 + F.col(f"_gain_{w}") / F.col(f"_loss_{w}"))) for w in RSI_ROWS}


def _crossing(line2: Column, signal2: Column, line: Column, signal: Column) -> Column:
    return F.when((line2 < signal2) & (line > signal), "golden").when((line2 > signal2) & (line < signal), "dead").otherwise("none")


def _way(hist: Column, last: Column) -> Column:
    return F.when(hist > last, "rising").when(hist < last, "falling").otherwise("flat")


def wilder_rsi(p: DataFrame) -> DataFrame:
    """IND-21 at every row: p with rsi_6, rsi_14, rsi_28; null before w + 1 returns, and where nothing was ever lost."""
    out = p.withColumns({"_gain": F.greatest(F.col("r") * 100, F.lit(0.0)), "_loss": F.greatest(F.col("r") * -100, F.lit(0.0))})
    out = exponential_means(out, {f"_{side}_{w}": (f"_{side}", 1, 1 / w) for w in RSI_ROWS for side in ("gain", "loss")})
    return out.withColumns(_rsi()).drop("_gain", "_loss", *[f"_{side}_{w}" for w in RSI_ROWS for side in ("gain", "loss")])


def macd(p: DataFrame) -> DataFrame:
    """IND-22 at every row: p with macd_line, signal_line, histogram, histogram_prev, crossover, direction; null below MACD_ROWS rows."""
    out = exponential_means(p, {"_fast": ("nav", 0, 2 / (FAST + 1)), "_slow": ("nav", 0, 2 / (SLOW + 1))}).withColumn("_line", F.col("_fast") - F.col("_slow"))
    out = exponential_means(out, {"_signal": ("_line", 0, 2 / (SIGNAL + 1))}).withColumn("_hist", F.col("_line") - F.col("_signal"))
    before = lambda c, k: F.lag(c, k).over(in_order())
    line, signal, hist, last = F.col("_line"), F.col("_signal"), F.col("_hist"), before("_hist", 1)
    cross, way = _crossing(before("_line", 2), before("_signal", 2), line, signal), _way(hist, last)
    found = {"macd_line": line, "signal_line": signal, "histogram": hist, "histogram_prev": last, "crossover": cross, "direction": way}
    enough = F.col("i") >= MACD_ROWS - 1
    return out.withColumns({n: F.when(enough, c) for n, c in found.items()}).drop("_fast", "_slow", "_line", "_signal", "_hist")


def _streaks(p: DataFrame) -> DataFrame:
    """IND-20: p with streak_dir and streak_days: the run of returns beyond 0.01 % of one sign that ended last, of the last 30."""
    sign = F.when(F.col("r") > 0.0001, 1).when(F.col("r") < -0.0001, -1).when(F.col("r").isNotNull(), 0)
    out = ind._streak(p, sign)
    moved = F.last(F.when(F.col("sign") != 0, F.struct("i", "sign", "run")), ignorenulls=True).over(rows(30))
    out = out.withColumns({"_moved": moved, "_known": F.count("r").over(rows(30))})
    return out.withColumns(_streak_words()).drop("sign", "island", "run", "_moved", "_known")


def _streak_words() -> dict[str, Column]:
    run = F.least(F.col("_moved.run"), F.col("_moved.i") - (F.col("i") - 30)).cast("long")
    word = F.when(F.col("_known") < 2, "未知").when(F.col("_moved.sign") > 0, "上涨").when(F.col("_moved.sign") < 0, "下跌").otherwise("平盘")
    return {"streak_dir": word, "streak_days": F.when(F.col("_known") < 2, F.lit(0)).otherwise(F.coalesce(run, F.lit(0)))}


def _falls(p: DataFrame) -> DataFrame:
    """IND-3: p with the largest falls dd_7 to dd_90, as positive shares: of n days, or of some rows where these hold fewer than three."""
    day = F.unix_date("d")
    windows = {f"_days_{n}": (day, n + 1, days(n)) for n in (7, 30, 60, 90)} | {f"_rows_{n}": (F.col("i"), max(3, n // 2), rows(max(3, n // 2))) for n in (7, 30, 60, 90)}
    out = largest_falls(p, windows)
    return out.withColumns({f"dd_{n}": F.when(F.count("nav").over(days(n)) < 3, F.col(f"_rows_{n}")).otherwise(F.col(f"_days_{n}")) for n in (7, 30, 60, 90)}).drop(*windows)


def _volatility_rank(p: DataFrame) -> DataFrame:
    """IND-16: p with pct, the share of all 30-return volatilities so far that are at most the present one; null below 40 returns."""
    v = p.withColumn("_v", F.when(F.col("i") >= 30, F.stddev_samp("r").over(rows(30))))
    ranked = ind.rank_so_far(v.where("_v is not null").select("code", "i", "_v"), "_v").where("i >= 40").select("code", "i", (F.col("below") / F.col("place") * 100).alias("pct"))
    return v.drop("_v").join(ranked, ["code", "i"], "left")


def _sums(day, row, then, place, before, squares: Column) -> dict[str, Column]:
    """What _told rests on. day(n), row(n): functions of (aggregate, column) over the last n days or rows; then(n), place(n) and before(n): the value
    of the last row at least n days ago, of the row n rows ago or the oldest, and of the row n rows ago; squares: the fading mean of 20 squared returns."""
    few = {n: day(n)(F.count, "nav") < 5 for n in (7, 30, 60, 90)}

    def over(n: int, g, x) -> Column:
        return F.when(few[n], row(max(5, n // 2))(g, x)).otherwise(day(n)(g, x))

    negative = F.when(F.col("r") < 0, F.col("r"))
    sums = {}
    for n in (7, 30, 60, 90):
        sums |= {f"_n_{n}": over(n, F.count, "r"), f"_mean_{n}": over(n, F.avg, "r"), f"_std_{n}": over(n, F.stddev_samp, "r")}
        sums |= {f"_low_{n}": over(n, F.min, "nav"), f"_high_{n}": over(n, F.max, "nav"), f"_then_{n}": then(n)}
    for n in (30, 60):
        sums |= {f"_fell_{n}": over(n, F.count, negative), f"_down_{n}": over(n, F.stddev_samp, negative)}
    for n in (7, 30):
        sums |= {f"_full_{n}": ~few[n]}
    sums |= {"_mid": row(20)(F.avg, "nav"), "_dev": row(20)(F.stddev_samp, "nav"), "_squares": squares, "_n21": row(21)(F.count, "r"), "_n60": row(60)(F.count, "r").cast("double"), "_skew": row(60)(F.skewness, "r")}
    sums |= {f"_old_{k}": place(k) for k in (1, 5, 10, 20, 60)} | {f"_lag_{k}": before(k) for k in (5, 10)}
    up = F.when(F.col("r") > 0, 1)
    return sums | {f"_avg_{k}": row(k)(F.avg, "nav") for k in (5, 10, 20, 60)} | {f"_up_{n}": row(n)(F.count, up) for n in (20, 60)} | {f"_r_{n}": row(n)(F.count, "r") for n in (20, 60)}


def metrics(p: DataFrame) -> DataFrame:
    """D3, IND-2 to IND-24: one row for each row of a panel (code, d, nav, i, r) from a code's fifth on, rounded as they are told.

    Drawdowns are positive percentages here. A panel's exchange by code serves all windows; ranks of volatilities meet it
    again by code and row.
    """
    p = _volatility_rank(p)
    p = macd(wilder_rsi(_streaks(_falls(p))))
    within = lambda frame: lambda g, x: g(x).over(frame)
    rets = F.collect_list("r").over(rows(21))
    fold = F.aggregate(F.slice(rets, 2, 21), F.pow(F.get(rets, F.lit(0)), F.lit(2.0)), lambda s, v: s * 0.94 + v * v * 0.06)
    sums = _sums(lambda n: within(days(n)), lambda n: within(rows(n)), ind.as_of, lambda k: F.first("nav").over(rows(k + 1)), lagged, fold)
    return _told(p.withColumns(sums).where(F.col("i") >= LEAST_ROWS - 1))


def _fading(x: Column, a: float, first: int, age: Column) -> Column:
    """The exponential mean of x up to the last row of a group, begun with row `first`, as one sum: a row's weight fades with its age."""
    weight = F.pow(F.lit(1 - a), age) * F.when(F.col("i") == first, 1.0).otherwise(a)
    return F.sum(F.when(F.col("i") >= first, x * weight))


def newest_metrics(p: DataFrame, least: int = LEAST_ROWS, more: tuple[Column, ...] = ()) -> DataFrame:
    """newest(metrics(p)) for codes of at least `least` rows, without the metrics of the rows before; more: aggregates of p to be told as well.

    Frames that end in a code's last row are conditions on a row's age, so all are sums of one aggregation, over rows that one
    exchange and one sort have brought in order; it streams, as structs among its sums keep it from hashing.
    """
    whole, upto = Window.partitionBy("code"), in_order().rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("r") > 0.0001, 1).when(F.col("r") < -0.0001, -1).when(F.col("r").isNotNull(), 0)
    out = ind._streak(p.withColumn("_v", F.when(F.col("i") >= 30, F.stddev_samp("r").over(rows(30)))), sign)
    out = out.withColumns({"_last": F.max("i").over(whole), "_end": F.max("d").over(whole), "_begin": F.max(F.when(F.col("i") == 0, F.col("nav"))).over(whole)})
    out = out.withColumns({"_age": F.col("_last") - F.col("i"), "_ago": F.datediff("_end", "d")})
    age, nav = F.col("_age"), F.col("nav")
    day, row = (lambda n: F.col("_ago") <= n), (lambda n: age < n)
    frames = {f"_days_{n}": day(n) for n in (7, 30, 60, 90)} | {f"_rows_{n}": row(max(3, n // 2)) for n in (7, 30, 60, 90)}
    out = out.withColumn("_now", F.max(F.when(age == 0, F.col("_v"))).over(whole)).withColumns({f"_peak{c}": F.max(F.when(m, nav)).over(upto) for c, m in frames.items()})
    when = lambda mask: lambda g, x: g(F.when(mask, F.col(x) if isinstance(x, str) else x))
    at = lambda mask, c="nav": F.max(F.when(mask, F.col(c)))
    squares = F.sum(F.when(row(21), F.pow("r", F.lit(2.0)) * F.pow(F.lit(0.94), age) * F.when(age == F.least(F.lit(20), F.col("_last") - 1), 1.0).otherwise(0.06)))
    sums = _sums(lambda n: when(day(n)), lambda n: when(row(n)), lambda n: F.max(F.when(F.col("_ago") >= n, F.struct("i", "nav")))["nav"], lambda k: at(F.col("i") == F.greatest(F.col("_last") - k, F.lit(0))), lambda k: at(age == k), squares)
    sums |= {f"dd_{n}": F.when(F.count(F.when(day(n), nav)) < 3, F.max(F.when(frames[f"_rows_{n}"], 1 - nav / F.col(f"_peak_rows_{n}")))).otherwise(F.max(F.when(frames[f"_days_{n}"], 1 - nav / F.col(f"_peak_days_{n}")))) for n in (7, 30, 60, 90)}
    sums |= {"_moved": F.max(F.when(row(30) & (F.col("sign") != 0), F.struct("i", "sign", "run"))), "_known": F.count(F.when(row(30), F.col("r"))), "pct": F.when(F.max("i") >= 40, F.count_if(F.col("_v") <= F.col("_now")) / F.count("_v") * 100)}
    for w in RSI_ROWS:
        sums |= {f"_gain_{w}": _fading(F.greatest(F.col("r") * 100, F.lit(0.0)), 1 / w, 1, age), f"_loss_{w}": _fading(F.greatest(F.col("r") * -100, F.lit(0.0)), 1 / w, 1, age)}
    # values count from the first, so what an exponential mean begins with is 0; a mean of a mean has the weights of a geometric sum
    moved, (fast, slow, signal) = nav - F.col("_begin"), (1 - 2 / (n + 1) for n in (FAST, SLOW, SIGNAL))
    faded = lambda q, n=0: F.pow(F.lit(q), age + n)
    both = lambda q: (1 - q) * (1 - signal) * (faded(q, 1) - faded(signal, 1)) / (q - signal)
    sums |= {"_fast": F.sum(moved * (1 - fast) * faded(fast)), "_slow": F.sum(moved * (1 - slow) * faded(slow)), "_signal": F.sum(moved * (both(fast) - both(slow))), **{f"_at_{k}": F.max(F.when(age == k, moved)) for k in (0, 1)}}
    # what a mean was before its last row
    out = out.groupBy("code").agg(F.max("d").alias("d"), F.max("i").alias("i"), at(age == 0).alias("nav"), *more, *[x.alias(n) for n, x in sums.items()]).where(F.col("i") >= least - 1)
    for k in (0, 1):
        was = lambda c, q, x: ((F.col(f"{c}{k or ''}") - (1 - q) * x) / q).alias(f"{c}{k + 1}")  # noqa: B023, E731
        line = F.col(f"_fast{k or ''}") - F.col(f"_slow{k or ''}")
        out = out.select("*", was("_fast", fast, F.col(f"_at_{k}")), was("_slow", slow, F.col(f"_at_{k}")), was("_signal", signal, line))
    line, sig = (lambda k: F.col(f"_fast{k or ''}") - F.col(f"_slow{k or ''}")), (lambda k: F.col(f"_signal{k or ''}"))
    hist = lambda k: line(k) - sig(k)
    known = F.col("i") >= MACD_ROWS - 1
    return _told(out.withColumns(_streak_words() | _rsi() | {n: F.when(known, x) for n, x in (("histogram", hist(0)), ("crossover", _crossing(line(2), sig(2), line(0), sig(0))), ("direction", _way(hist(0), hist(1))))}), *[F.col(x) for x in out.columns if not x.startswith("_") and x not in ("code", "d", "i", "nav", "pct") and not x.startswith("dd_")])


def _told(out: DataFrame, *more: Column) -> DataFrame:
    """The metrics of each row of out, rounded as they are told, from _sums and the columns of falls, streaks, RSI, MACD and rank."""
    nav, r2, year = F.col("nav"), lambda x: round_half_up(x, 2), F.sqrt(F.lit(YEAR))
    c = lambda name: F.col(f"_{name}")
    dd = {n: r2(F.col(f"dd_{n}") * 100) for n in (7, 30, 60, 90)}
    vol = {n: F.when(c(f"n_{n}") >= 3, r2(c(f"std_{n}") * year * 100)) for n in (30, 60, 90)}
    place = lambda low, high: F.when(high == low, 50.0).otherwise((nav - low) / (high - low) * 100)
    ewma = F.sqrt("_squares") * year * 100
    averages = {k: F.when(F.col("i") >= k - 1, c(f"avg_{k}")) for k in (5, 10, 20, 60)}
    band = F.when(F.col("i") >= 19, c("mid"))
    m5, m10, m20, m60 = averages.values()
    strict = F.when((nav > m5) & (m5 > m10) & (m10 > m20) & (m20 > m60), "多头排列（上升趋势）").when((nav < m5) & (m5 < m10) & (m10 < m20) & (m20 < m60), "空头排列（下降趋势）")
    trend = F.when(F.col("i") < 29, "数据不足，无法判断趋势").otherwise(F.coalesce(strict, F.when((nav > m20) & (m5 > m20), "偏多震荡").when((nav < m20) & (m5 < m20), "偏空震荡").otherwise("横盘整理")))
    pct = round_half_up(F.col("pct"), 1)
    calmar = {n: F.when((c(f"n_{n}") >= 3) & (dd[n] > 0), r2(F.abs(c(f"mean_{n}") * YEAR / (dd[n] / 100)))) for n in (60, 90)}
    return out.select(
        "code", "d", "i", round_half_up(nav, 4).alias("nav"),
        *[r2((nav / c(f"old_{k}") - 1) * 100).alias(f"ret_{k}") for k in (1, 5, 10, 20, 60)],
        *[F.when(c(f"then_{n}") != 0, r2((nav - c(f"then_{n}")) / c(f"then_{n}") * 100)).alias(f"ret_{n}d") for n in (7, 30, 60, 90)],
        *[dd[n].alias(f"dd_{n}") for n in dd], *[vol[n].alias(f"vol_{n}") for n in vol],
        *[F.when(c(f"n_{n}") >= 3, F.when(c(f"fell_{n}") < 2, 0.0).otherwise(r2(c(f"down_{n}") * year * 100))).alias(f"down_{n}") for n in (30, 60)],
        *[round_half_up(averages[k], 4).alias(f"ma_{k}") for k in (5, 10, 20, 60)], trend.alias("trend"),
        *[round_half_up(place(c(f"low_{n}"), c(f"high_{n}")), 1).alias(f"pos_{n}") for n in (7, 30, 60, 90)],
        *[F.when(c(f"full_{n}"), r2((nav - c(f"low_{n}")) / c(f"low_{n}") * 100)).alias(f"rebound_{n}") for n in (7, 30)],
        *[F.when(c(f"full_{n}"), r2((c(f"high_{n}") - nav) / c(f"high_{n}") * 100)).alias(f"pullback_{n}") for n in (7, 30)],
        F.when(F.col("i") >= 10, r2((nav / c("lag_5") - c("lag_5") / c("lag_10")) * 100)).alias("accel"),
        F.when(c("n21") >= 5, r2(ewma)).alias("ewma"), pct.alias("pct"),
        F.when(pct.isNull(), "未知").when(pct >= 75, "高波动").when(pct <= 25, "低波动").otherwise("常态波动").alias("regime"),
        *[calmar[n].alias(f"calmar_{n}") for n in calmar],
        *[F.when(c(f"n_{n}") >= 5, r2(F.when(c(f"std_{n}") == 0, 0.0).otherwise(c(f"mean_{n}") / c(f"std_{n}") * year))).alias(f"sharpe_{n}") for n in (30, 60)],
        *[F.when(c(f"r_{n}") >= 3, round_half_up(c(f"up_{n}") / c(f"r_{n}") * 100, 1)).alias(f"win_{name}") for n, name in ((20, 30), (60, 60))],
        "streak_dir", "streak_days",
        *[round_half_up(F.col(f"rsi_{w}"), 1).alias(f"rsi_{w}") for w in RSI_ROWS],
        round_half_up(F.col("histogram"), 6).alias("macd_hist"), F.col("crossover").alias("macd_cross"), F.col("direction").alias("macd_dir"),
        F.when(band.isNotNull(), F.when(c("dev") == 0, 50.0).otherwise(round_half_up((nav - (band - c("dev") * 2)) / (c("dev") * 4) * 100, 1))).alias("bb_pos"),
        F.when(band.isNotNull(), r2(c("dev") * 4 / band * 100)).alias("bb_width"),
        F.when(c("n60") >= 30, r2(c("skew") * F.sqrt(c("n60") * (c("n60") - 1)) / (c("n60") - 2))).alias("skew"), *more,
    )


def neutral(df: DataFrame) -> DataFrame:
    """Missing metrics as scores take them: no move, the middle of a range, no signal."""
    return df.fillna({c: v for c, v in NEUTRAL.items() if c in df.columns})


def newest(df: DataFrame) -> DataFrame:
    """The last row of each code."""
    return df.withColumn("_last", F.max("i").over(Window.partitionBy("code"))).where(F.col("i") == F.col("_last")).drop("_last")
