"""Walk-forward samples: what was known at each row, and what came after.

A sample at row i knows the lookback of its code, the rows up to i - 1, and is judged by row i + horizon, so a label
spans horizon + 1 steps. All features are computed once for each row and shared by the horizons. The present row of a
code knows its whole history and has no outcome yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlattice.functions.numeric import round_half_up
from fundlattice.operators import scoring
from fundlattice.operators.indicators import YEAR, _streak, macd_b_columns, trend_b_label
from fundlattice.operators.scan import blocked, by_block, exponential_means, largest_falls

# fixed values: rows that a code needs, samples that a horizon needs, bounds of the lookback, floors of thresholds
MIN_ROWS, MIN_SAMPLES = 60, 20
LEAST_LOOKBACK, MOST_LOOKBACK = 40, 90
FLOORS = {1: 0.5, 3: 1.0, 7: 2.0, 30: 3.0}
FALLBACK_VOL = 0.15 / YEAR**0.5


#: Steps of the finest scaled position, see behind().
UNIT = 1_000


def behind(steps: Column, most: int) -> Column:
    """A position by which a frame of RANGE (most * UNIT PRECEDING) holds a row and the `steps` before it, a number of its code's own.

    steps is at most `most`. Rows of a code lie most * UNIT / steps apart, rounded, so that the frame ends between two rows.
    """
    return F.floor(F.col("i") * (most * UNIT) / steps).cast("long")


def _frame(position: str, most: int, less: int = 0) -> Window:
    return Window.partitionBy("code").orderBy(position).rangeBetween(-most * UNIT + less, 0)


def rows(n: int) -> Window:
    """The last n rows of a panel that is blocked()."""
    return by_block().rowsBetween(1 - n, 0)


def lagged(k: int) -> Column:
    return F.lag("nav", k).over(by_block())


def _macd_within(p: DataFrame, look: Window) -> DataFrame:
    """INB-12: p (with the exponential means _f, _s, _dea of a code's whole history) with the MACD of each row's lookback.

    Steps of an exponential mean are affine, so a mean that begins at a lookback's first row is the whole history's, less what
    that had there, faded; a fading difference of two means adds a geometric series to the signal line.
    """
    fast, slow, signal = (1 - 2 / (n + 1) for n in (12, 26, 9))
    before = {f"{c}{k}": F.lag(c, k).over(by_block()) for k in (1, 2) for c in ("_f", "_s", "_dea")}
    start = p.withColumns(before).withColumns({"_from": F.first(F.struct("i", "nav", "_f", "_s", "_dea")).over(look)})
    begun = start.withColumns({"_cf": F.col("_from._f") - F.col("_from.nav"), "_cs": F.col("_from._s") - F.col("_from.nav")})
    faded = lambda a, n: F.pow(F.lit(a), n)
    series = lambda a, n: a * (faded(a, n) - faded(signal, n)) / (a - signal)
    states = {}
    for k in range(3):
        n = F.col("i") - F.col("_from.i") - k
        f, s, dea = (F.col(f"{c}{k or ''}") for c in ("_f", "_s", "_dea"))
        states[f"_dif{k}"] = f - s - faded(fast, n) * F.col("_cf") + faded(slow, n) * F.col("_cs")
        states[f"_sig{k}"] = dea - faded(signal, n) * F.col("_from._dea") - (1 - signal) * (series(fast, n) * F.col("_cf") - series(slow, n) * F.col("_cs"))
    out = begun.withColumns(states).withColumn("m", F.array(*[F.struct(F.col(f"_dif{k}").alias("dif"), F.col(f"_sig{k}").alias("dea")) for k in range(3)]))
    hist, cross, way = macd_b_columns(F.col("m"))
    return out.withColumns({"macd_hist": round_half_up(hist, 6), "macd_cross": cross, "macd_dir": way}).drop("_from", "_cf", "_cs", "m", *before, *states)


def features(p: DataFrame, present: bool = False) -> DataFrame:
    """Family-b indicators, rounded as they are scored, of every row with a full lookback, or of each code's present row.

    The lookback of a code is half its rows, MOST_LOOKBACK at most and LEAST_LOOKBACK at least; frames that are longer take
    what it holds, and what needs more rows has its neutral value. The present row looks back on all rows. Codes
    with fewer than MIN_ROWS rows have none.

    Lookbacks differ by code, but frames have fixed bounds: rows are ordered by a position that makes every code's lookback as long
    (see behind). Exponential means and falls come from blocks (see scan), so no row carries its history. Every sort of a task holds
    memory of its own until the task ends, so all windows of rows take the order of blocks, and frames of one position stand together.
    """
    r2 = lambda x: round_half_up(x, 2)
    year = F.sqrt(F.lit(YEAR))
    nav, look = F.col("nav"), F.col("look")
    # of the returns, one fewer than rows, a lookback of 40 rows holds 39
    within = lambda n, f: f(rows(n)) if n < LEAST_LOOKBACK else F.when(look > n, f(rows(n))).otherwise(f(rows(n - 1)))
    negative = F.when(F.col("r") < 0, F.col("r"))
    rule = F.least(F.lit(MOST_LOOKBACK), F.greatest(F.lit(LEAST_LOOKBACK), F.floor(F.col("n_rows") / 2).cast("int")))
    known = p.withColumn("n_rows", F.count("*").over(Window.partitionBy("code")).cast("int")).where(F.col("n_rows") >= MIN_ROWS)
    known = blocked(known).withColumn("look", F.col("n_rows") if present else rule)
    whole = by_block().rowsBetween(Window.unboundedPreceding, 0)
    if present:
        known = known.withColumn("_tail", F.col("i") * UNIT)
        lookback, returned = whole, whole
    else:
        known = known.withColumns({"_x": behind(look - 1, MOST_LOOKBACK - 1), "_tail": behind(F.least(look, F.lit(60)) - 1, 59), "_v": behind(look - 21, MOST_LOOKBACK - 21)})
        lookback, returned = _frame("_x", MOST_LOOKBACK - 1), _frame("_x", MOST_LOOKBACK - 1, less=UNIT // 2)
    tail = _frame("_tail", 59)
    base = exponential_means(known, {"_f": ("nav", 0, 2 / 13), "_s": ("nav", 0, 2 / 27)}).withColumn("_line", F.col("_f") - F.col("_s"))
    base = exponential_means(base, {"_dea": ("_line", 0, 2 / 10)})
    base = _streak(base, F.signum("r"), by_block()).withColumns({"v20": F.when(F.col("i") >= 20, F.stddev_samp("r").over(rows(20))), "change": nav - lagged(1)})
    gain = lambda w, sign: F.sum(F.greatest(F.col("change") * sign, F.lit(0.0))).over(rows(w))
    aggregates = {
        "_std_20": F.stddev_samp("r").over(rows(20)), "_std_40": within(40, lambda f: F.stddev_samp("r").over(f)), "_mean_20": F.avg("r").over(rows(20)), "_mean_40": within(40, lambda f: F.avg("r").over(f)),
        "_mean_60": F.avg("r").over(rows(60)),
        "_fell": F.count(negative).over(rows(20)), "_down": F.stddev_samp(negative).over(rows(20)), "_mid": F.avg("nav").over(rows(20)), "_dev": F.stddev_samp("nav").over(rows(20)),
        "_skew": within(40, lambda f: F.skewness("r").over(f)), "_rets": F.collect_list("r").over(rows(20)), "win_30": F.count_if(F.col("r") > 0).over(rows(20)), "vol_pop_30": F.stddev_pop("r").over(rows(30)),
        **{f"{side}_{w}": gain(w, sign) for w in (6, 14) for side, sign in (("gain", 1), ("loss", -1))},
        **{f"_low_{n}": F.min("nav").over(f) for n, f in (("5", rows(5)), ("20", rows(20)), ("40", rows(40)))}, **{f"_high_{n}": F.max("nav").over(f) for n, f in (("5", rows(5)), ("20", rows(20)), ("40", rows(40)))},
        **{f"raw_{k}": F.avg("nav").over(rows(k)) for k in (5, 10, 20)}, "_raw_60": F.avg("nav").over(rows(60)), **{f"_lag_{k}": lagged(k) for k in (1, 2, 3, 4, 5, 7, 9, 19, 20, 30, 40, 60)},
        **{f"after_{h}": F.lead("nav", h + 1).over(by_block()) for h in scoring.HORIZONS},
    }
    base = _macd_within(base.withColumns(aggregates), lookback)
    base = base.withColumns({"_mean_tail": F.when(look > 60, F.col("_mean_60")).otherwise(F.avg("r").over(returned)), "vol_pop": F.stddev_pop("r").over(returned)})
    if present:
        newest = F.max(F.when(F.col("i") == look - 1, F.col("v20"))).over(Window.partitionBy("code"))
        base = base.withColumn("_newest", newest).withColumn("pct_of", F.try_divide(F.count_if(F.col("v20") < F.col("_newest")).over(whole), F.count("v20").over(whole)) * 100)
    else:
        base = base.withColumn("_vols", F.collect_list("v20").over(_frame("_v", MOST_LOOKBACK - 21)))
        base = base.withColumn("pct_of", F.try_divide(F.size(F.filter("_vols", lambda x: x < F.col("v20"))), F.size("_vols")) * 100).drop("_vols")
    base = largest_falls(base, {"_dd_20": (F.col("i"), 20, None), "_dd_40": (F.col("i"), 40, None), "_dd_tail": (F.col("_tail"), 59 * UNIT + 1, tail)})
    base = base.withColumns({"_low_t": F.min("nav").over(tail), "_high_t": F.max("nav").over(tail)})
    c = lambda name: F.col(f"_{name}")
    lag = lambda k: F.col(f"_lag_{k}")
    out = base.where(F.col("i") == look - 1 if present else F.col("i") >= look - 1)
    rsi = lambda w: round_half_up(F.when(F.col(f"loss_{w}") == 0, F.when(F.col(f"gain_{w}") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.col(f"gain_{w}") / F.col(f"loss_{w}"))), 1)
    place = lambda n: round_half_up(F.when(c(f"high_{n}") == c(f"low_{n}"), 50.0).otherwise((nav - c(f"low_{n}")) / (c(f"high_{n}") - c(f"low_{n}")) * 100), 1)
    back = lambda k: F.when(look > k, (nav / lag(k) - 1) * 100).otherwise(0.0)
    n40 = F.least(F.lit(40), look - 1).cast("double")
    ewma = F.sqrt(F.aggregate(F.slice("_rets", 2, 20), F.pow(F.element_at("_rets", 1), F.lit(2.0)), lambda a, v: a * 0.94 + v * v * 0.06)) * year * 100
    out = out.select(
        "code", "d", "i", "nav", "look",
        *[r2(back(k)).alias(name) for name, k in (("ret_1", 1), ("ret_5", 5), ("ret_20", 20), ("ret_7d", 5), ("ret_30d", 20), ("ret_60d", 40), ("ret_90d", 60))],
        *[F.when(look >= k, round_half_up(F.col(name), 4)).alias(f"ma_{k}") for k, name in ((5, "raw_5"), (10, "raw_10"), (20, "raw_20"), (60, "_raw_60"))],
        r2(c("dd_20") * 100).alias("dd_30"), r2(c("dd_40") * 100).alias("dd_60"), r2(c("dd_tail") * 100).alias("dd_90"),
        r2(c("std_20") * year * 100).alias("vol_30"), r2(c("std_40") * year * 100).alias("vol_60"), r2(F.when(c("fell") < 2, 0.0).otherwise(c("down") * year * 100)).alias("down_30"),
        *[r2(F.when(c(f"std_{n}") == 0, 0.0).otherwise(c(f"mean_{n}") / c(f"std_{n}") * year)).alias(name) for n, name in ((20, "sharpe_30"), (40, "sharpe_60"))],
        c("mean_40").alias("mean_40"), c("mean_tail").alias("mean_60"), *[place(n).alias(name) for n, name in (("5", "pos_7"), ("20", "pos_30"), ("40", "pos_60"), ("t", "pos_90"))],
        *[r2((nav - c(f"low_{n}")) / c(f"low_{n}") * 100).alias(name) for n, name in (("5", "rebound_7"), ("20", "rebound_30"))],
        *[r2((c(f"high_{n}") - nav) / c(f"high_{n}") * 100).alias(name) for n, name in (("5", "pullback_7"), ("20", "pullback_30"))],
        rsi(6).alias("rsi_6"), rsi(14).alias("rsi_14"),
        round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(c("dev") == 0, 50.0).otherwise((nav - (c("mid") - c("dev") * 2)) / (c("dev") * 4) * 100))), 1).alias("bb_pos"),
        r2(c("dev") * 4 / c("mid") * 100).alias("bb_width"), r2(c("skew") * F.pow((n40 - 1) / n40, F.lit(1.5))).alias("skew"),
        r2((nav / lag(2) - 1) * 100 - (lag(3) / lag(5) - 1) * 100).alias("accel"), r2(ewma).alias("ewma"), round_half_up(F.col("win_30") / 20 * 100, 1).alias("win_30"), "vol_pop_30", "vol_pop",
        "raw_5", "raw_10", "raw_20", ((nav - lag(4)) / lag(4) * 100).alias("slope"), ((lag(9) - lag(19)) / lag(19) * 100).alias("long_slope"), "gain_14", "loss_14",
        *[f"after_{h}" for h in scoring.HORIZONS], *[((nav / lag(h) - 1) * 100).alias(f"prev_{h}") for h in scoring.HORIZONS],
        F.when(F.col("sign") == 0, 0).otherwise(F.col("run")).cast("long").alias("streak_days"), F.when(F.col("sign") > 0, "上涨").when(F.col("sign") < 0, "下跌").otherwise("平").alias("streak_dir"),
        round_half_up(F.col("pct_of"), 1).alias("pct"), "macd_hist", "macd_cross", "macd_dir",
    )
    calmar = lambda mean, dd: r2(F.when(F.col(dd) == 0, 0.0).otherwise(F.col(mean) * YEAR * 100 / F.col(dd)))
    regime = F.when(F.col("pct") > 75, "高波动").when(F.col("pct") < 25, "低波动").otherwise("正常")
    trend = trend_b_label(*(F.col(x) for x in ("nav", "ma_5", "ma_10", "ma_20", "ma_60")))
    return out.withColumns({"calmar_60": calmar("mean_40", "dd_60"), "calmar_90": calmar("mean_60", "dd_90"), "regime": regime, "trend": trend}).drop("mean_40", "mean_60")


def market_regime() -> Column:
    """SCR-6: trending, mean_reverting or high_volatility."""
    daily = F.when(F.coalesce(F.col("vol_pop"), F.lit(0.0)) > 0, F.col("vol_pop")).otherwise(FALLBACK_VOL)
    s, m, g, slope, lslope = (F.col(c) for c in ("raw_5", "raw_10", "raw_20", "slope", "long_slope"))
    rsi = 100 - 100 / (1 + F.col("gain_14") / F.when(F.col("loss_14") > 0, F.col("loss_14")).otherwise(1e-10))
    spread = F.abs(s - g) / g * 100
    steady = (F.abs(slope) > 0.3) & (((s > m) & (m > g) & (((slope > 0) & (lslope > -0.5)) | ((slope < 0) & (lslope < 0.5)))) | ((s < m) & (m < g)))
    return F.when(daily * F.sqrt(F.lit(YEAR)) * 100 > 35, "high_volatility").when(steady, "trending").when((spread < 1.0) | (((rsi < 25) | (rsi > 75)) & (spread < 2.0)), "mean_reverting").otherwise("trending")


def label(x: Column, threshold: Column | float) -> Column:
    return F.when(x > threshold, "up").when(x < -threshold, "down").otherwise("sideways")


def _scored(base: DataFrame) -> DataFrame:
    """base by horizon, with its scores and the probability of a rise. An array of horizons is exploded, so base is read once."""
    base = base.withColumn("market", market_regime())
    sigma = F.when(F.coalesce(F.col("vol_pop"), F.lit(0.0)) > 0, F.col("vol_pop")).otherwise(FALLBACK_VOL)
    each = [
        F.struct(F.lit(h).alias("horizon"), F.expr(scoring.direction_score(h)).alias("score"), F.col(f"after_{h}").alias("after"), F.col(f"prev_{h}").alias("prev_return"), F.greatest(F.lit(FLOORS[h]), sigma * F.sqrt(F.lit(float(h))) * 100).alias("t"))
        for h in scoring.HORIZONS
    ]
    out = base.withColumn("x", F.explode(F.array(*each))).select("*", "x.*").drop("x", *[f"after_{h}" for h in scoring.HORIZONS], *[f"prev_{h}" for h in scoring.HORIZONS])
    return out.withColumn("adjusted", F.expr(scoring.binary_score_by_horizon())).withColumn("probability", F.expr(scoring.up_probability("horizon", days="look")))


def samples(p: DataFrame) -> DataFrame:
    """D4: a row for each (code, horizon, i) whose outcome is known: score, prediction, threshold, outcome, probability of a rise."""
    out = _scored(features(p)).where(F.col("after").isNotNull()).withColumn("i", F.col("i") + 1)
    adjusted = F.when((F.col("market") == "mean_reverting") & (F.col("rsi_14") < 30), F.col("score") + 8).when((F.col("market") == "mean_reverting") & (F.col("rsi_14") > 70), F.col("score") - 8).when(F.col("market") == "high_volatility", F.col("score") * 0.75).otherwise(F.col("score"))
    out = out.withColumns({"raw_score": adjusted, "threshold": F.least(F.lit(20.0), F.col("t")), "ret": (F.col("after") - F.col("nav")) / F.col("nav") * 100})
    prediction = F.when(F.col("raw_score") >= 12, "up").when(F.col("raw_score") <= -12, "down").otherwise("sideways")
    out = out.withColumns({"prediction": prediction, "actual": label(F.col("ret"), F.col("threshold")), "momentum": label(F.col("prev_return"), F.col("threshold"))})
    return out.withColumns({"up": F.col("ret") > 0, "momentum_up": F.col("prev_return") > 0}).drop("t", "after", "look")


def present(p: DataFrame) -> DataFrame:
    """A row for each code and horizon: the features and the probability of its newest row, whose outcome nobody knows."""
    return _scored(features(p, present=True)).drop("t", "after", "look")
