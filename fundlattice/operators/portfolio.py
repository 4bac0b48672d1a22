"""Portfolios: cleaning, upsert and delete, order of priority, totals and warnings; market and macro summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlattice.functions.numeric import first_distinct, round_half_up

PRIORITY = ("reduce", "avoid", "observe", "hold", "buy_watch")


def valid_codes(df: DataFrame, col: str = "code") -> DataFrame:
    """FLT-7: codes of five or six digits."""
    return df.where(F.trim(col).rlike("^[0-9]{5,6}$"))


def dedup_last_wins(df: DataFrame, key: str = "code", order: str = "ord") -> DataFrame:
    """REL-8: of rows with one key the last stays, at the place of the first; an aggregate with partial sums, not a window."""
    row = F.struct(*[c for c in df.columns if c not in (key, order)])
    return df.groupBy(key).agg(F.min(order).alias("place"), F.max_by(row, order).alias("x")).select(key, "place", "x.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """SNK-2: rows of new replace rows of old with their key; others are added."""
    return old.join(new, key, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, key: str = "code") -> DataFrame:
    """SNK-3, JOIN-9: rows of old without those of gone; see missing_keys for what gone names in vain."""
    return old.join(gone.select(key).distinct(), key, "left_anti")


def missing_keys(old: DataFrame, gone: DataFrame, key: str = "code") -> DataFrame:
    """SNK-3: keys to delete that old does not have, to be reported."""
    return gone.select(key).distinct().join(old.select(key), key, "left_anti")


def priority_order(df: DataFrame) -> DataFrame:
    """REL-7: rank by action, then risk (highest first), then code."""
    place = F.lit(99)
    for n, action in enumerate(PRIORITY):
        place = F.when(F.coalesce("action", F.lit("observe")) == action, n).otherwise(place)
    out = df.withColumn("priority", place)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("portfolio").orderBy("priority", F.desc(F.coalesce("risk_score", F.lit(0.0))), "code")))


def summary(df: DataFrame) -> DataFrame:
    """AGG-20: by portfolio, counts by action, holdings, profit and risk; one aggregate with partial sums."""
    units = F.coalesce(F.when(F.col("holding_units") != 0, F.col("holding_units")), F.when(F.col("holding_amount") != 0, F.col("holding_amount") / F.col("cost_nav")), F.lit(0.0))
    counted = (F.col("cost_nav") > 0) & F.col("nav").isNotNull() & (units > 0)
    counts = [F.count_if(F.col("action") == a).alias(f"n_{a}") for a in PRIORITY]
    out = df.groupBy("portfolio").agg(
        F.count("*").alias("funds"), *counts, F.sum(F.coalesce("holding_amount", F.lit(0.0))).alias("total_holding"),
        F.sum(F.when(counted, (F.col("nav") - F.col("cost_nav")) * units)).alias("pnl"), F.sum(F.when(counted, F.col("cost_nav") * units)).alias("cost"),
        F.avg("risk_score").alias("mean_risk"), F.count_if(F.col("risk_score") > 70).alias("high_risk"), F.count_if(F.col("quality") == "low").alias("low_quality"),
        F.count_if((F.col("nav") - F.col("cost_nav")) / F.col("cost_nav") * -100 >= F.col("max_loss_percent") * 0.7).alias("near_max_loss"),
    )
    return out.withColumn("pnl_pct", F.try_divide(F.col("pnl"), F.col("cost")) * 100)


def warnings(s: DataFrame) -> DataFrame:
    """AGG-21: which warnings hold for each portfolio's totals, in order, at most five."""
    found = F.array_compact(F.array(
        F.when(F.col("high_risk") / F.col("funds") > 0.3, "high_risk"), F.when(F.col("n_reduce") + F.col("n_avoid") > 0, "reduce_first"), F.when(F.col("n_buy_watch") > 0, "opportunity"),
        F.when(F.col("low_quality") / F.col("funds") > 0.5, "low_quality"), F.when(F.col("near_max_loss") > 0, "near_max_loss"),
    ))
    return s.select("portfolio", F.array_join(F.when(F.size(found) > 0, F.slice(found, 1, 5)).otherwise(F.array(F.lit("none"))), ",").alias("warnings"))


def market_sentiment(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-22: sentiment and money flow from the changes of indices."""
    out = df.groupBy(*keys).agg(F.avg("change_pct").alias("mean"), F.count_if(F.col("change_pct") > 0).alias("up"), F.count("change_pct").alias("n"))
    m, share = F.col("mean"), F.col("up") / F.col("n")
    mood = F.when((m > 1.5) & (share >= 0.75), "very_bullish").when((m > 0.5) & (share >= 0.6), "bullish").when((m < -1.5) & (share <= 0.25), "very_bearish").when((m < -0.5) & (share <= 0.4), "bearish").otherwise("neutral")
    flow = F.when(m > 0.8, "strong_inflow").when(m > 0.3, "inflow").when(m < -0.8, "strong_outflow").when(m < -0.3, "outflow").otherwise("neutral")
    return out.withColumns({"sentiment": F.coalesce(mood, F.lit("neutral")), "flow": F.coalesce(flow, F.lit("neutral"))})


def macro_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-23 from columns us_change, usdcny, on_rate, m1_rate (null where a source gives nothing)."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("us_change", "usdcny", "on_rate", "m1_rate")])
    us, on = F.col("us_change"), F.col("on_rate")
    first = F.when(us > 1, "risk-on").when(us < -1, "risk-off").otherwise("neutral")
    spread = F.col("m1_rate") - on
    liquidity = F.when(spread < 0.1, "tight").when(on > 2.5, "tight").when(on < 1.5, "loose").when(on.isNotNull(), "neutral").otherwise("unknown")
    appetite = F.when((on > 2.5) & (first == "risk-on"), "neutral").when((on < 1.5) & (first == "neutral"), "risk-on").otherwise(first)
    fx = F.when(F.col("usdcny") > 7.3, "贬值压力较大").when(F.col("usdcny") > 7.1, "有一定贬值压力").otherwise("stable")
    return out.withColumns({"overseas": F.when(us > 1, "bullish").when(us < -1, "bearish").otherwise("mixed"), "risk_appetite": appetite, "liquidity": liquidity, "forex_pressure": fx, "spread": spread})


def macro_risks(df: DataFrame, commodities: bool = False) -> DataFrame:
    """AGG-24, REL-9: the list of macro risks that hold, in order, each once; commodities: some are quoted."""
    us, fx, on = F.col("us_change"), F.col("usdcny"), F.col("on_rate")
    some = us.isNotNull() | fx.isNotNull()
    # fixed values: bounds and texts
    rules = [
        (us < -1, "纳斯达克指数下跌，科技股风险偏好下降"), (fx > 7.2, "人民币汇率承压，可能影响跨境资金流动和外资持仓偏好"), (F.lit(commodities), "大宗商品价格波动可能影响相关行业板块"),
        (on > 2.5, "SHIBOR隔夜利率偏高，短期资金面偏紧，可能对股市估值形成压力"), (on < 1.2, "银行间流动性极度宽松，需关注资金空转和政策调控风险"),
        (some, "国际地缘政治风险可能影响全球资本市场情绪"), (some, "美联储货币政策不确定性可能影响全球流动性和QDII基金表现"),
    ]
    return df.withColumn("risks", first_distinct(F.array_compact(F.array(*[F.when(c, text) for c, text in rules])), len(rules)))


# fixed values: words for sentiment and flow
MOODS = {"very_bullish": "非常乐观", "bullish": "偏乐观", "neutral": "中性", "bearish": "偏悲观", "very_bearish": "非常悲观"}
FLOWS = {"strong_inflow": "大幅流入", "inflow": "净流入", "neutral": "平衡", "outflow": "净流出", "strong_outflow": "大幅流出"}


def market_context(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """DEC-6: the market in words: each index with its change, sentiment and money flow; one text for each of keys."""
    line = F.concat(F.lit("  - "), F.col(name).cast("string"), F.format_string(": %+.2f%%", round_half_up(F.col("change_pct"), 2)))
    lines = df.where("change_pct is not null").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    word = lambda c, words: F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col(c))
    text = F.concat(F.lit("## 市场环境\n主要指数:\n"), F.col("lines"), F.lit("\n市场情绪: "), word("sentiment", MOODS), F.lit("\n资金流向: "), word("flow", FLOWS))
    return market_sentiment(df, keys).join(lines, keys, "left").select(*keys, F.coalesce(text, F.lit("市场环境数据不可用")).alias("context"))


def with_results(positions: DataFrame, results: DataFrame) -> DataFrame:
    """JOIN-8: each position with its code's results, if there are any; results have one row for each code."""
    return positions.join(results, "code", "left")
