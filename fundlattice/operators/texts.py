"""What scores, forecasts, advice and decisions rest on, in words: reasons, triggers, warnings, conditions and watch lists.

A ladder is an ordered list of steps (condition, reason, what speaks for a rise next, what for a fall); the first step that holds
speaks. All ladders of a row are one array of structs, which is evaluated once; reasons and triggers are picked out of it, in order,
each once. In a text, {name} stands for the row's value of that column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlattice.operators import decisions as dec
from fundlattice.operators.scoring import BEARISH, DOWNWARD, UPWARD

Step = tuple[str, str, list[str], list[str]]


def said(text: str) -> str:
    """A text as a SQL expression; {name} is the column's value."""
    parts = [p for p in re.split(r"(\{\w+\})", text) if p]
    pieces = [p[1:-1] if p.startswith("{") else f"'{p}'" for p in parts]
    return pieces[0] if len(pieces) == 1 and not parts[0].startswith("{") else f"concat({', '.join(pieces)})"


def _list(texts: list[str]) -> str:
    return f"array({', '.join(map(said, texts))})" if texts else "CAST(array() AS array<string>)"


def _spoken(ladder: list[Step]) -> str:
    steps = " ".join(f"WHEN {c} THEN named_struct('reason', {said(reason) if reason else 'CAST(NULL AS STRING)'}, 'up', {_list(up)}, 'down', {_list(down)})" for c, reason, up, down in ladder)
    return f"CASE {steps} END"


# fixed values: bounds and texts of the scores' reasons and triggers, down to DEFAULT_DOWN
CROSSING, TURNING = "均线出现死叉，或跌破60日均线支撑", "出现放量反弹且站上20日均线，均线开始走平"
TREND: list[Step] = [
    (f"{UPWARD} AND rsi_14 > 70", "均线多头但RSI超买，追高风险大", [], ["RSI超买后回调风险", CROSSING]),
    (f"{UPWARD} AND rsi_14 > 60", "均线多头但RSI偏高，谨慎追涨", [], [CROSSING]),
    (UPWARD, "均线多头排列，趋势偏强", ["均线多头排列持续，且未出现高位放量滞涨"], [CROSSING]),
    (f"{DOWNWARD} AND rsi_14 < 30", "均线空头但RSI超卖，可能反弹", ["RSI超卖后反弹机会", TURNING], []),
    (f"{DOWNWARD} AND rsi_14 < 40", "均线空头但RSI偏低，关注反弹", [TURNING], []),
    (DOWNWARD, "均线空头排列，趋势偏弱", [TURNING], ["空头排列延续，继续创新低"]),
    ("trend LIKE '%偏多%'", "均线偏多震荡", [], []),
    ("trend LIKE '%偏空%'", "均线偏空震荡", [], []),
    ("TRUE", "均线横盘整理，缺乏明确方向", [], []),
]
#: The returns that a horizon judges: (days, column, horizons).
FEW_DAYS = [(1, "ret_1", "1, 3"), (5, "ret_5", "1, 3, 7")]
MORE_DAYS = [(7, "ret_7d", "1, 3, 7"), (30, "ret_30d", "7, 30"), (60, "ret_60d", "30"), (90, "ret_90d", "30")]


def _few(days: int, c: str, horizons: str) -> list[Step]:
    return [
        (f"horizon NOT IN ({horizons})", "", [], []),
        (f"{c} > 2.5 AND (rsi_14 > 65 OR pos_30 > 80)", f"近{days}个交易日涨幅较强({{{c}}}%)但已高位，追高风险", [], ["短期大涨后高位回调风险"]),
        (f"{c} > 2.5", f"近{days}个交易日涨幅较强({{{c}}}%)，短线动能偏强", [f"近{days}个交易日动能延续且回撤不扩大"], ["短线快速上涨后出现回吐，需防止冲高回落"]),
        (f"{c} > -1", "", [], []),
        (f"{c} > -2.5", f"近{days}个交易日下跌({{{c}}}%)", [], []),
        ("rsi_14 < 35 OR pos_30 < 20", f"近{days}个交易日跌幅较大({{{c}}}%)但已超卖，关注反弹", ["超卖反弹机会"], []),
        ("TRUE", f"近{days}个交易日跌幅较大({{{c}}}%)，短线承压", [], ["短线跌势未止，继续跌破前低"]),
    ]


def _more(days: int, c: str, horizons: str) -> list[Step]:
    fast = f"近{days}天涨幅过快后出现高位放量回落"
    return [
        (f"horizon NOT IN ({horizons})", "", [], []),
        (f"{c} > 10 AND (pos_60 > 85 OR rsi_14 > 70)", f"近{days}天涨幅较大({{{c}}}%)但已高位", [], [fast]),
        (f"{c} > 10", f"近{days}天涨幅较大({{{c}}}%)，短期动能强", [f"近{days}天涨幅延续且成交量配合"], [fast]),
        (f"{c} > -3", "", [], []),
        (f"{c} > -7", f"近{days}天下跌({{{c}}}%)", [], []),
        (f"{c} > -15 AND (pos_60 < 25 OR rsi_14 < 35)", f"近{days}天跌幅较大({{{c}}}%)但已低位，关注反弹", [], []),
        (f"{c} > -15", f"近{days}天跌幅较大({{{c}}}%)", [], []),
        ("TRUE", f"近{days}天跌幅显著({{{c}}}%)，下行压力大", [], ["下跌趋势未止住，继续新低"]),
    ]


STANDING, FALLEN = "净值站上5日、10日均线，短线结构偏强", "净值低于5日、10日均线，短线结构偏弱"
RUN_UP, RUN_DOWN = "连续上涨后单日转跌且跌幅扩大", "连续下跌后出现止跌阳线并收复5日均线"
ABOVE, BELOW = "nav > ma_5 AND ma_5 > ma_10", "nav < ma_5 AND ma_5 < ma_10"
LADDERS: list[list[Step]] = [
    TREND,
    *(_few(*x) for x in FEW_DAYS),
    *(_more(*x) for x in MORE_DAYS),
    *[[(f"dd_{n} > 15", f"近{n}天最大回撤较大({{dd_{n}}}%)", [], [])] for n in (30, 60)],
    [("horizon IN (1, 30) AND dd_90 > 15", "近90天最大回撤较大({dd_90}%)", [], [])],
    [
        ("high_vol AND vol_30 > 35", "高波动基金，近30天波动率{vol_30}%，不确定性高", [], []), ("vol_30 > 35", "近30天波动率极高({vol_30}%)，方向不确定性强", [], []),
        ("vol_30 > 25", "近30天波动率较高({vol_30}%)", [], []), ("vol_30 < 10", "波动率较低({vol_30}%)，走势相对平稳", [], []),
    ],
    [("horizon IN (3, 7) AND sharpe_30 < -1", "夏普比率为负，风险调整后收益不佳", [], [])],
    [
        ("pos_30 > 80 AND vol_30 > 25", "净值在近30日高位且波动高，追高风险", [], ["高位放量回落，跌破短期均线"]),
        (f"pos_30 < 20 AND {BEARISH}", "净值在近30日低位但趋势仍空头，左侧风险", [], ["继续创新低，下跌趋势未结束"]),
        ("pos_30 < 20", "净值在近30日低位，可能接近阶段性底部", ["低位企稳，出现连续放量阳线"], []),
    ],
    [("pos_60 > 85", "净值在近60日高位区间", [], [])],
    [("pos_90 < 15", "净值在近90日低位区间", [], [])],
    [("rebound_30 > 8", "近期反弹强度{rebound_30}%", ["反弹持续且放量站上关键均线"], ["反弹遇阻回落，跌破反弹起点"])],
    [("pullback_30 > 8", "近期从高点回落{pullback_30}%", [], ["回落幅度扩大，形成下降通道"])],
    [("win_30 < 40", "近30天上涨胜率仅{win_30}%", [], [])],
    [("macro_ok AND risk_appetite = 'risk-off'", "宏观风险偏好偏避险", [], [])],
    [("macro_ok AND liquidity = 'tight'", "银行间资金面偏紧，流动性收缩不利于风险资产", [], []), ("macro_ok AND liquidity = 'loose' AND risk_appetite <> 'risk-off'", "银行间资金面宽松，流动性充裕支持风险资产", [], [])],
    [("nav <= ma_20", "净值低于20日均线", [], [])],
    [
        (f"horizon = 1 AND {ABOVE}", STANDING, ["继续站稳5日均线且单日回撤收窄"], []), (f"horizon = 3 AND {ABOVE}", STANDING, ["继续站稳5日均线且3日回撤收窄"], []),
        (f"horizon IN (1, 3) AND {BELOW}", FALLEN, [], ["跌破5日均线后继续低于10日均线"]),
    ],
    [
        ("horizon = 1 AND streak_days >= 3 AND streak_dir = '上涨'", "已连续上涨{streak_days}天，短线惯性偏强但需防回吐", [], [RUN_UP]), ("horizon = 3 AND streak_days >= 3 AND streak_dir = '上涨'", "已连续上涨{streak_days}天，短线惯性偏强", [], [RUN_UP]),
        ("horizon IN (1, 3) AND streak_days >= 3 AND streak_dir = '下跌'", "已连续下跌{streak_days}天，短线仍承压", [RUN_DOWN], []),
    ],
    [
        ("horizon = 1 AND accel > 1", "5日动能加速度为{accel}%，短线动能改善", [], []), ("horizon = 1 AND accel < -1", "5日动能加速度为{accel}%，短线动能转弱", [], []),
        ("horizon = 3 AND accel > 1", "5日动能加速度为{accel}%，动能改善", [], []), ("horizon = 3 AND accel < -1", "5日动能加速度为{accel}%，动能转弱", [], []),
    ],
    [
        ("horizon = 1 AND pos_7 > 85 AND ret_1 > 0", "净值接近7日高位，次日追高回撤风险上升", [], []), ("horizon = 3 AND pos_7 > 85 AND ret_1 > 0", "净值接近7日高位，3日追高回撤风险上升", [], []),
        ("horizon = 1 AND pos_7 < 15 AND ret_1 < 0 AND NOT trend LIKE '%空头%'", "净值接近7日低位，存在短线修复可能", [], []), ("horizon = 3 AND pos_7 < 15 AND ret_1 < 0 AND NOT trend LIKE '%空头%'", "净值接近7日低位，存在3日修复可能", [], []),
    ],
    [("horizon IN (1, 3) AND pullback_7 > 3", "近7日从高点回落{pullback_7}%", [], [])],
    [("horizon = 7 AND ret_1 > 0 AND ret_5 > 0 AND accel > 0", "1日、5日动能同步为正，7日方向偏强", [], []), ("horizon = 7 AND ret_1 < 0 AND ret_5 < 0 AND accel < 0", "1日、5日动能同步为负，7日方向承压", [], [])],
    [
        ("horizon = 7 AND ewma > 0 AND vol_30 > 0 AND ewma > vol_30 * 1.15e0", "EWMA短线波动高于30日波动，近期不确定性上升", [], []),
        ("horizon = 7 AND ewma > 0 AND vol_30 > 0 AND ewma < vol_30 * 0.85e0", "短线波动有所收敛，7日判断稳定性略有改善", [], []),
    ],
    [("qdii AND macro_ok AND overseas = 'bearish'", "海外市场偏弱，QDII基金可能承压", [], []), ("qdii AND macro_ok AND overseas = 'bullish'", "海外市场偏强，有利于QDII基金", [], [])],
    [("china AND macro_ok AND risk_appetite = 'risk-on'", "国内权益类基金受风险偏好改善支撑", [], []), ("china AND macro_ok AND risk_appetite = 'risk-off'", "国内权益类基金受风险偏好走弱压制", [], [])],
    [("defensive", "债券/货币等低波动品类，涨跌弹性相对有限", [], [])],
    [("regime = '高波动'", "当前波动率处于较高分位，预测误差可能放大", [], [])],
    [
        ("rsi_14 > 75", "RSI(14)={rsi_14}，处于超买区间，短期回调风险累积", [], ["RSI从超买区间回落，配合量能放大"]), ("rsi_14 > 65", "RSI(14)={rsi_14}，偏强但接近超买", [], []),
        ("rsi_14 > 0 AND rsi_14 < 25", "RSI(14)={rsi_14}，处于超卖区间，技术性反弹概率上升", ["RSI从超卖区间回升，配合量能放大"], []), ("rsi_14 > 0 AND rsi_14 < 35", "RSI(14)={rsi_14}，偏弱但接近超卖，关注企稳信号", [], []),
    ],
    [("rsi_14 > 0 AND rsi_6 > rsi_14 + 5", "短期RSI上穿长期RSI，短线动能改善", [], []), ("rsi_6 > 0 AND rsi_6 < rsi_14 - 5", "短期RSI下穿长期RSI，短线动能转弱", [], [])],
    [
        ("macd_cross = 'golden' AND horizon <= 7", "MACD金叉，技术面发出看多信号", ["金叉后DIF继续上行且柱状线扩大"], ["金叉失败，DIF重新下穿DEA"]), ("macd_cross = 'golden'", "MACD金叉，中期趋势可能转好", [], []),
        ("macd_cross = 'dead' AND horizon <= 7", "MACD死叉，技术面发出看空信号", ["死叉失效，DIF重新上穿DEA"], ["死叉后DIF继续下行且柱状线扩大"]), ("macd_cross = 'dead'", "MACD死叉，中期趋势可能转弱", [], []),
    ],
    [
        ("macd_dir = 'rising' AND macd_hist < 0", "MACD绿柱收窄，空方动能减弱", [], []), ("macd_dir = 'falling' AND macd_hist > 0", "MACD红柱收窄，多方动能减弱", [], []),
        ("macd_dir = 'falling' AND macd_hist < 0", "MACD绿柱扩大，空方动能增强", [], []), ("macd_dir = 'rising' AND macd_hist > 0", "MACD红柱扩大，多方动能增强", [], []),
    ],
    [("bb_pos >= 95", "净值触及布林带上轨，短期超买，回档压力增大", [], ["从布林带上轨回落且跌破中轨"]), ("bb_pos <= 5", "净值触及布林带下轨，短期超卖，技术反弹概率上升", ["从布林带下轨反弹且站上中轨"], [])],
    [("horizon >= 7 AND bb_width > 20", "布林带宽度{bb_width}%，波动较大，方向不确定性高", [], []), ("horizon >= 3 AND bb_width < 5", "布林带收窄，可能酝酿方向性突破", [], [])],
    [("horizon >= 7 AND skew < -0.8e0", "近期收益率左偏（skew={skew}），极端负收益出现概率偏高", [], []), ("horizon >= 7 AND skew > 0.8e0", "近期收益率右偏（skew={skew}），正收益分布占优", [], [])],
]
#: What a forecast adds to its score's reasons.
CONFLICTS = [
    (f"ret_30d > 3 AND {BEARISH}", "短期反弹但中期趋势仍为空头"), (f"pos_30 < 25 AND {BEARISH}", "处于低位但下跌趋势未结束"),
    ("pos_30 > 75 AND trend LIKE '%多头%' AND ret_30d > 10", "趋势偏多但处于高位，追高风险"), ("rebound_30 > 10 AND vol_30 > 30", "反弹力度强但波动率仍高，方向不确定"),
]
IN_CONFLICT = "CASE WHEN conflicts <> '' THEN concat(CASE WHEN horizon >= 7 THEN '多空信号冲突：' ELSE '注意信号冲突：' END, conflicts) END"
ADDED: list[list[Step]] = [
    [("risk_score > 70", "综合风险评分较高，下行不确定性大", [], [])],
    [("high_vol", "该基金类型波动性较大，概率判断的不确定性较高", [], [])],
    [
        (f"NOT coalesce({dec.FRESH}, FALSE) OR horizon = 30", "", [], []),
        ("estimate_change > 1", "当日估算涨跌{estimate_change}%（非正式净值）", ["当日估算继续转强并收复5日均线"], []),
        ("estimate_change < -1", "当日估算涨跌{estimate_change}%（非正式净值）", [], ["当日估算继续走弱且跌破前低"]),
        ("TRUE", "当日估算涨跌{estimate_change}%（非正式净值）", [], []),
    ],
]
MOST_REASONS, MOST_TRIGGERS = 6, 4
SHORT_HISTORY, AWAIT = "历史数据少于60个交易日，中期预测置信度低", "数据充足后再进行评估"
DEFAULT_UP = ["放量站上20日均线且均线开始拐头向上", "短期回撤企稳且出现连续阳线"]
DEFAULT_DOWN = ["跌破近期关键支撑位且放量", "均线出现空头排列信号"]


def _picked(ladders: list[list[Step]]) -> Column:
    return F.filter(F.expr(f"array({', '.join(map(_spoken, ladders))})"), lambda x: x.isNotNull())


def _reasons(told: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(told, lambda x: x["reason"]), lambda r: r.isNotNull()))


def _triggers(told: Column, side: str) -> Column:
    return F.slice(F.array_distinct(F.flatten(F.transform(told, lambda x: x[side]))), 1, MOST_TRIGGERS)


def _texts(texts: list[str]) -> Column:
    return F.array(*map(F.lit, texts))


def score_texts(df: DataFrame) -> DataFrame:
    """SCR-1: df (indicators of a row and a horizon, see calendar.neutral) with reasons, up_triggers and down_triggers of its score.

    Every reason is told once; of triggers the first four. A missing indicator gives no text of its own.
    """
    out = df.withColumn("_told", _picked(LADDERS))
    return out.withColumns({"reasons": _reasons(F.col("_told")), "up_triggers": _triggers(F.col("_told"), "up"), "down_triggers": _triggers(F.col("_told"), "down")}).drop("_told")


def forecast_texts(df: DataFrame) -> DataFrame:
    """SCR-9, SCR-17: rows of decisions.forecast with reasons (at most six, and a note on short histories) and triggers of each forecast.

    A horizon whose gate is closed says only that there is too little history for it. Where nothing speaks for a side, two
    triggers that always hold do.
    """
    short = F.col("gate") == "insufficient"
    conflicts = "concat_ws('；', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in CONFLICTS) + ")"
    out = df.withColumns({"_told": _picked(LADDERS + ADDED), "conflicts": F.expr(conflicts)})
    reasons = F.slice(F.array_distinct(F.concat(_reasons(F.col("_told")), F.array_compact(F.array(F.expr(IN_CONFLICT))))), 1, MOST_REASONS)
    reasons = F.when(F.col("gate") == "low_confidence", F.concat(reasons, _texts([SHORT_HISTORY]))).otherwise(reasons)
    too_short = F.concat(F.lit("历史数据仅"), F.col("i") + 1, F.lit("个交易日，不足以进行"), F.col("horizon"), F.lit("天情景判断"))
    out = out.withColumns({"reasons": F.when(short, F.array(too_short)).otherwise(reasons)})
    for side, default in (("up", DEFAULT_UP), ("down", DEFAULT_DOWN)):
        found = _triggers(F.col("_told"), side)
        out = out.withColumn(f"{side}_triggers", F.when(short, _texts([AWAIT])).when(F.size(found) == 0, _texts(default)).otherwise(found))
    return out.drop("_told", "conflicts")


# SCR-16
# fixed values: texts of the support for decisions
INVALIDATION = ["净值跌破60日均线且放量", "波动率突破历史高位（分位>80%）", "连续3个交易日下跌且跌幅扩大"]
MODEL_NOTE = "CASE WHEN coalesce(quality, 'low') = 'low' THEN '回测未证明规则模型稳定优于基准模型，概率仅作低置信参考，历史回测不代表未来表现。' ELSE '历史回测准确率不代表未来表现，决策应结合多方信息。' END"
NO_BUY, NO_REDUCE = "等待更多信号", "关注风险评级"


def decision_support(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """SCR-16: for each row what would speak for buying and for selling, of the first two triggers of 7 and 30 days, three at most.

    forecasts: forecast_texts with the forecast's columns, risk_score and quality; keys name a row that has forecasts. One
    aggregation by keys, over two rows each.
    """
    return forecasts.where("horizon IN (7, 30)").groupBy(*keys).agg(*support_sums()).select(*keys, *support_columns())


def support_sums() -> list[Column]:
    """The aggregates over a row's forecasts that support_columns reads."""
    from fundlattice.operators.documents import ACTION_BIAS

    at = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    two = lambda h, side: F.slice(F.coalesce(at(h, f"{side}_triggers"), F.array().cast("array<string>")), 1, 2)
    watch = lambda side: F.slice(F.array_distinct(F.concat(two(7, side), two(30, side))), 1, 3)
    bias = F.max(F.when(F.col("horizon") == 7, F.struct(F.expr(ACTION_BIAS).alias("bias"), F.expr(MODEL_NOTE).alias("note"))))
    return [bias.alias("_b"), watch("up").alias("_up"), watch("down").alias("_down")]


def support_columns() -> list[Column]:
    filled = lambda c, text: F.when(F.size(c) > 0, F.col(c)).otherwise(_texts([text]))
    return [F.col("_b.bias").alias("action_bias"), filled("_up", NO_BUY).alias("buy_watch"), filled("_down", NO_REDUCE).alias("reduce_watch"), _texts(INVALIDATION).alias("invalidation_signals"), F.col("_b.note").alias("model_quality_note")]


# DEC-1
HELD = dec.HAS_POSITION
WEAK = f"({dec.says('text_7d', dec.DOWN_WORDS)} OR {dec.says('text_30d', dec.DOWN_WORDS)})"
STRONG = f"({dec.says('text_7d', dec.UP_WORDS)} AND {dec.says('text_30d', dec.UP_WORDS)})"
#: Which rule of DEC-1 has spoken.
RULE = f"CASE WHEN risk_score >= 75 THEN 'high_risk' WHEN {WEAK} AND risk_score > 55 THEN 'weak' WHEN risk_score >= 60 THEN 'raised_risk' WHEN {STRONG} AND risk_score < 55 AND {dec.TRUSTED} THEN 'strong' ELSE 'open' END"
# fixed values: texts of the advice, by rule and whether there is a position (None: either), down to LABELS
ADVICE_TEXTS = {
    "advice_reasons": [
        ("high_risk", True, "综合风险评分较高（≥75），当前市场环境不利，可考虑降低仓位风险。"), ("high_risk", False, "综合风险评分较高（≥75），当前不适合新开仓或大额买入。"),
        ("weak", True, "短期走势偏弱且风险评分偏高（>55），当前不适合追加仓位。"), ("weak", False, "短期走势偏弱且风险评分偏高（>55），适合暂时观望，等待方向明朗。"),
        ("raised_risk", True, "风险评分偏高（≥60），适合谨慎持有，暂不追加仓位。"), ("raised_risk", False, "风险评分偏高（≥60），若确有意向可小额试探，不宜大额买入。"),
        ("strong", None, "短期和中期走势均偏强，风险评分较低，回测验证可接受，可考虑分批关注。"), ("strong", None, "分多批关注有助于避免一次性满仓，降低择时风险。"),
    ],
    "advice_warnings": [
        ("high_risk", True, "风险评分处于高位，继续持有可能面临较大回撤。"), ("high_risk", False, "高风险环境下追高买入不确定性较大，适合等待风险释放后再评估。"),
        ("weak", True, "走势偏弱叠加风险偏高，若继续下行需关注止损。"), ("weak", False, "走势偏弱环境下买入容易被套，耐心等待企稳信号。"),
        ("raised_risk", True, "风险处于偏高水平，需密切关注市场变化和个人止损线。"), ("raised_risk", False, "当前风险水平下大额买入需承担较大不确定性。"),
        ("strong", None, "即使信号偏积极，仍需控制总仓位，避免一次性满仓。"),
    ],
    "buy_conditions": [
        ("weak", False, "等待7日或30日走势企稳（方向转为偏强或震荡），且风险评分回落至55以下。"), ("raised_risk", False, "试探仓位参考计划金额的10%-20%，确认走势企稳后再考虑追加。"),
        ("strong", None, "分2-3批关注，每批间隔至少3-5个交易日，观察走势是否持续偏强。"), ("strong", None, "若关注期间走势转弱或风险评分上升至55以上，暂停后续批次。"),
        ("open", None, "等待7日、30日走势方向一致偏强且风险评分低于55。"),
    ],
    "sell_conditions": [("high_risk", True, "若跌破个人止损线或关键支撑位，应重新评估是否继续持有。"), ("weak", True, "若连续下破关键支撑或亏损扩大，可考虑降低仓位风险。")],
    "invalidation_signals": [("high_risk", False, "若风险评分回落至60以下且走势企稳，可重新评估。"), ("strong", None, "若7日方向转弱或风险评分突破55，暂停关注计划。")],
}
DISTRUST = {"advice_reasons": "回测未证明模型稳定优于基线，方向判断仅低置信参考。", "advice_warnings": "模型概率估计尚不稳定，情景判断可能偏差较大。", "invalidation_signals": "后续需以新的回测结果验证模型是否稳定优于基线。"}
UNDECIDED = "当前信号不够明确，适合观望等待更清晰的方向选择。"
NEAR_LOSS, IN_PROFIT = "浮亏已逼近最大可承受亏损（{max_loss_percent}%），若继续扩大应重新评估止损或降仓。", "浮盈状态下若风险评分持续偏高，可考虑适当降低仓位风险。"
_GAIN = "((nav - cost_nav) / cost_nav * 100)"
_LOSES = f"cost_nav > 0 AND nav IS NOT NULL AND {_GAIN} < 0 AND max_loss_percent IS NOT NULL"
_NEAR = f"{_LOSES} AND -{_GAIN} >= max_loss_percent * 0.8e0"
_GAINS = f"cost_nav > 0 AND nav IS NOT NULL AND {_GAIN} > 0 AND risk_score > 55"
POSITION_HINT = f"""CASE WHEN {_NEAR} THEN concat('当前浮亏 ', printf('%.1f', abs({_GAIN})), '%，已接近最大亏损线 ', max_loss_percent, '%，需关注止损纪律。') WHEN {_LOSES} THEN concat('当前浮亏 ', printf('%.1f', abs({_GAIN})), '%，暂在可承受范围内。')
 WHEN {_GAINS} THEN concat('当前浮盈 ', printf('%.1f', {_GAIN}), '%，但短期风险偏高，可考虑降低仓位风险。') WHEN cost_nav > 0 AND nav IS NOT NULL THEN concat('当前浮动盈亏约 ', printf('%+.1f', {_GAIN}), '%。') END"""
NAMED = "coalesce(nullif(fund_name, ''), '该基金')"
ADVICE_SUMMARY = f"""CASE WHEN advice = 'avoid' AND coalesce(cost_nav, 0) = 0 THEN concat({NAMED}, '当前风险较高，暂不适合新开仓。') ELSE concat({NAMED}, CASE advice WHEN 'avoid' THEN '风险较高，可考虑降低仓位风险。' WHEN 'reduce' THEN '风险评分高，可考虑降低仓位风险。'
 WHEN 'small_trial' THEN '可小额试探，不宜大额买入。' WHEN 'batch_buy' THEN '信号偏积极，可考虑分批关注。' WHEN 'hold' THEN '适合谨慎持有，暂不追加。' ELSE '信号不明确，适合观望等待。' END) END"""
LABELS = {"reduce": "降低仓位", "avoid": "暂缓新增", "hold": "谨慎持有", "observe": "观望", "small_trial": "小额试探", "batch_buy": "分批关注"}


def _label(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def _when(rule: str, held: bool | None) -> str:
    return f"rule = '{rule}'" + ("" if held is None else f" AND {HELD}" if held else f" AND NOT {HELD}")


def advice_texts(df: DataFrame) -> DataFrame:
    """DEC-1: rows with ADVICE_STAGES applied, and advice_label, position_hint, advice_summary and the five lists that go with them.

    Lists are typed arrays, empty where nothing is to be said; what is said of a weak backtest comes last, but first where no rule holds.
    fund_name may be missing or empty.
    """
    if "fund_name" not in df.columns:
        df = df.withColumn("fund_name", F.lit(None).cast("string"))
    out = df.withColumn("rule", F.expr(RULE))
    lists = {}
    for name, texts in ADVICE_TEXTS.items():
        items = [f"CASE WHEN {_when(rule, held)} THEN '{text}' END" for rule, held, text in texts]
        if name in DISTRUST:
            items.append(f"CASE WHEN NOT coalesce({dec.TRUSTED}, FALSE) THEN '{DISTRUST[name]}' END")
        if name == "advice_reasons":
            items.append(f"CASE WHEN rule = 'open' THEN '{UNDECIDED}' END")
        if name == "sell_conditions":
            items += [f"CASE WHEN {_NEAR} THEN {said(NEAR_LOSS)} END", f"CASE WHEN {_GAINS} THEN '{IN_PROFIT}' END"]
        lists[name] = F.expr(f"array_compact(array({', '.join(items)}))")
    return out.withColumns(lists | {"advice_label": F.expr(_label("advice", LABELS)), "position_hint": F.expr(POSITION_HINT), "advice_summary": F.expr(ADVICE_SUMMARY)}).drop("rule")


# PRD-6
#: What is to be said against a prediction, over edge and confidence.
PREDICTION_WARNING = "CASE WHEN {edge} IS NULL THEN '样本不足，不应把该概率当作可靠预测。' WHEN {edge} <= 0 THEN '该周期历史验证未显示模型优于简单基线，不应据此单独决策。' WHEN {confidence} = '低' THEN '该周期虽然有信号，但置信度不足，应结合风险评分和仓位控制。' END"
# fixed values: texts of the final decision
WHY = [
    (dec.NO_EDGE, "历史验证未显示稳定预测优势，当前方向难以判断。"), ("final_direction = 'up'", "7天和30天预测方向均偏涨，风险评分处于可接受区间。"), ("final_direction = 'down'", "短期或中期预测偏弱，且风险评分偏高，走势可能承压。"),
    ("final_direction = 'neutral'", "部分周期偏涨但信号不够一致，整体偏震荡。"), ("TRUE", "多周期信号不一致，方向不明确。"),
]
FINAL_TEXTS = {
    "why": [f"CASE {' '.join(f'WHEN {c} THEN {chr(39)}{t}{chr(39)}' for c, t in WHY)} END", f"CASE WHEN NOT {HELD} AND NOT coalesce(risk_score >= 70, FALSE) AND {dec.NO_EDGE} THEN '预测优势不足，建议等待更明确信号。' END"],
    "watch": [f"CASE WHEN {HELD} AND risk_score >= 60 AND risk_score < 70 THEN '关注风险评分变化，若持续上升可考虑降低仓位。' END", "CASE WHEN risk_score >= 60 AND risk_score < 75 THEN concat('风险评分 ', risk_score, ' 偏高，需持续关注。') END"],
    "warning": [
        f"CASE WHEN risk_score >= 70 AND {HELD} THEN '当前持仓且风险评分较高（≥70），不建议追加仓位。' WHEN risk_score >= 70 THEN '风险评分较高（≥70），暂不适合新开仓。' END",
        "CASE WHEN risk_score >= 75 THEN concat('综合风险评分 ', risk_score, '，处于高位，需警惕回撤风险。') END",
        "warning_7d", "warning_30d", "get(advice_warnings, 0)", "get(advice_warnings, 1)",
    ],
}
MOST = {"why": 5, "watch": 4, "warning": 4}
FINAL_DIRECTIONS = {"up": "偏涨", "down": "偏跌", "neutral": "震荡", "uncertain": "不确定"}
FINAL_ACTIONS = {"reduce": "降低仓位", "hold": "继续持有", "avoid": "暂不参与", "buy_watch": "可小额关注", "observe": "观察"}
HINTS = {"buy_watch": "可列入小额关注候选，仍需分批和控仓。", "hold": "以继续观察和控制仓位为主。", "reduce": "优先评估是否降低仓位，避免继续追加。", "avoid": "更适合先放入观察名单，暂不新开仓。", "observe": "先等待更清晰信号，不急于参与。"}
_RISK_TEXT = "coalesce(concat('风险分 ', CASE WHEN risk_score = floor(risk_score) THEN CAST(CAST(risk_score AS BIGINT) AS STRING) ELSE CAST(risk_score AS STRING) END), '风险分未知')"
FINAL_SUMMARY = f"concat(CASE WHEN {HELD} THEN '已有持仓' ELSE '未持有' END, '，方向', direction_label, '，', {_RISK_TEXT}, '，置信度', final_confidence, '。', {_label('final_action', HINTS)})"


def final_texts(df: DataFrame) -> DataFrame:
    """DEC-2: rows with FINAL_STAGES applied, and why, watch, warning, direction_label, action_label and final_summary.

    advice_warnings (see advice_texts), warning_7d and warning_30d (see PREDICTION_WARNING) are inputs; a text is told once.
    """
    lists = {name: F.slice(F.array_distinct(F.expr(f"array_compact(array({', '.join(items)}))")), 1, MOST[name]) for name, items in FINAL_TEXTS.items()}
    out = df.withColumns(lists | {"direction_label": F.expr(_label("final_direction", FINAL_DIRECTIONS)), "action_label": F.expr(_label("final_action", FINAL_ACTIONS))})
    return out.withColumn("final_summary", F.expr(FINAL_SUMMARY))
