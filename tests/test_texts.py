import pytest
from pyspark.sql import functions as F

from fundlattice.operators import decisions as dec
from fundlattice.operators import texts
from fundlattice.operators.calendar import NEUTRAL

NONE = dict(
    high_vol=None, qdii=None, china=None, defensive=None, macro_ok=None, risk_appetite=None, liquidity=None, overseas=None, estimate_day=None, estimate_change=None, ma_5=None, ma_10=None, ma_20=None, i=100, nav=1.0, d=None, trend="横盘整理", regime="常态波动", horizon=1, risk_score=50.0, gate="open",
    up1=33.0, down1=33.0, confidence="中", quality="medium",
)
BOOLEANS = ("high_vol", "qdii", "china", "defensive", "macro_ok")
TEXTS = ("risk_appetite", "liquidity", "overseas", "trend", "regime", "gate", "confidence", "quality", "macd_cross", "macd_dir", "streak_dir")


def kind(name, value):
    return "boolean" if name in BOOLEANS else "string" if name in TEXTS else "date" if name in ("d", "estimate_day") else "int" if isinstance(value, int) else "double"


def rows(spark, *overs):
    base = {k: v for k, v in NEUTRAL.items()} | NONE
    schema = ", ".join(f"{k} {kind(k, v)}" for k, v in base.items())
    return spark.createDataFrame([tuple((base | over).values()) for over in overs], schema)


def test_said():
    assert texts.said("近{n}天") == "concat('近', n, '天')"
    assert texts.said("平") == "'平'"
    assert texts.said("{n}天") == "concat(n, '天')"


def test_neutral_row_says_little(spark):
    r = texts.score_texts(rows(spark, {"vol_30": 15.0})).first()
    assert (r["reasons"], r["up_triggers"], r["down_triggers"]) == (["均线横盘整理，缺乏明确方向"], [], [])


def test_triggers_are_told_once_and_at_most_four(spark):
    low = dict(trend="空头排列（下降趋势）", rsi_14=20.0, ret_1=-3.0, ret_5=-4.5, ret_7d=-5.0, pos_30=10.0, bb_pos=3.0, streak_dir="下跌", streak_days=4, vol_30=20.0)
    r = texts.score_texts(rows(spark, low)).first()
    assert r["up_triggers"] == ["RSI超卖后反弹机会", "出现放量反弹且站上20日均线，均线开始走平", "超卖反弹机会", "连续下跌后出现止跌阳线并收复5日均线"]
    assert r["down_triggers"] == ["继续创新低，下跌趋势未结束"]
    assert r["reasons"][:3] == ["均线空头但RSI超卖，可能反弹", "近1个交易日跌幅较大(-3.0%)但已超卖，关注反弹", "近5个交易日跌幅较大(-4.5%)但已超卖，关注反弹"]


def test_horizons_judge_their_own_returns(spark):
    moved = dict(ret_1=3.0, ret_5=3.0, ret_7d=-5.0, ret_30d=-8.0, ret_60d=-20.0, ret_90d=-5.0, vol_30=15.0)
    told = {r["horizon"]: r["reasons"] for r in texts.score_texts(rows(spark, *[moved | {"horizon": h} for h in (1, 3, 7, 30)])).collect()}
    assert any("近1个" in t for t in told[1]) and not any("近1个" in t for t in told[7])
    assert not any("近7天" in t for t in told[30]) and "近60天跌幅显著(-20.0%)，下行压力大" in told[30]
    assert "近30天跌幅较大(-8.0%)" in told[7] and not any("近30天" in t for t in told[3])


def test_forecast_texts_of_short_histories(spark):
    r = texts.forecast_texts(rows(spark, {"gate": "insufficient", "horizon": 7, "i": 9})).first()
    assert (r["reasons"], r["up_triggers"], r["down_triggers"]) == (["历史数据仅10个交易日，不足以进行7天情景判断"], [texts.AWAIT], [texts.AWAIT])
    r = texts.forecast_texts(rows(spark, {"gate": "low_confidence", "horizon": 30, "i": 40, "vol_30": 15.0})).first()
    assert r["reasons"] == ["均线横盘整理，缺乏明确方向", texts.SHORT_HISTORY]
    assert r["up_triggers"] == texts.DEFAULT_UP and r["down_triggers"] == texts.DEFAULT_DOWN


def test_conflicts_and_estimates_are_reasons(spark):
    import datetime as dt

    day = dict(d=dt.date(2024, 1, 2), estimate_day=dt.date(2024, 1, 3), estimate_change=1.5, vol_30=15.0)
    clash = dict(trend="空头排列（下降趋势）", ret_30d=4.0)
    got = {r["horizon"]: r for r in texts.forecast_texts(rows(spark, *[day | clash | {"horizon": h} for h in (1, 30)])).collect()}
    assert "注意信号冲突：短期反弹但中期趋势仍为空头" in got[1]["reasons"] and "当日估算涨跌1.5%（非正式净值）" in got[1]["reasons"]
    assert "当日估算继续转强并收复5日均线" in got[1]["up_triggers"]
    assert "多空信号冲突：短期反弹但中期趋势仍为空头" in got[30]["reasons"] and not any("估算" in x for x in got[30]["reasons"])


def test_support_takes_two_triggers_of_each_horizon(spark):
    f = rows(spark, {"horizon": 7}, {"horizon": 30}).withColumns({"code": F.lit("a"), "up_triggers": F.expr("CASE WHEN horizon = 7 THEN array('p', 'q', 'x') ELSE array('q', 'r', 'y') END"), "down_triggers": F.expr("CAST(array() AS array<string>)")})
    r = texts.decision_support(f, ["code"]).first()
    assert r["buy_watch"] == ["p", "q", "r"] and r["reduce_watch"] == [texts.NO_REDUCE]
    assert r["action_bias"] == "观望" and len(r["invalidation_signals"]) == 3


ADVICE = "risk_score double, text_7d string, text_30d string, quality string, calibrated boolean, cost_nav double, holding_amount double, holding_units double, planned_buy_amount double, nav double, max_loss_percent double"


def advise(spark, *row):
    return texts.advice_texts(dec.apply_stages(spark.createDataFrame([row], ADVICE), dec.ADVICE_STAGES))


@pytest.mark.parametrize(
    "row, label, reasons, hint",
    [
        ((80.0, "震荡", "震荡", "medium", True, None, None, None, None, None, None), "暂缓新增", 1, None),
        ((45.0, "震荡", "震荡", "low", False, 1.0, None, None, None, 0.86, 15.0), "观望", 2, "当前浮亏 14.0%，已接近最大亏损线 15.0%，需关注止损纪律。"),
        ((40.0, "偏上行", "偏上行", "medium", True, 1.0, None, None, None, 1.1, None), "分批关注", 2, "当前浮动盈亏约 +10.0%。"),
        ((65.0, "震荡", "震荡", "medium", True, 1.0, None, None, None, 1.1, None), "谨慎持有", 1, "当前浮盈 10.0%，但短期风险偏高，可考虑降低仓位风险。"),
    ],
)
def test_advice_texts(spark, row, label, reasons, hint):
    r = advise(spark, *row).first()
    assert (r["advice_label"], len(r["advice_reasons"]), r["position_hint"]) == (label, reasons, hint)
    assert r["advice_summary"].startswith("该基金")


def test_open_advice_tells_distrust_first(spark):
    r = advise(spark, 45.0, "震荡", "震荡", "low", False, None, None, None, None, None, None).first()
    assert r["advice_reasons"] == [texts.DISTRUST["advice_reasons"], texts.UNDECIDED]
    assert r["sell_conditions"] == [] and r["invalidation_signals"] == [texts.DISTRUST["invalidation_signals"]]


def test_final_texts_tell_at_most_four_warnings_once(spark):
    df = advise(spark, 80.0, "震荡", "震荡", "low", False, 1.0, None, None, None, 0.9, 50.0).withColumns({
        "dir_7d": F.lit("uncertain"), "dir_30d": F.lit("uncertain"), "conf_7d": F.lit("低"), "conf_30d": F.lit("低"), "edge_7d": F.lit(False), "edge_30d": F.lit(False), "pred_quality": F.lit("low"), "warning_7d": F.lit("w"), "warning_30d": F.lit("w"),
    })
    r = texts.final_texts(dec.apply_stages(df, dec.FINAL_STAGES)).first()
    assert r["warning"] == ["当前持仓且风险评分较高（≥70），不建议追加仓位。", "综合风险评分 80.0，处于高位，需警惕回撤风险。", "w", "风险评分处于高位，继续持有可能面临较大回撤。"]
    assert r["final_summary"] == "已有持仓，方向不确定，风险分 80，置信度低。优先评估是否降低仓位，避免继续追加。" and r["action_label"] == "降低仓位"


@pytest.mark.parametrize("horizon, high_vol, confidence", [(1, True, "中"), (7, True, "中"), (7, False, "高"), (30, False, "高")])
def test_confidence_is_capped_for_volatile_kinds(spark, horizon, high_vol, confidence):
    stages = dec.forecast_stages(horizon, "bround")
    capped = next(s for s in stages if "confidence" in s)["confidence"]
    df = spark.createDataFrame([(100, 80, high_vol, None, None, None)], "i int, conf_points int, high_vol boolean, estimate_day date, d date, estimate_change double")
    assert df.select(F.expr(capped)).first()[0] == confidence
