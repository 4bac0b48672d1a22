import pytest
from pyspark.sql import functions as F

from fundlattice.operators import decisions as dec
from fundlattice.operators import portfolio
from fundlattice.operators import prediction as pred

ADVICE = "risk_score double, text_7d string, text_30d string, quality string, calibrated boolean, cost_nav double, holding_amount double, holding_units double, planned_buy_amount double, nav double, max_loss_percent double"


@pytest.mark.parametrize(
    "row, action, confidence, pct, amount",
    [
        ((65.0, "震荡", "震荡", "low", False, None, None, None, 10000.0, None, None), "small_trial", "低", 15, 1500.0),
        ((80.0, "震荡", "震荡", "medium", True, None, None, 1000.0, None, None, None), "reduce", "高", None, None),
        ((40.0, "偏上行", "偏上行", "medium", True, None, None, None, 9000.0, None, None), "batch_buy", "中", 33, 2970.0),
        ((58.0, "偏下行", "震荡", "medium", True, None, None, None, 10000.0, None, None), "observe", "中", 0, 0.0),
        ((45.0, "震荡", "震荡", "low", False, None, None, None, None, None, None), "observe", "低", None, None),
    ],
)
def test_advice(spark, row, action, confidence, pct, amount):
    r = dec.apply_stages(spark.createDataFrame([row], ADVICE), dec.ADVICE_STAGES).first()
    assert (r["advice"], r["advice_confidence"], r["buy_pct"], r["buy_amount"]) == (action, confidence, pct, amount)


def test_near_max_loss(spark):
    r = dec.apply_stages(spark.createDataFrame([(50.0, "震荡", "震荡", "medium", True, 1.0, None, None, None, 0.86, 15.0)], ADVICE), dec.ADVICE_STAGES).first()
    assert r["near_max_loss"]


def gate(spark, **over):
    row = dict(
        code="f", status="ok", pred_quality="medium", dir_7d="up", dir_30d="up", conf_7d="高", conf_30d="高", edge_7d=True, edge_30d=True, edge_value_7d=5.0, edge_value_30d=5.0, hit_7d=60.0, hit_30d=60.0, passes_7d=True,
        passes_30d=True, selective_hit_7d=70.0, selective_n_7d=30, selective_edge_7d=6.0, selective_hit_30d=70.0, selective_n_30d=30, selective_edge_30d=6.0, risk_score=40.0, vol_30=20.0, dd_30=5.0, pos_30=50.0, rsi_14=50.0, quality="medium",
        specific=False, selective_valid=False, validation_ok=False, cv_ok=False, hit_bound=0.0, validation_hit=0.0, validation_n=0, avg_return=0.0, profit_factor=0.0,
    ) | over
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    return dec.apply_stages(df, dec.GATE_STAGES).first()


def test_gates(spark):
    r = gate(spark)
    assert (r["gate_action"], r["passed"], r["max_pct"], r["gate_score"]) == ("small_buy", len(dec.GATES), 10, 80.0)
    assert len(dec.GATES) == 22
    assert gate(spark, conf_7d="中")["max_pct"] == 5
    for name, value in (("risk_score", 56.0), ("vol_30", 31.0), ("rsi_14", 70.0), ("dir_7d", "uncertain"), ("pred_quality", "low"), ("edge_7d", False)):
        assert gate(spark, **{name: value})["gate_action"] == "wait", name
    for name, value in (("risk_score", 70.0), ("vol_30", 40.0), ("dd_30", 15.0), ("status", "unavailable")):
        assert gate(spark, **{name: value})["gate_action"] == "avoid", name
    swing = dict(specific=True, selective_valid=True, validation_ok=True, cv_ok=True, hit_bound=56.0, selective_hit_30d=82.0, selective_n_30d=12, validation_hit=85.0, validation_n=4, avg_return=2.0, profit_factor=1.5, dir_7d="uncertain")
    r = gate(spark, **swing)
    assert (r["gate_action"], r["max_pct"], r["gate_score"]) == ("small_buy", 3, 88.0)


def test_headlines_are_short(spark):
    import re

    assert all(len(x) <= 25 for x in re.findall("'([^']*[，][^']*)'", dec.FINAL_STAGES[2]["headline"]))


def test_rule_templates_in_number():
    assert [len(pred.rule_templates(h)) for h in (1, 3, 7, 30)] == [262, 262, 263, 263]
    assert len(pred.rule_templates(1, True)) == 448 and len(pred.rule_templates(7, True)) == 452
    assert pred.rule_templates(1)[0] == {}


def test_wilson(spark):
    r = spark.range(1).select(pred.wilson(F.lit(8.0), F.lit(10.0))).first()[0]
    assert r == pytest.approx(49.02, abs=0.01)


def test_portfolio_operations(spark):
    rows = spark.createDataFrame([("161725", 0, "first"), ("110022", 1, "x"), ("161725", 2, "second"), ("abc", 3, "y")], "code string, ord long, note string")
    kept = portfolio.dedup_last_wins(portfolio.valid_codes(rows)).orderBy("place").collect()
    assert [(r["code"], r["note"]) for r in kept] == [("161725", "second"), ("110022", "x")]
    old = spark.createDataFrame([("1", 1), ("2", 2)], "code string, v int")
    new = spark.createDataFrame([("2", 5), ("3", 6)], "code string, v int")
    assert sorted(map(tuple, portfolio.upsert(old, new).collect())) == [("1", 1), ("2", 5), ("3", 6)]
    assert [tuple(r) for r in portfolio.delete(old, new).collect()] == [("1", 1)]


@pytest.mark.parametrize("appetite, overseas, forex, points", [("risk-off", "bearish", "贬值压力较大", 68.0), ("偏避险", "海外下跌", "贬值", 68.0), ("Risk-On", "Bullish", "stable", 42.0), ("积极", "上涨", "stable", 42.0), ("neutral", "mixed", "stable", 50.0)])
def test_macro_words_and_their_synonyms(spark, appetite, overseas, forex, points):
    from fundlattice.operators import scoring

    df = spark.createDataFrame([(True, appetite, overseas, forex, "none", None, None, None)], "macro_ok boolean, risk_appetite string, overseas string, forex_pressure string, commodity_disturbance string, vol_30 double, vol_60 double, down_30 double")
    assert df.select(F.expr(scoring.risk_part("macro_risk"))).first()[0] == points
    assert df.select(F.expr(scoring.risk_part("volatility_risk"))).first()[0] == 40.0  # a missing volatility counts as none


def test_failed_gates_are_named(spark):
    assert gate(spark)["failed_gates"] == ""
    assert gate(spark, risk_score=60.0, rsi_14=75.0, status="unavailable")["failed_gates"] == "status,risk,rsi"


FORECAST = "code string, horizon int, raw double, up1 double, side2 double, down1 double, gate string, conflict boolean, confidence string"


def corrected(spark, row, accuracy=None, n=10, hit=None, quality=None):
    curve = spark.createDataFrame([("f", row[0], 4, n, accuracy), ("f", row[0], 3, n, accuracy)] if accuracy is not None else [], "code string, horizon int, bucket int, n int, accuracy double")
    hits = spark.createDataFrame([("f", row[0], hit)] if hit is not None else [], "code string, horizon int, rule_acc double")
    judged = spark.createDataFrame([("f", *quality)] if quality else [], "code string, quality string, calibrated boolean")
    return dec.calibrated_forecast(spark.createDataFrame([("f", *row)], FORECAST), curve, hits, judged).first()


def test_backtest_corrects_forecast(spark):
    row = (7, 10.0, 40.0, 30.0, 30.0, "open", False, "高")
    r = corrected(spark, row, 62.4, hit=60.0, quality=("high", True))
    assert (r["up"], r["sideways"], r["down"], r["direction"], r["rise_fall"], r["confidence"], r["calibration_applied"]) == (62.0, 30.0, 8.0, "偏上行", "偏涨", "高", True)
    r = corrected(spark, (7, -10.0, 40.0, 30.0, 30.0, "open", False, "高"), 90.0, hit=60.0, quality=("high", True))
    assert (r["up"], r["sideways"], r["down"]) == (5.0, 10.0, 85.0)  # a side keeps 5, none has more than 85
    for accuracy, n in ((None, 10), (62.4, 4), (0.0, 10)):
        r = corrected(spark, row, accuracy, n)
        assert (r["up"], r["sideways"], r["down"], r["calibration_applied"]) == (40.0, 30.0, 30.0, False), (accuracy, n)


def test_backtest_lowers_confidence(spark):
    row = (3, 10.0, 40.0, 30.0, 30.0, "open", True, "高")
    assert corrected(spark, row)["confidence"] == "高"
    assert corrected(spark, row, hit=44.0, quality=("high", True))["confidence"] == "低"
    assert corrected(spark, row, hit=48.0, quality=("high", True))["confidence"] == "中"
    assert corrected(spark, row, hit=60.0)["confidence"] == "中"
    assert corrected(spark, row, hit=60.0, quality=("low", False))["confidence"] == "中"
    assert corrected(spark, row)["direction"] == "震荡" and corrected(spark, (7, *row[1:]))["direction"] == "不确定"
    r = corrected(spark, (7, 0.0, 33.0, 34.0, 33.0, "insufficient", False, "低"), 80.0)
    assert (r["up"], r["direction"], r["calibration_applied"]) == (33.0, "不确定", False)
