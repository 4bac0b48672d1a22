"""Risk, forecast, ensemble and decisions, as ordered tables over one row for each code and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlattice.operators import scoring
from fundlattice.operators.scoring import ladder, num

# fixed values: words that tell the kind of a fund
HIGH_VOLATILITY = ("QDII", "科技", "医药", "医疗", "新能源", "半导体", "芯片", "军工", "传媒")
EQUITY = ("股票", "指数", "混合", "ETF", "LOF", "增强", "联接")
DEFENSIVE = ("债券", "货币", "同业存单", "短债", "纯债")


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"fund_type LIKE '%{w}%'" for w in words) + ")"


#: FLT-9: flags from fund_type.
KINDS = {"high_vol": _any(HIGH_VOLATILITY), "qdii": "upper(fund_type) LIKE '%QDII%'", "defensive": _any(DEFENSIVE), "china": f"({_any(EQUITY)} AND NOT {_any(DEFENSIVE)} AND NOT upper(fund_type) LIKE '%QDII%')"}
PROFIT = "CASE WHEN cost_nav > 0 AND nav > 0 THEN (nav - cost_nav) / cost_nav * 100 END"
HAS_POSITION = "(coalesce(cost_nav, 0) > 0 OR coalesce(holding_amount, 0) > 0 OR coalesce(holding_units, 0) > 0)"
RISK_PARTS = ("trend_risk", "drawdown_risk", "volatility_risk", "position_risk", "macro_risk")


def with_kinds(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in KINDS.items()})


def with_risk(df: DataFrame) -> DataFrame:
    """RSK-1 to RSK-3: sub-scores, their mean (with the personal one where there is a position), level and colour."""
    out = df.withColumn("profit_pct", F.expr(PROFIT)).withColumn("max_loss", F.expr("coalesce(max_loss_percent, 20e0)"))
    out = out.withColumns({p: F.expr(scoring.risk_part(p)) for p in (*RISK_PARTS, "personal_risk")})
    return out.withColumn("risk_score", F.expr(RISK_SCORE)).withColumns({"risk_level": F.expr(scoring.RISK_LEVEL), "risk_colour": F.expr(scoring.RISK_COLOUR)})


RISK_SCORE = f"floor((CASE WHEN {HAS_POSITION} THEN ({' + '.join(RISK_PARTS)} + personal_risk) / 6 ELSE ({' + '.join(RISK_PARTS)}) / 5 END) * 10 + 0.5e0) / 10"

# SCR-11 to SCR-15, stage by stage; each stage only uses columns of the stages before it
# fixed values: numbers of the forecast by horizon, thresholds, labels, gates and headlines down to the end of DEC-3
BLEND = {1: (0.45, 30), 3: (0.60, 18), 7: (0.75, 8), 30: (0.90, 3)}
SCALE = {1: 85, 3: 95, 7: 105, 30: 125}
SIDEWAYS = {1: (36, 4), 3: (34, 2), 7: (30, 0), 30: (24, 0)}
CAPS = {1: (18, 58), 3: (16, 60), 7: (14, 64), 30: (10, 70)}
WIDTH = {1: 0.75, 3: 0.80, 7: 0.85, 30: 1.0}
FRESH = "(estimate_day IS NOT NULL AND estimate_day > d AND estimate_change <> 0)"


def forecast_stages(p: int, half_even: str) -> list[dict[str, str]]:
    """The columns of each stage for a horizon; half_even names the engine's half-to-even rounding."""
    keep, add = BLEND[p]
    base, more = SIDEWAYS[p]
    low, high = CAPS[p]
    used = FRESH if p in (1, 3) else "FALSE"
    whole = lambda x: f"{half_even}({x}, 0)"
    judged = f"({scoring.direction_score(p, context=True)} - {ladder([('risk_score > 70', 12), ('risk_score > 50', 5)])})"
    return [
        {"s0": judged},
        {"raw": f"(CASE WHEN {FRESH} THEN s0 * {num(keep)} + estimate_change * {num(add)} ELSE s0 END)"},
        {"squashed": f"100e0 * raw / (abs(raw) + {num(SCALE[p])})"},
        {"side0": f"({num(base)} + CASE WHEN {used} THEN {num(more)} ELSE 0e0 END)"},
        {"tilt": "greatest(-1e0, least(1e0, squashed / 100e0))", "calm": "(CASE WHEN abs(squashed) < 18 THEN 3e0 ELSE 0e0 END)"},
        {"edge": "(100e0 - side0) * 0.42e0 * abs(tilt)"},
        {"up0": f"greatest({num(low)}, least({num(high)}, (100e0 - side0) / 2 + CASE WHEN tilt > 0 THEN edge ELSE -edge END - calm))", "down0": f"greatest({num(low)}, least({num(high)}, (100e0 - side0) / 2 - CASE WHEN tilt > 0 THEN edge ELSE -edge END - calm))"},
        {"side1": "greatest(12e0, least(52e0, 100e0 - up0 - down0))"},
        {"up1": whole("up0 / (up0 + side1 + down0) * 100e0"), "side2": whole("side1 / (up0 + side1 + down0) * 100e0")},
        {"down1": "100e0 - up1 - side2"},
        {
            "direction": "CASE WHEN up1 >= down1 + 20 THEN '偏上行' WHEN down1 >= up1 + 20 THEN '偏下行' WHEN abs(up1 - down1) < 15 THEN '震荡' ELSE '不确定' END",
            "rise_fall": "CASE WHEN up1 >= down1 + 12 THEN '偏涨' WHEN down1 >= up1 + 12 THEN '偏跌' WHEN side2 >= 38 THEN '震荡' ELSE '不确定' END",
            "conflict": f"((ret_30d > 3 AND {scoring.BEARISH}) OR (pos_30 < 25 AND {scoring.BEARISH}) OR (pos_30 > 75 AND trend LIKE '%多头%' AND ret_30d > 10) OR (rebound_30 > 10 AND vol_30 > 30))",
        },
        {
            "conf_points": f"(100 - CASE WHEN i + 1 < 60 THEN 30 WHEN i + 1 < 90 THEN 15 ELSE 0 END - CASE WHEN macro_ok THEN 0 ELSE 10 END - CASE WHEN high_vol THEN 15 ELSE 0 END - CASE WHEN conflict THEN 20 ELSE 0 END - {10 if p == 30 else 0})",
            "daily_vol": "greatest(vol_30, ewma, 5e0) / sqrt(250e0)",
        },
        {"confidence": ("CASE WHEN i + 1 < 60 THEN '低' WHEN" if p == 30 else "CASE WHEN") + f" conf_points >= 70 THEN CASE WHEN {'high_vol OR ' + FRESH if p == 1 else 'high_vol'} THEN '中' ELSE '高' END WHEN conf_points >= 40 THEN '中' ELSE '低' END", "direction2": "CASE WHEN conflict THEN '不确定' ELSE direction END" if p >= 7 else "direction", "drift": f"greatest(-2.5e0, least(2.5e0, squashed / 100e0)) * daily_vol * sqrt({num(p)}) * 0.45e0"},
        {"width": f"daily_vol * sqrt({num(p)}) * {num(WIDTH[p])} * CASE WHEN high_vol THEN 1.15e0 ELSE 1e0 END * CASE WHEN defensive THEN 0.65e0 ELSE 1e0 END"},
        {"range_low": "drift - width", "range_high": "drift + width"},
    ]


FORECAST_COLUMNS = ("gate", "raw", "squashed", "up1", "side2", "down1", "direction2", "rise_fall", "conflict", "confidence", "range_low", "range_high")


def forecast(df: DataFrame, horizons=scoring.HORIZONS) -> DataFrame:
    """SCR-11 to SCR-15 for each horizon: probabilities, direction, confidence and range of returns.

    Scores of all horizons are one projection, whose array is exploded; what follows is one row's arithmetic, with the
    horizon's numbers by case. So the rows of df are made once.
    """
    stages = {p: forecast_stages(p, "bround") for p in horizons}
    scores = F.array(*[F.struct(F.lit(p).alias("horizon"), F.expr(stages[p][0]["s0"]).alias("s0")) for p in horizons])
    out = df.withColumn("of_horizon", F.explode(scores)).select("*", "of_horizon.*").drop("of_horizon")
    for number in range(1, len(stages[horizons[0]])):
        columns = {}
        for name in stages[horizons[0]][number]:
            forms: dict[str, list[int]] = {}
            for p in horizons:
                forms.setdefault(stages[p][number][name], []).append(p)
            last = list(forms)[-1]
            columns[name] = F.expr(last if len(forms) == 1 else "CASE " + " ".join(f"WHEN horizon IN ({', '.join(map(str, ps))}) THEN {form}" for form, ps in list(forms.items())[:-1]) + f" ELSE {last} END")
        out = out.withColumns(columns)
    return _gated(out)


def _gated(out: DataFrame) -> DataFrame:
    """SCR-10, SCR-17: a horizon for which a history is too short says nothing: thirds, an open direction, low confidence, no range."""
    out = out.withColumn("gate", _gate())
    short = F.col("gate") == "insufficient"
    unsaid = {"raw": 0.0, "squashed": 0.0, "up1": 33.0, "side2": 34.0, "down1": 33.0, "direction2": "不确定", "rise_fall": "不确定", "confidence": "低", "conflict": False, "range_low": None, "range_high": None}
    return out.withColumns({c: F.when(short, F.lit(v)).otherwise(F.col(c)) for c, v in unsaid.items()})


#: SCR-10: rows that a horizon's forecast needs, and below which that of 30 days is of low confidence.
LEAST_DAYS, LOW_CONFIDENCE_DAYS = {1: 8, 3: 12, 7: 15}, 60


def _gate():
    days = F.col("i") + 1
    gate = F.when((F.col("horizon") == 30) & (days < LOW_CONFIDENCE_DAYS), "low_confidence")
    for h, least in LEAST_DAYS.items():
        gate = gate.when((F.col("horizon") == h) & (days < least), "insufficient")
    return gate.otherwise("open")


def forecast_gates(p: DataFrame) -> DataFrame:
    """SCR-10: for each row and horizon, whether its history is enough: open, low_confidence (30 days) or insufficient."""
    return p.withColumn("horizon", F.explode(F.array(*map(F.lit, scoring.HORIZONS)))).withColumn("gate", _gate())


def calibration_lookup(df: DataFrame, curve: DataFrame) -> DataFrame:
    """JOIN-7: the observed accuracy of the score's bucket, where it rests on at least 5 samples; an equi-join on buckets."""
    from fundlattice.operators.backtest import BUCKETS, bucket

    return df.withColumn("bucket", bucket(F.col("raw"), BUCKETS)).join(curve.where("n >= 5").select("code", "horizon", "bucket", F.col("accuracy").alias("observed")), ["code", "horizon", "bucket"], "left")


def calibrated_stages(half_even: str) -> list[dict[str, str]]:
    """SCR-11: a forecast's columns corrected by what its code's backtest has seen: observed (accuracy of the score's bucket), hit, quality, calibrated."""
    sure = "(gate <> 'insufficient' AND observed > 0)"
    side = lambda own: f"CASE WHEN NOT coalesce({sure}, FALSE) THEN {own} WHEN raw {'>' if own == 'up1' else '<'} 0 THEN {half_even}(observed, 0) WHEN raw = 0 THEN {own} ELSE greatest(5e0, {half_even}(100e0 - observed - side2, 0)) END"
    return [
        {"seen_up": side("up1"), "seen_down": side("down1")},
        {"seen_up": f"CASE WHEN {sure} THEN greatest(5e0, least(85e0, seen_up)) ELSE seen_up END", "seen_down": f"CASE WHEN {sure} THEN greatest(5e0, least(85e0, seen_down)) ELSE seen_down END"},
        {"seen_side": f"CASE WHEN {sure} THEN greatest(8e0, 100e0 - seen_up - seen_down) ELSE side2 END"},
        {"all_sides": "seen_up + seen_side + seen_down"},
        {"up": f"CASE WHEN {sure} THEN {half_even}(seen_up / all_sides * 100e0, 0) ELSE seen_up END", "sideways": f"CASE WHEN {sure} THEN {half_even}(seen_side / all_sides * 100e0, 0) ELSE seen_side END"},
        {"down": "100e0 - up - sideways", "calibration_applied": f"coalesce({sure}, FALSE)"},
        {
            "direction": "CASE WHEN gate = 'insufficient' OR (conflict AND horizon >= 7) THEN '不确定' WHEN up >= down + 20 THEN '偏上行' WHEN down >= up + 20 THEN '偏下行' WHEN abs(up - down) < 15 THEN '震荡' ELSE '不确定' END",
            "rise_fall": "CASE WHEN gate = 'insufficient' THEN '不确定' WHEN up >= down + 12 THEN '偏涨' WHEN down >= up + 12 THEN '偏跌' WHEN sideways >= 38 THEN '震荡' ELSE '不确定' END",
            "confidence": "CASE WHEN hit < 45 THEN '低' WHEN confidence = '高' AND (hit < 50 OR (hit IS NOT NULL OR quality IS NOT NULL) AND NOT (coalesce(quality, 'low') <> 'low' AND coalesce(calibrated, FALSE))) THEN '中' ELSE confidence END",
        },
    ]


def calibrated_forecast(forecasts: DataFrame, curve: DataFrame, hits: DataFrame, quality: DataFrame) -> DataFrame:
    """SCR-11: forecasts (see forecast) as their codes' backtests correct them: up, sideways, down, direction, rise_fall, confidence, calibration_applied.

    curve: backtest.score_buckets; hits: backtest.baseline_edge; quality: backtest.quality. Each has a few rows for a code; all joins are by code,
    horizon or bucket. A code without a backtest, or a bucket of fewer than five samples, leaves a forecast as it is. After calibration
    the three sides are whole numbers that sum to 100.
    """
    out = calibration_lookup(forecasts.drop("quality", "calibrated"), curve).join(hits.select("code", "horizon", F.col("rule_acc").alias("hit")), ["code", "horizon"], "left")
    return apply_stages(out.join(quality.select("code", "quality", "calibrated"), "code", "left"), calibrated_stages("bround"))


# PRD-8
OVERSOLD = f"""greatest(10e0, least(90e0, 50e0
 + {ladder([("rsi < 25", 25), ("rsi < 30", 18), ("rsi < 35", 10), ("rsi > 75", -25), ("rsi > 70", -18), ("rsi > 65", -10)])}
 + {ladder([("bb_pos < 5", 15), ("bb_pos < 10", 10), ("bb_pos > 95", -15), ("bb_pos > 90", -10)])}))"""
ENSEMBLE_STAGES = [
    {"rsi": "CASE WHEN horizon <= 3 THEN rsi_6 ELSE rsi_14 END"},
    {"oversold": OVERSOLD},
    {"blend": "CASE WHEN llm_up IS NULL THEN rule_up ELSE 0.6e0 * llm_up + 0.2e0 * rule_up + 0.2e0 * oversold END"},
    {
        "ensemble_direction": "CASE WHEN blend >= 58 THEN 'up' WHEN blend <= 42 THEN 'down_or_flat' ELSE 'uncertain' END",
        "points": "CASE llm_confidence WHEN '高' THEN 3 WHEN '中' THEN 2 ELSE 1 END + CASE WHEN abs(blend - 50) > 15 THEN 2 WHEN abs(blend - 50) > 10 THEN 1 ELSE 0 END + CASE WHEN rsi_14 < 30 OR rsi_14 > 70 OR bb_pos < 10 OR bb_pos > 90 THEN 1 ELSE 0 END",
    },
    {"ensemble_confidence": "CASE WHEN points >= 5 THEN '高' WHEN points >= 3 THEN '中' ELSE '低' END"},
]

#: PRD-7: who answers for the short term: a trained code's own model, rules where no language model has answered, else the ensemble.
ROUTE_STAGES = [
    *ENSEMBLE_STAGES,
    {"route": "CASE WHEN i < 30 THEN 'unavailable' WHEN trained THEN 'trained' WHEN llm_up IS NULL THEN 'rules' ELSE 'ensemble' END", "signal": "CASE WHEN rsi < 30 OR bb_pos < 15 THEN 1 WHEN rsi > 70 OR bb_pos > 85 THEN -1 ELSE 0 END"},
    {
        "route_up": "CASE route WHEN 'trained' THEN rule_up WHEN 'rules' THEN 50e0 + signal * 10 WHEN 'ensemble' THEN blend END",
        "route_direction": "CASE route WHEN 'rules' THEN CASE signal WHEN 1 THEN 'up' WHEN -1 THEN 'down_or_flat' ELSE 'uncertain' END WHEN 'ensemble' THEN ensemble_direction WHEN 'trained' THEN CASE WHEN rule_up >= 58 THEN 'up' WHEN rule_up <= 45 THEN 'down_or_flat' ELSE 'uncertain' END END",
        "route_confidence": "CASE route WHEN 'rules' THEN CASE WHEN signal = 0 THEN '低' ELSE '中' END WHEN 'ensemble' THEN ensemble_confidence ELSE '低' END",
    },
]

# DEC-1: the first rule that holds
UP_WORDS, DOWN_WORDS = ("上行", "偏涨", "上涨", "偏强"), ("下行", "偏跌", "下跌", "偏弱")


def says(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{column} LIKE '%{w}%'" for w in words) + ")"


TRUSTED = "(quality <> 'low' AND calibrated)"
ADVICE_STAGES = [
    {
        "advice": f"""CASE WHEN risk_score >= 75 AND {HAS_POSITION} THEN 'reduce' WHEN risk_score >= 75 THEN 'avoid'
 WHEN ({says('text_7d', DOWN_WORDS)} OR {says('text_30d', DOWN_WORDS)}) AND risk_score > 55 THEN CASE WHEN {HAS_POSITION} THEN 'hold' ELSE 'observe' END
 WHEN risk_score >= 60 THEN CASE WHEN {HAS_POSITION} THEN 'hold' ELSE 'small_trial' END
 WHEN {says('text_7d', UP_WORDS)} AND {says('text_30d', UP_WORDS)} AND risk_score < 55 AND {TRUSTED} THEN 'batch_buy' ELSE 'observe' END""",
        "advice_confidence": f"CASE WHEN NOT {TRUSTED} THEN '低' WHEN risk_score >= 75 THEN '高' ELSE '中' END",
    },
    {"buy_pct": "CASE WHEN planned_buy_amount > 0 THEN CASE advice WHEN 'small_trial' THEN 15 WHEN 'batch_buy' THEN 33 ELSE 0 END END"},
    {
        "buy_amount": "planned_buy_amount * buy_pct / 100e0",
        "near_max_loss": "coalesce(cost_nav > 0 AND nav < cost_nav AND (cost_nav - nav) / cost_nav * 100 >= max_loss_percent * 0.8e0, FALSE)",
    },
]
# DEC-2
NO_EDGE = "((NOT edge_7d AND NOT edge_30d) OR (conf_7d = '低' AND conf_30d = '低') OR pred_quality = 'low')"
FINAL_STAGES = [
    {
        "final_direction": f"""CASE WHEN {NO_EDGE} THEN 'uncertain'
 WHEN dir_7d = 'up' AND dir_30d = 'up' AND (conf_7d IN ('中', '高') OR conf_30d IN ('中', '高')) AND risk_score < 60 THEN 'up'
 WHEN (dir_7d <> 'up' OR dir_30d <> 'up') AND risk_score >= 60 THEN 'down' WHEN dir_7d = 'up' OR dir_30d = 'up' THEN 'neutral' ELSE 'uncertain' END"""
    },
    {
        "final_action": f"""CASE WHEN {HAS_POSITION} AND risk_score >= 70 THEN 'reduce' WHEN {HAS_POSITION} AND risk_score >= 60 THEN 'hold' WHEN NOT {HAS_POSITION} AND risk_score >= 70 THEN 'avoid'
 WHEN NOT {HAS_POSITION} AND {NO_EDGE} THEN 'observe' WHEN final_direction = 'up' AND (risk_score IS NULL OR risk_score < 55) THEN 'buy_watch'
 WHEN final_direction = 'down' AND {HAS_POSITION} THEN 'reduce' ELSE 'observe' END""",
        "final_confidence": "CASE final_direction WHEN 'up' THEN CASE WHEN conf_7d = '高' OR conf_30d = '高' THEN '高' ELSE '中' END WHEN 'down' THEN '中' ELSE '低' END",
    },
    {
        "headline": """CASE WHEN final_direction = 'up' AND final_action = 'buy_watch' THEN '短期偏涨，可小额关注' WHEN final_direction = 'up' THEN '走势偏强，可关注但需控仓'
 WHEN final_direction = 'down' AND final_action = 'reduce' THEN '当前偏弱，可考虑降低仓位' WHEN final_direction = 'down' THEN '走势偏弱，建议暂观察' WHEN final_direction = 'neutral' THEN '当前偏震荡，等待方向明朗'
 WHEN final_action = 'avoid' THEN '风险较高，暂不适合参与' WHEN final_action = 'reduce' THEN '风险偏高，可考虑降低仓位' WHEN risk_score >= 70 THEN '风险评分较高，建议谨慎' ELSE '当前偏观察，不适合追买' END"""
    },
]
# DEC-3: hard gates, all of which must hold to buy
GATES = [
    "status = 'ok'", "pred_quality <> 'low'", "dir_7d = 'up'", "dir_30d = 'up'", "conf_7d IN ('高', '中')", "conf_30d IN ('高', '中')", "edge_7d", "edge_30d",
    "edge_value_7d >= 3", "edge_value_30d >= 3", "hit_7d >= 55", "hit_30d >= 55", "passes_7d", "passes_30d",
    "selective_hit_7d >= 60 AND selective_n_7d >= 20 AND selective_edge_7d >= 3", "selective_hit_30d >= 60 AND selective_n_30d >= 20 AND selective_edge_30d >= 3",
    "risk_score < 55", "vol_30 <= 30", "dd_30 <= 8", "pos_30 < 80", "rsi_14 < 70", "quality <> 'low'",
]
SWING = [
    "specific", "status = 'ok'", "passes_30d", "selective_valid", "validation_ok", "cv_ok", "hit_bound >= 55", "selective_hit_30d >= 80 AND selective_n_30d >= 10", "validation_hit >= 80 AND validation_n >= 3",
    "avg_return > 0 AND profit_factor >= 1.3e0", "risk_score < 60", "vol_30 <= 35", "dd_30 <= 12", "pos_30 < 85", "rsi_14 < 75",
]
GATE_NAMES = (
    "status", "prediction_quality", "direction_7d", "direction_30d", "confidence_7d", "confidence_30d", "has_edge_7d", "has_edge_30d", "edge_7d", "edge_30d", "hit_7d", "hit_30d", "passes_7d", "passes_30d",
    "selective_7d", "selective_30d", "risk", "volatility", "drawdown", "position", "rsi", "backtest_quality",
)
AVOID = "status = 'unavailable' OR risk_score >= 70 OR vol_30 >= 40 OR dd_30 >= 15 OR (dir_7d = 'down_or_flat' AND dir_30d = 'down_or_flat') OR (NOT edge_7d AND NOT edge_30d AND risk_score >= 60)"
GATE_STAGES = [
    {"failed_gates": "concat_ws(',', " + ", ".join(f"CASE WHEN {g} THEN NULL ELSE '{name}' END" for g, name in zip(GATES, GATE_NAMES, strict=True)) + ")"},
    {"passed": " + ".join(f"CASE WHEN {g} THEN 1 ELSE 0 END" for g in GATES), "swing": " AND ".join(f"coalesce({g}, FALSE)" for g in SWING)},
    {"gate_action": f"CASE WHEN {AVOID} THEN 'avoid' WHEN swing OR passed = {len(GATES)} THEN 'small_buy' ELSE 'wait' END"},
    {
        "gate_score": f"CASE WHEN gate_action = 'avoid' THEN 0e0 WHEN swing THEN 88e0 ELSE greatest(0e0, least(100e0, passed / {num(len(GATES))} * 80 - greatest(0e0, risk_score - 40) * 0.2e0)) END",
        "max_pct": f"CASE WHEN gate_action <> 'small_buy' THEN 0 WHEN swing THEN 3 WHEN conf_7d = '高' AND conf_30d = '高' THEN 10 ELSE 5 END",
    },
]


def apply_stages(df: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({k: F.expr(v) for k, v in stage.items()})
    return df


def stages_sql(source: str, stages: list[dict[str, str]]) -> str:
    """The same stages as nested selects."""
    for stage in stages:
        source = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in stage.items())} FROM {source})"
    return source


def narrative(df: DataFrame) -> DataFrame:
    """DEC-4, SNK-8: a short text for each row, from rules alone."""
    text = F.format_string("%s：风险分 %.1f（%s），趋势%s，近30日收益 %.2f%%，最大回撤 %.2f%%，波动率 %.2f%%。%s。仅供个人研究参考，不构成投资建议。", "code", "risk_score", "risk_level", "trend", "ret_30d", "dd_30", "vol_30", "headline")
    return df.select("code", "d", text.alias("narrative"))
