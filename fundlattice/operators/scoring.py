"""Rule scores as tables of ladders: in a ladder the first condition that holds gives its points.

Conditions are SQL expressions over a row of indicators (see walkforward.features for the names). A score is one
projection: the sum of its ladders, with the damping factors between them.
"""

from __future__ import annotations

from collections.abc import Iterable

Ladder = list[tuple[str, float]]


def num(x: float) -> str:
    """A literal that is a double everywhere."""
    return f"{float(x)!r}e0"


def ladder(rules: Ladder, otherwise: float = 0) -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN {num(v)}" for c, v in rules) + f" ELSE {num(otherwise)} END)"


def total(ladders: Iterable[Ladder]) -> str:
    return "(" + " + ".join(map(ladder, ladders)) + ")"


def either(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


# fixed values: words, bounds, points and weights of the scores, in this and the following functions
UPWARD = either("trend LIKE '%多头排列%'", "trend LIKE '%上升%'")
DOWNWARD = either("trend LIKE '%空头排列%'", "trend LIKE '%下降%'")
BEARISH = either("trend LIKE '%空头%'", "trend LIKE '%下降%'")
#: For each horizon: weight of the trend, and returns that are judged, as (column, whether over few days).
TREND_WEIGHT = {1: 0.4, 3: 0.55, 7: 0.75, 30: 0.75}
RETURNS = {1: [("ret_1", True), ("ret_5", True), ("ret_7d", False)], 3: [("ret_1", True), ("ret_5", True), ("ret_7d", False)], 7: [("ret_5", True), ("ret_7d", False), ("ret_30d", False)], 30: [("ret_30d", False), ("ret_60d", False), ("ret_90d", False)]}
HORIZONS = (1, 3, 7, 30)


def _trend(p: int) -> Ladder:
    w = TREND_WEIGHT[p]
    return [
        (f"{UPWARD} AND rsi_14 > 70", 9 * w), (f"{UPWARD} AND rsi_14 > 60", 18 * w), (UPWARD, 30 * w),
        (f"{DOWNWARD} AND rsi_14 < 30", -14 * w), (f"{DOWNWARD} AND rsi_14 < 40", -24.5 * w), (DOWNWARD, -35 * w),
        ("trend LIKE '%偏多%'", 15 * w), ("trend LIKE '%偏空%'", -20 * w),
    ]


def _return(c: str, few_days: bool) -> Ladder:
    if few_days:
        return [
            (f"{c} > 2.5 AND (rsi_14 > 65 OR pos_30 > 80)", 4), (f"{c} > 2.5", 12), (f"{c} > 1", 7), (f"{c} > 0", 3), (f"{c} > -1", -3), (f"{c} > -2.5", -8),
            ("rsi_14 < 35 OR pos_30 < 20", -6), ("TRUE", -14),
        ]
    return [
        (f"{c} > 10 AND (pos_60 > 85 OR rsi_14 > 70)", 4), (f"{c} > 10", 12), (f"{c} > 5", 8), (f"{c} > 0", 3), (f"{c} > -3", -3), (f"{c} > -7", -10),
        (f"{c} > -15 AND (pos_60 < 25 OR rsi_14 < 35)", -8), (f"{c} > -15", -18), ("TRUE", -25),
    ]


def _short_term(p: int) -> list[Ladder]:
    """The ladders that only short horizons have; the numbers for one day and for three."""
    if p == 7:
        return [
            [("ret_1 > 0 AND ret_5 > 0 AND accel > 0", 7), ("ret_1 < 0 AND ret_5 < 0 AND accel < 0", -8)],
            [("ewma > 0 AND vol_30 > 0 AND ewma > vol_30 * 1.15e0", -5), ("ewma > 0 AND vol_30 > 0 AND ewma < vol_30 * 0.85e0", 3)],
        ]
    if p == 30:
        return []
    up, down, run_up, run_down, accel, high, low, fall, rise = (10, -12, 6, -7, 7, -5, 4, -5, 4) if p == 1 else (7, -8, 4, -5, 5, -4, 3, -3, 3)
    out = [
        [("nav > ma_5 AND ma_5 > ma_10", up), ("nav < ma_5 AND ma_5 < ma_10", down)],
        [("streak_days >= 3 AND streak_dir = '上涨'", run_up), ("streak_days >= 3 AND streak_dir = '下跌'", run_down)],
        [("accel > 1", accel), ("accel < -1", -accel)],
        [("pos_7 > 85 AND ret_1 > 0", high), ("pos_7 < 15 AND ret_1 < 0 AND NOT trend LIKE '%空头%'", low)],
        [("pullback_7 > 3", fall)],
        [("rebound_7 > 3", rise)],
    ]
    return out + ([[("ret_5 > 0 AND ret_1 > 0", 3)]] if p == 3 else [])


def direction_score(p: int, context: bool = False) -> str:
    """SCR-1 for a horizon of p days; context: columns on the fund's kind and the market take part."""
    long_run = p not in (3, 7)
    first = [_trend(p), *(_return(*r) for r in RETURNS[p])]
    first += [[(f"{c} > 15", -15), (f"{c} > 8", -8), (f"{c} > 5", -4)] for c in ("dd_30", "dd_60", "dd_90")[: 3 if long_run else 2]]
    sharpe, best = ("sharpe_60", 10) if long_run else ("sharpe_30", 8)
    first += [
        ([("high_vol AND vol_30 > 35", -8)] if context else []) + [("vol_30 > 35", -10), ("vol_30 > 25", -5), ("vol_30 < 10", 5)],
        [(f"{sharpe} > 1", best), (f"{sharpe} < -1", -12), (f"{sharpe} < 0", -6)],
        [("pos_30 > 80 AND vol_30 > 25", -10), ("pos_30 > 80", -3), (f"pos_30 < 20 AND {BEARISH}", -8), ("pos_30 < 20", 5)],
        [("pos_60 > 85", -5)], [("pos_90 < 15", 3)], [("rebound_30 > 8", 5)], [("pullback_30 > 8", -8)],
        [("win_30 > 60", 5), ("win_30 < 40", -5)],
    ]
    if p == 30:
        first.append([("calmar_90 > 1", 5), ("calmar_90 < -1", -8)])
    first += [[("calmar_60 > 1", 3), ("calmar_60 < -1", -5)], [("nav > ma_20", 3), ("ma_20 IS NOT NULL", -3)], *_short_term(p)]
    if context:
        first += [
            [("macro_ok AND risk_appetite = 'risk-on'", 5), ("macro_ok AND risk_appetite = 'risk-off'", -8)],
            [("macro_ok AND liquidity = 'tight'", -5), ("macro_ok AND liquidity = 'loose' AND risk_appetite <> 'risk-off'", 3)],
            [("qdii AND macro_ok AND overseas = 'bearish'", -10), ("qdii AND macro_ok AND overseas = 'bullish'", 8)],
            [("china AND macro_ok AND risk_appetite = 'risk-on'", 4), ("china AND macro_ok AND risk_appetite = 'risk-off'", -6)],
        ]
    cross = 12 if p <= 7 else 6
    second = [
        [("regime = '高波动'", -3)] + ([("regime = '低波动'", 2)] if p <= 7 else []),
        [("rsi_14 > 75", -10), ("rsi_14 > 65", -4), ("rsi_14 < 25", 10), ("rsi_14 < 35", 4)],
        [("rsi_6 > 0 AND rsi_6 > rsi_14 + 5", 4), ("rsi_6 > 0 AND rsi_6 < rsi_14 - 5", -4)],
        [("macd_cross = 'golden'", cross), ("macd_cross = 'dead'", -cross)],
        [("macd_dir = 'rising' AND macd_hist < 0", 3), ("macd_dir = 'falling' AND macd_hist > 0", -3), ("macd_dir = 'falling' AND macd_hist < 0", -5), ("macd_dir = 'rising' AND macd_hist > 0", 5)],
        [("bb_pos >= 95", -6), ("bb_pos >= 80", -2), ("bb_pos <= 5", 6), ("bb_pos <= 20", 2)],
        ([("bb_width > 20", -3)] if p >= 7 else []) + ([("bb_width < 5", 2)] if p >= 3 else []),
        [("skew < -0.8e0", -5), ("skew > 0.8e0", 3)] if p >= 7 else [],
    ]
    damped = f"{total(first)} * (CASE WHEN defensive THEN 0.75e0 ELSE 1e0 END)" if context else total(first)
    return f"({damped} + {total(x for x in second if x)})"


def binary_score(p: int, score: str = "score") -> str:
    """SCR-2: the direction score adjusted for an up-or-not forecast."""
    cross = 5 if p <= 7 else 3
    parts: list[Ladder] = []
    if p <= 3:
        parts.append([("ret_1 > 0 AND ret_5 > 0 AND (pos_30 > 75 OR rsi_14 > 65)", 1), ("ret_1 > 0 AND ret_5 > 0", 4), ("ret_1 < 0 AND ret_5 < 0 AND (pos_30 < 25 OR rsi_14 < 35)", -1), ("ret_1 < 0 AND ret_5 < 0", -4)])
    parts += [
        [("rsi_14 >= 75", -12), ("rsi_14 >= 65", -6), ("rsi_14 <= 25", 10), ("rsi_14 <= 35", 5)],
        [("bb_pos >= 95", -8), ("bb_pos >= 85", -4), ("bb_pos <= 5", 8), ("bb_pos <= 15", 4)],
        [("pos_30 >= 85 AND ret_30d > 10", -8), ("pos_30 >= 80 AND vol_30 >= 25", -5), ("pos_30 <= 15 AND ret_30d < -10", 6), ("pos_30 <= 20 AND vol_30 < 35", 3)],
        [("macd_cross = 'golden'", cross), ("macd_cross = 'dead'", -cross)],
    ]
    return f"(({score} + {total(parts)}) * {ladder([('vol_30 >= 40', 0.75), ('vol_30 >= 30', 0.9)], 1)})"


def binary_score_by_horizon(score: str = "score") -> str:
    """SCR-2 for the row's horizon: the same ladders once, with conditions on the horizon where it matters."""
    both_up, both_down = "horizon <= 3 AND ret_1 > 0 AND ret_5 > 0", "horizon <= 3 AND ret_1 < 0 AND ret_5 < 0"
    parts: list[Ladder] = [
        [(f"{both_up} AND (pos_30 > 75 OR rsi_14 > 65)", 1), (both_up, 4), (f"{both_down} AND (pos_30 < 25 OR rsi_14 < 35)", -1), (both_down, -4)],
        [("rsi_14 >= 75", -12), ("rsi_14 >= 65", -6), ("rsi_14 <= 25", 10), ("rsi_14 <= 35", 5)],
        [("bb_pos >= 95", -8), ("bb_pos >= 85", -4), ("bb_pos <= 5", 8), ("bb_pos <= 15", 4)],
        [("pos_30 >= 85 AND ret_30d > 10", -8), ("pos_30 >= 80 AND vol_30 >= 25", -5), ("pos_30 <= 15 AND ret_30d < -10", 6), ("pos_30 <= 20 AND vol_30 < 35", 3)],
        [("macd_cross = 'golden' AND horizon <= 7", 5), ("macd_cross = 'golden'", 3), ("macd_cross = 'dead' AND horizon <= 7", -5), ("macd_cross = 'dead'", -3)],
    ]
    return f"(({score} + {total(parts)}) * {ladder([('vol_30 >= 40', 0.75), ('vol_30 >= 30', 0.9)], 1)})"


def reversion_probability() -> str:
    """SCR-5."""
    parts: list[Ladder] = [
        [("rsi_14 <= 25", 0.2), ("rsi_14 <= 30", 0.15), ("rsi_14 <= 35", 0.1), ("rsi_14 >= 75", -0.2), ("rsi_14 >= 70", -0.15), ("rsi_14 >= 65", -0.1)],
        [("bb_pos <= 5", 0.12), ("bb_pos <= 10", 0.08), ("bb_pos >= 95", -0.12), ("bb_pos >= 90", -0.08)],
        [("pos_30 <= 15 AND ret_30d < -10", 0.1), ("pos_30 <= 20", 0.05), ("pos_30 >= 85 AND ret_30d > 10", -0.1), ("pos_30 >= 80", -0.05)],
    ]
    return f"least(0.8e0, greatest(0.2e0, 0.5e0 + {total(parts)}))"


def sigmoid(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-greatest(-20e0, least(20e0, {x})))))"


def up_probability(p: int | str, adjusted: str = "adjusted", days: str = "90") -> str:
    """SCR-3, SCR-4: rule, momentum and reversion blended, shrunk for short histories and clamped. p: a horizon, or the column that holds it."""
    momentum = sigmoid(f"prev_return / greatest(vol_pop_30 * sqrt({p if isinstance(p, str) else num(p)}) * 100e0, 0.35e0) * 0.9e0")
    blend = f"0.45e0 * {sigmoid(f'{adjusted} / 32e0')} + 0.25e0 * {momentum} + 0.3e0 * {reversion_probability()}"
    strength = f"least(1e0, greatest(0.25e0, ({days} - 30) / 90e0))"
    return f"least(0.9e0, greatest(0.1e0, 0.5e0 + ({blend} - 0.5e0) * {strength}))"


AVERSE = "(lower(risk_appetite) LIKE '%risk-off%' OR risk_appetite LIKE '%避险%')"
WEAK_ABROAD = "(lower(overseas) LIKE '%bearish%' OR overseas LIKE '%下跌%')"
UNDER_PRESSURE = "(forex_pressure LIKE '%压力%' OR forex_pressure LIKE '%贬值%')"
# fixed values: bounds and points of the risk scores, and the texts of what they rest on
#: RSK-2: sub-scores begin at 50 and stay within 0 to 100.
RISK = {
    "trend_risk": [
        [("ret_30d > 10", -10), ("ret_30d < -10", 15), ("ret_30d < -5", 8), ("ret_30d < 0", 3)],
        [("ret_60d < -15", 12), ("ret_60d < -5", 5)],
        [("ret_90d < -20", 10)],
        [(either("trend LIKE '%空头排列%'", "trend LIKE '%下降%'"), 15), (UPWARD, -10), ("trend LIKE '%偏空%'", 8)],
        [("nav < ma_20", 5)],
    ],
    "drawdown_risk": [[("dd_30 > 10", 20), ("dd_30 > 5", 10), ("dd_30 > 3", 5)], [("dd_60 > 15", 15), ("dd_60 > 8", 8)], [("dd_90 > 20", 12)]],
    "volatility_risk": [[("vol_30 > 40", 20), ("vol_30 > 25", 12), ("vol_30 > 15", 5), ("coalesce(vol_30, 0e0) < 10", -10)], [("vol_60 > 35", 10)], [("down_30 > 25", 8)]],
    "position_risk": [
        [("pos_30 > 80 AND vol_30 > 25", 18), ("pos_30 > 80", 10), ("pos_30 > 60", 3)],
        [(f"pos_30 < 20 AND {BEARISH}", 12), ("pos_30 < 20", -5)],
        [("pos_60 > 85", 5)],
        [("pos_90 < 15", 5)],
    ],
    "macro_risk": [
        [(f"macro_ok AND {AVERSE}", 8), ("macro_ok AND (lower(risk_appetite) LIKE '%risk-on%' OR risk_appetite LIKE '%积极%')", -5)],
        [(f"macro_ok AND {WEAK_ABROAD}", 5), ("macro_ok AND (lower(overseas) LIKE '%bullish%' OR overseas LIKE '%上涨%')", -3)],
        [(f"macro_ok AND {UNDER_PRESSURE}", 5)],
        [("macro_ok AND commodity_disturbance LIKE '%扰动%'", 3)],
    ],
    "personal_risk": [
        [("profit_pct < 0 AND -profit_pct / max_loss >= 0.9e0", 25), ("profit_pct < 0 AND -profit_pct / max_loss >= 0.5e0", 15), ("profit_pct < -5", 8), ("profit_pct < 0", 3), ("profit_pct > 10", -10), ("profit_pct IS NOT NULL", -5)],
        [("profit_pct IS NOT NULL AND preference = '保守'", 10), ("profit_pct IS NOT NULL AND preference = '激进'", -8)],
        [("profit_pct IS NOT NULL AND holding_amount > 500000", 5)],
    ],
}


_FALLING = either("trend LIKE '%空头排列%'", "trend LIKE '%下降%'")
_VALID = "(cost_nav > 0 AND nav > 0)"
_LOSS = "printf('%.1f', abs(profit_pct))"
#: RSK-2: reasons in their order, as (condition, text); texts are SQL.
REASONS = [
    ("ret_30d > 10", "concat('近30天涨幅较大(', ret_30d, '%)，短期回调风险提高')"), ("ret_30d < -10", "concat('近30天跌幅较大(', ret_30d, '%)，下行趋势风险较高')"), ("ret_30d >= -10 AND ret_30d < -5", "concat('近30天下跌(', ret_30d, '%)')"),
    ("ret_60d < -15", "concat('近60天跌幅较大(', ret_60d, '%)，中期趋势偏弱')"), ("ret_90d < -20", "concat('近90天跌幅较大(', ret_90d, '%)，长期趋势偏弱')"), (_FALLING, "'均线空头排列，下降趋势'"), ("nav < ma_20", "'净值低于20日均线'"),
    ("dd_30 > 10", "concat('近30天最大回撤', dd_30, '%，短期回撤显著')"), ("dd_30 > 5 AND dd_30 <= 10", "concat('近30天最大回撤', dd_30, '%')"), ("dd_60 > 15", "concat('近60天最大回撤', dd_60, '%，中期回撤较大')"), ("dd_90 > 20", "concat('近90天最大回撤', dd_90, '%，长期回撤较大')"),
    ("vol_30 > 40", "concat('近30天年化波动率极高(', vol_30, '%)')"), ("vol_30 > 25 AND vol_30 <= 40", "concat('近30天波动率较高(', vol_30, '%)')"), ("vol_30 < 10", "concat('近30天波动率较低(', vol_30, '%)，波动风险小')"),
    ("vol_60 > 35", "concat('近60天波动率较高(', vol_60, '%)')"), ("down_30 > 25", "'下行波动率较高，下跌时的波动幅度大'"),
    ("pos_30 > 80", "'净值处于近30日高位区间'"), (f"pos_30 < 20 AND {BEARISH}", "'净值处于近30日低位但趋势仍为空头'"), (f"pos_30 < 20 AND NOT {BEARISH}", "'净值处于近30日低位区间，可能存在分批关注机会'"), ("pos_90 < 15", "'净值接近90日低位'"),
    ("NOT coalesce(macro_ok, FALSE)", "'宏观数据暂不可用，宏观评分保持中性'"), (f"macro_ok AND {AVERSE}", "'当前宏观风险偏好偏避险'"), (f"macro_ok AND {WEAK_ABROAD}", "'海外市场偏弱，可能传导至国内'"), (f"macro_ok AND {UNDER_PRESSURE}", "'汇率存在贬值压力，可能影响QDII基金和外资流向'"),
    (f"has_position AND NOT coalesce({_VALID}, FALSE)", "'持仓成本或净值数据无效，个人持仓评分保持中性'"),
    ("profit_pct < 0 AND -profit_pct / max_loss >= 0.9e0", f"concat('当前浮亏', {_LOSS}, '%，已接近最大可承受亏损', max_loss, '%')"),
    ("profit_pct < 0 AND -profit_pct / max_loss >= 0.5e0 AND -profit_pct / max_loss < 0.9e0", f"concat('当前浮亏', {_LOSS}, '%，达到最大可承受亏损的', printf('%.0f', -profit_pct / max_loss * 100), '%')"),
    ("profit_pct < -5 AND -profit_pct / max_loss < 0.5e0", f"concat('当前浮亏', {_LOSS}, '%')"), ("profit_pct > 10", "concat('当前浮盈', printf('%.1f', profit_pct), '%，已有较好收益')"),
    ("profit_pct IS NOT NULL AND preference = '保守'", "'用户风险偏好为保守，风险敏感度提高'"), ("profit_pct IS NOT NULL AND holding_amount > 500000", "'持仓金额较大，需更关注风险'"),
]
WARNINGS = [
    (_FALLING, "'当前处于下降趋势中，左侧介入风险较高'"), ("dd_30 > 10", "'近期回撤较大，关注止损纪律'"), ("dd_90 > 20", "'长期回撤幅度较大，需关注是否进入下跌通道'"), ("vol_30 > 40", "'波动率极高，净值波动剧烈，不适合风险承受能力低的投资者'"),
    ("pos_30 > 80 AND vol_30 > 25", "'净值接近短期高位且波动率高，追高风险较大'"), (f"pos_30 < 20 AND {BEARISH}", "'虽然处于低位但下跌趋势未结束，左侧介入风险较高'"), ("pos_60 > 85", "'净值接近60日高位，中期追高风险'"),
    ("profit_pct < 0 AND -profit_pct / max_loss >= 0.9e0", "'持仓亏损已接近个人设定的最大亏损线，需警惕止损'"), ("profit_pct < 0 AND -profit_pct / max_loss >= 0.5e0 AND -profit_pct / max_loss < 0.9e0", "'持仓亏损已过半程，建议关注是否继续恶化'"),
    ("profit_pct < -3", f"concat('当前持仓浮亏', {_LOSS}, '%（成本', cost_nav, '，现价', nav, '）')"),
]


def told(texts: list[tuple[str, str]]) -> str:
    """The texts whose conditions hold, in order, joined."""
    return "concat_ws('；', " + ", ".join(f"CASE WHEN {c} THEN {text} END" for c, text in texts) + ")"


def risk_part(name: str) -> str:
    return f"greatest(0e0, least(100e0, 50e0 + {total(RISK[name])}))"


RISK_LEVEL = "CASE WHEN risk_score <= 30 THEN '低' WHEN risk_score <= 50 THEN '中' WHEN risk_score <= 70 THEN '中高' ELSE '高' END"
RISK_COLOUR = "CASE WHEN risk_score <= 30 THEN '#22c55e' WHEN risk_score <= 50 THEN '#eab308' WHEN risk_score <= 70 THEN '#f97316' ELSE '#ef4444' END"
