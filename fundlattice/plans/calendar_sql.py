"""The calendar family in SQL for the comparison engine: as-of joins, self-joins and recursion."""

from __future__ import annotations

from fundlattice.plans.indicator_sql import OVER, days, or_tail, rows, segment_dd
from fundlattice.sources.panel import NAV_SQL


def _r(x: str, places: int = 2) -> str:
    return f"floor(({x}) * {10**places} + 0.5) / {10**places}"


def with_recursion(select: str, *more: str, nav: str = NAV_SQL) -> str:
    return f"WITH RECURSIVE {nav.strip()}{''.join(', ' + m for m in more)} {select}"


#: Exponential means step by step: of gains and losses from the second row on, of values from the first.
_W = (6, 14, 28)
_STEP = ", ".join(f"CASE WHEN m.i = 0 THEN {x} ELSE {x} / {w}.0::DOUBLE + m.{s}{w} * (1 - 1 / {w}.0::DOUBLE) END" for w in _W for s, x in (("g", "greatest(n.r * 100, 0)"), ("l", "greatest(-n.r * 100, 0)")))
MEANS = f"""em AS (SELECT code, i, {', '.join(f'0::DOUBLE AS g{w}, 0::DOUBLE AS l{w}' for w in _W)}, nav AS f, nav AS s, 0::DOUBLE AS dea FROM nav WHERE i = 0
  UNION ALL SELECT n.code, n.i, {_STEP}, n.nav * 2 / 13 + m.f * 11 / 13, n.nav * 2 / 27 + m.s * 25 / 27,
    ((n.nav * 2 / 13 + m.f * 11 / 13) - (n.nav * 2 / 27 + m.s * 25 / 27)) * 2 / 10 + m.dea * 8 / 10
  FROM em m JOIN nav n ON n.code = m.code AND n.i = m.i + 1)"""
_RSI = lambda w: f"CASE WHEN i > {w} AND l{w} > 0 THEN 100 - 100 / (1 + g{w} / l{w}) END"
RSI_DAILY = with_recursion(f"SELECT code, i, {', '.join(f'{_RSI(w)} AS rsi_{w}' for w in _W)} FROM em", MEANS)
_MACD = f"""cm AS (SELECT code, i, CASE WHEN i >= 36 THEN f - s END AS macd_line, CASE WHEN i >= 36 THEN dea END AS signal_line, CASE WHEN i >= 36 THEN f - s - dea END AS histogram,
  CASE WHEN i >= 36 THEN lag(f - s - dea) OVER w END AS histogram_prev,
  CASE WHEN i < 36 THEN NULL WHEN lag(f - s, 2) OVER w < lag(dea, 2) OVER w AND f - s > dea THEN 'golden' WHEN lag(f - s, 2) OVER w > lag(dea, 2) OVER w AND f - s < dea THEN 'dead' ELSE 'none' END AS crossover,
  CASE WHEN i < 36 THEN NULL WHEN f - s - dea > lag(f - s - dea) OVER w THEN 'rising' WHEN f - s - dea < lag(f - s - dea) OVER w THEN 'falling' ELSE 'flat' END AS direction
  FROM em WINDOW w AS (PARTITION BY code ORDER BY i))"""
MACD_DAILY = with_recursion("SELECT * FROM cm", MEANS, _MACD)
_STREAK = (
    "t0 AS (SELECT code, i, CASE WHEN r > 0.0001 THEN 1 WHEN r < -0.0001 THEN -1 ELSE 0 END AS s FROM nav WHERE i >= 1)",
    "t1 AS (SELECT x.code, x.i, max(y.i) FILTER (y.s <> 0) AS f, count(*) AS n FROM t0 x JOIN t0 y ON x.code = y.code AND y.i BETWEEN x.i - 29 AND x.i GROUP BY 1, 2)",
    "t2 AS (SELECT t1.*, t0.s FROM t1 LEFT JOIN t0 ON t1.code = t0.code AND t1.f = t0.i)",
    "t3 AS (SELECT t2.code, t2.i, t2.f, t2.s, t2.n, max(y.i) AS brk FROM t2 LEFT JOIN t0 y ON t2.code = y.code AND y.i < t2.f AND y.i > t2.f - 31 AND y.s <> t2.s GROUP BY ALL)",
    """ts AS (SELECT code, i, CASE WHEN n < 2 THEN '未知' WHEN s > 0 THEN '上涨' WHEN s < 0 THEN '下跌' ELSE '平盘' END AS streak_dir,
      CASE WHEN n < 2 OR f IS NULL THEN 0 ELSE f - greatest(coalesce(brk, 0), i - 30, 0) END AS streak_days FROM t3)""",
)
_FEW = {n: f"{or_tail(n, 5, 'count(r)')}" for n in (30, 60, 90)}
_STD = {n: f"{or_tail(n, 5, 'stddev_samp(r)')}" for n in (30, 60, 90)}
_LOW = {n: (or_tail(n, 5, "min(nav)"), or_tail(n, 5, "max(nav)")) for n in (7, 30, 60, 90)}
_NEG = "FILTER (r < 0)"
_COLUMNS = [
    *[f"{_r(f'(nav / coalesce(lag(nav, {k}) {OVER}, first_value(nav) {OVER}) - 1) * 100')} AS ret_{k}" for k in (1, 5, 10, 20, 60)],
    *[f"CASE WHEN {_FEW[n]} >= 3 THEN {_r(f'{_STD[n]} * sqrt(250) * 100')} END AS vol_{n}" for n in (30, 60, 90)],
    *[f"CASE WHEN {_FEW[n]} >= 3 THEN CASE WHEN {or_tail(n, 5, 'count(r)', _NEG)} < 2 THEN 0 ELSE {_r(f'{or_tail(n, 5, chr(115) + "tddev_samp(r)", _NEG)} * sqrt(250) * 100')} END END AS down_{n}" for n in (30, 60)],
    *[f"CASE WHEN i >= {k - 1} THEN avg(nav) {rows(k)} END AS raw_{k}" for k in (5, 10, 20, 60)],
    *[f"{_r(f'CASE WHEN {hi} = {lo} THEN 50 ELSE (nav - {lo}) / ({hi} - {lo}) * 100 END', 1)} AS pos_{n}" for n, (lo, hi) in _LOW.items()],
    *[f"CASE WHEN count(nav) {days(n)} >= 5 THEN {_r(f'(nav - min(nav) {days(n)}) / min(nav) {days(n)} * 100')} END AS rebound_{n}" for n in (7, 30)],
    *[f"CASE WHEN count(nav) {days(n)} >= 5 THEN {_r(f'(max(nav) {days(n)} - nav) / max(nav) {days(n)} * 100')} END AS pullback_{n}" for n in (7, 30)],
    f"CASE WHEN i >= 10 THEN {_r(f'(nav / lag(nav, 5) {OVER} - lag(nav, 5) {OVER} / lag(nav, 10) {OVER}) * 100')} END AS accel",
    f"list(r) FILTER (r IS NOT NULL) {rows(21)} AS r21, list(r) FILTER (r IS NOT NULL) {rows(60)} AS r60",
    *[f"CASE WHEN {_FEW[n]} >= 5 THEN {_r(f'CASE WHEN {_STD[n]} = 0 THEN 0 ELSE {or_tail(n, 5, "avg(r)")} / {_STD[n]} * sqrt(250) END')} END AS sharpe_{n}" for n in (30, 60)],
    *[f"{or_tail(n, 5, 'avg(r)')} AS mean_{n}, {_FEW[n]} AS n_{n}" for n in (60, 90)],
    *[f"CASE WHEN count(r) {rows(n)} >= 3 THEN {_r(f'CAST(count(r) FILTER (r > 0) {rows(n)} AS DOUBLE) / count(r) {rows(n)} * 100', 1)} END AS win_{name}" for n, name in ((20, 30), (60, 60))],
    f"CASE WHEN i >= 19 THEN avg(nav) {rows(20)} END AS band, stddev_samp(nav) {rows(20)} AS dev",
]
_DD = " ".join(f"JOIN {segment_dd(None, n)} s{n} ON x.code = s{n}.code AND x.i = s{n}.i" for n in (7, 30, 60, 90))
_THEN = " ".join(f"ASOF LEFT JOIN nav p{n} ON x.code = p{n}.code AND x.d - INTERVAL {n} DAYS >= p{n}.d" for n in (7, 30, 60, 90))
_REGIME = "CASE WHEN pct IS NULL THEN '未知' WHEN pct >= 75 THEN '高波动' WHEN pct <= 25 THEN '低波动' ELSE '常态波动' END"
CALENDAR_CTES = (
    MEANS,
    _MACD,
    *_STREAK,
    f"vq AS (SELECT code, i, CASE WHEN i >= 30 THEN stddev_samp(r) {rows(30)} END AS v FROM nav)",
    f"pq AS (SELECT a.code, a.i, CASE WHEN a.i >= 40 THEN {_r('CAST(count(*) FILTER (b.v <= a.v) AS DOUBLE) / count(b.v) * 100', 1)} END AS pct FROM vq a JOIN vq b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.i)",
    f"xa AS (SELECT code, d, i, nav AS x_nav, {', '.join(_COLUMNS)} FROM nav)",
    f"""xb AS (SELECT x.*, {', '.join(f"{_r(f's{n}.dd * 100')} AS dd_{n}" for n in (7, 30, 60, 90))}, {', '.join(f"{_r(f'(x_nav - p{n}.nav) / p{n}.nav * 100')} AS ret_{n}d" for n in (7, 30, 60, 90))}
      FROM xa x {_DD} {_THEN})""",
    f"""ca AS (SELECT b.code, b.d, b.i, {_r('x_nav', 4)} AS nav, ret_1, ret_5, ret_10, ret_20, ret_60, ret_7d, ret_30d, ret_60d, ret_90d, dd_7, dd_30, dd_60, dd_90, vol_30, vol_60, vol_90, down_30, down_60,
      {', '.join(f"{_r(f'raw_{k}', 4)} AS ma_{k}" for k in (5, 10, 20, 60))},
      CASE WHEN b.i < 29 THEN '数据不足，无法判断趋势' WHEN x_nav > raw_5 AND raw_5 > raw_10 AND raw_10 > raw_20 AND raw_20 > raw_60 THEN '多头排列（上升趋势）'
        WHEN x_nav < raw_5 AND raw_5 < raw_10 AND raw_10 < raw_20 AND raw_20 < raw_60 THEN '空头排列（下降趋势）'
        WHEN x_nav > raw_20 AND raw_5 > raw_20 THEN '偏多震荡' WHEN x_nav < raw_20 AND raw_5 < raw_20 THEN '偏空震荡' ELSE '横盘整理' END AS trend,
      pos_7, pos_30, pos_60, pos_90, rebound_7, rebound_30, pullback_7, pullback_30, accel,
      CASE WHEN len(r21) >= 5 THEN {_r("sqrt(list_reduce(list_prepend(r21[1] * r21[1], r21[2:]), lambda s, v: 0.94 * s + 0.06 * v * v)) * sqrt(250) * 100")} END AS ewma,
      pct, {_REGIME} AS regime, {', '.join(f"CASE WHEN n_{n} >= 3 AND dd_{n} > 0 THEN {_r(f'abs(mean_{n} * 250 / (dd_{n} / 100))')} END AS calmar_{n}" for n in (60, 90))},
      sharpe_30, sharpe_60, win_30, win_60, streak_dir, streak_days, {', '.join(f"{_r(_RSI(w).replace('i >', 'b.i >'), 1)} AS rsi_{w}" for w in _W)},
      {_r('histogram', 6)} AS macd_hist, crossover AS macd_cross, direction AS macd_dir,
      CASE WHEN band IS NOT NULL THEN CASE WHEN dev = 0 THEN 50 ELSE {_r('(x_nav - (band - dev * 2)) / (dev * 4) * 100', 1)} END END AS bb_pos, CASE WHEN band IS NOT NULL THEN {_r('dev * 4 / band * 100')} END AS bb_width,
      CASE WHEN len(r60) >= 30 THEN {_r('list_skewness(r60)')} END AS skew
      FROM xb b JOIN em USING (code, i) JOIN cm USING (code, i) JOIN pq USING (code, i) LEFT JOIN ts USING (code, i) WHERE b.i >= 4)""",
)
DOUBLES = (
    "nav ret_1 ret_5 ret_10 ret_20 ret_60 ret_7d ret_30d ret_60d ret_90d dd_7 dd_30 dd_60 dd_90 vol_30 vol_60 vol_90 down_30 down_60 ma_5 ma_10 ma_20 ma_60 pos_7 pos_30 pos_60 pos_90 rebound_7 rebound_30 "
    "pullback_7 pullback_30 accel ewma pct calmar_60 calmar_90 sharpe_30 sharpe_60 win_30 win_60 rsi_6 rsi_14 rsi_28 macd_hist bb_pos bb_width skew"
)
CALENDAR_METRICS = with_recursion("SELECT * FROM ca", *CALENDAR_CTES)

# Missing values as scores take them; kinds of funds; risk. Written out here on their own, with the texts of the context table.
_ZERO = "ret_1 ret_5 ret_7d ret_10 ret_20 ret_30d ret_60 ret_60d ret_90d vol_30 vol_60 vol_90 down_30 down_60 sharpe_30 sharpe_60 rebound_7 rebound_30 pullback_7 pullback_30 accel ewma calmar_60 calmar_90 macd_hist skew"
_FIFTY = "win_30 win_60 pos_7 pos_30 pos_60 pos_90 rsi_6 rsi_14 rsi_28 bb_pos"
_NEUTRAL = ", ".join([*(f"coalesce({c}, 0) AS {c}" for c in _ZERO.split()), *(f"coalesce({c}, 50) AS {c}" for c in _FIFTY.split()), "coalesce(bb_width, 10) AS bb_width", "coalesce(macd_cross, 'none') AS macd_cross", "coalesce(macd_dir, 'flat') AS macd_dir", "coalesce(streak_dir, '未知') AS streak_dir", "coalesce(streak_days, 0) AS streak_days"])
RISK_CTES = (
    f"nj AS (SELECT * REPLACE ({_NEUTRAL}) FROM ca)",
    """jc AS (SELECT nj.*, c.* EXCLUDE (code), regexp_matches(fund_type, 'QDII|科技|医药|医疗|新能源|半导体|芯片|军工|传媒') AS high_vol, contains(upper(fund_type), 'QDII') AS qdii, regexp_matches(fund_type, '债券|货币|同业存单|短债|纯债') AS defensive,
      regexp_matches(fund_type, '股票|指数|混合|ETF|LOF|增强|联接') AND NOT regexp_matches(fund_type, '债券|货币|同业存单|短债|纯债') AND NOT contains(upper(fund_type), 'QDII') AS china,
      CASE WHEN cost_nav > 0 AND nav > 0 THEN (nav - cost_nav) / cost_nav * 100 END AS profit_pct, coalesce(max_loss_percent, 20) AS max_loss, regexp_matches(trend, '空头|下降') AS falls,
      coalesce(cost_nav > 0, FALSE) OR coalesce(holding_amount > 0, FALSE) OR coalesce(holding_units > 0, FALSE) AS has_position FROM nj LEFT JOIN ctx c ON nj.code = c.code)""",
    """r1 AS (SELECT *,
      50 + CASE WHEN ret_30d > 10 THEN -10 WHEN ret_30d < -10 THEN 15 WHEN ret_30d < -5 THEN 8 WHEN ret_30d < 0 THEN 3 ELSE 0 END + CASE WHEN ret_60d < -15 THEN 12 WHEN ret_60d < -5 THEN 5 ELSE 0 END
        + CASE WHEN ret_90d < -20 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(trend, '空头排列|下降') THEN 15 WHEN regexp_matches(trend, '多头排列|上升') THEN -10 WHEN trend LIKE '%偏空%' THEN 8 ELSE 0 END + CASE WHEN nav < ma_20 THEN 5 ELSE 0 END AS t_,
      50 + CASE WHEN dd_30 > 10 THEN 20 WHEN dd_30 > 5 THEN 10 WHEN dd_30 > 3 THEN 5 ELSE 0 END + CASE WHEN dd_60 > 15 THEN 15 WHEN dd_60 > 8 THEN 8 ELSE 0 END + CASE WHEN dd_90 > 20 THEN 12 ELSE 0 END AS d_,
      50 + CASE WHEN vol_30 > 40 THEN 20 WHEN vol_30 > 25 THEN 12 WHEN vol_30 > 15 THEN 5 WHEN vol_30 < 10 THEN -10 ELSE 0 END + CASE WHEN vol_60 > 35 THEN 10 ELSE 0 END + CASE WHEN down_30 > 25 THEN 8 ELSE 0 END AS v_,
      50 + CASE WHEN pos_30 > 80 AND vol_30 > 25 THEN 18 WHEN pos_30 > 80 THEN 10 WHEN pos_30 > 60 THEN 3 ELSE 0 END + CASE WHEN pos_30 < 20 AND falls THEN 12 WHEN pos_30 < 20 THEN -5 ELSE 0 END
        + CASE WHEN pos_60 > 85 THEN 5 ELSE 0 END + CASE WHEN pos_90 < 15 THEN 5 ELSE 0 END AS p_,
      50 + CASE WHEN NOT coalesce(macro_ok, FALSE) THEN 0 ELSE CASE risk_appetite WHEN 'risk-off' THEN 8 WHEN 'risk-on' THEN -5 ELSE 0 END + CASE overseas WHEN 'bearish' THEN 5 WHEN 'bullish' THEN -3 ELSE 0 END
        + CASE WHEN regexp_matches(forex_pressure, '压力|贬值') THEN 5 ELSE 0 END + CASE WHEN commodity_disturbance LIKE '%扰动%' THEN 3 ELSE 0 END END AS m_,
      50 + CASE WHEN profit_pct IS NULL THEN 0 ELSE CASE WHEN profit_pct < 0 AND -profit_pct / max_loss >= 0.9::DOUBLE THEN 25 WHEN profit_pct < 0 AND -profit_pct / max_loss >= 0.5::DOUBLE THEN 15 WHEN profit_pct < -5 THEN 8 WHEN profit_pct < 0 THEN 3 WHEN profit_pct > 10 THEN -10 ELSE -5 END
        + CASE preference WHEN '保守' THEN 10 WHEN '激进' THEN -8 ELSE 0 END + CASE WHEN holding_amount > 500000 THEN 5 ELSE 0 END END AS o_ FROM jc)""",
    """r2 AS (SELECT * EXCLUDE (t_, d_, v_, p_, m_, o_, falls), """ + ", ".join(f"greatest(0, least(100, {c}_))::DOUBLE AS {name}" for c, name in zip("tdvpmo", ("trend_risk", "drawdown_risk", "volatility_risk", "position_risk", "macro_risk", "personal_risk"))) + """ FROM r1)""",
    """rk AS (SELECT *, CASE WHEN risk_score <= 30 THEN '低' WHEN risk_score <= 50 THEN '中' WHEN risk_score <= 70 THEN '中高' ELSE '高' END AS risk_level,
      CASE WHEN risk_score <= 30 THEN '#22c55e' WHEN risk_score <= 50 THEN '#eab308' WHEN risk_score <= 70 THEN '#f97316' ELSE '#ef4444' END AS risk_colour FROM
      (SELECT *, floor(list_avg(list_concat([trend_risk, drawdown_risk, volatility_risk, position_risk, macro_risk], CASE WHEN has_position THEN [personal_risk] ELSE [] END)) * 10 + 0.5::DOUBLE) / 10 AS risk_score FROM r2))""",
)


def with_risk(select: str, context: str, *more: str, nav: str = NAV_SQL) -> str:
    return with_recursion(select, *CALENDAR_CTES, f"ctx AS ({context})", *RISK_CTES, *more, nav=nav)
