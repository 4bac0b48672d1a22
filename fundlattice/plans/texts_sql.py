"""Reasons, triggers, conditions and watch lists in SQL, written apart from the operators' tables of ladders."""

from __future__ import annotations

from fundlattice.operators import decisions as dec
from fundlattice.plans import decision_queries as dq
from fundlattice.plans.calendar_sql import with_risk

_SX = """sx AS (SELECT rk.*, h AS horizon, regexp_matches(trend, '多头排列|上升') AS bull, NOT regexp_matches(trend, '多头排列|上升') AND regexp_matches(trend, '空头排列|下降') AS bear, regexp_matches(trend, '空头|下降') AS soft,
  h IN (1, 3) AS brief, rsi_14 > 65 OR pos_30 > 80 AS hot, rsi_14 < 35 OR pos_30 < 20 AS cold, estimate_day > d AND estimate_change <> 0 AND h <> 30 AS told FROM rk CROSS JOIN (VALUES (1), (3), (7), (30)) t(h))"""


def _few(n: int, c: str, hs: str) -> str:
    return f"""CASE WHEN horizon NOT IN ({hs}) THEN NULL WHEN {c} > 2.5 THEN '近{n}个交易日涨幅较强(' || {c} || '%)' || CASE WHEN hot THEN '但已高位，追高风险' ELSE '，短线动能偏强' END
      WHEN {c} <= -2.5 THEN '近{n}个交易日跌幅较大(' || {c} || '%)' || CASE WHEN cold THEN '但已超卖，关注反弹' ELSE '，短线承压' END WHEN {c} <= -1 THEN '近{n}个交易日下跌(' || {c} || '%)' END"""


def _more(n: int, c: str, hs: str) -> str:
    return f"""CASE WHEN horizon NOT IN ({hs}) THEN NULL WHEN {c} > 10 THEN '近{n}天涨幅较大(' || {c} || '%)' || CASE WHEN pos_60 > 85 OR rsi_14 > 70 THEN '但已高位' ELSE '，短期动能强' END WHEN {c} <= -15 THEN '近{n}天跌幅显著(' || {c} || '%)，下行压力大'
      WHEN {c} <= -7 THEN '近{n}天跌幅较大(' || {c} || '%)' || CASE WHEN pos_60 < 25 OR rsi_14 < 35 THEN '但已低位，关注反弹' ELSE '' END WHEN {c} <= -3 THEN '近{n}天下跌(' || {c} || '%)' END"""


_REASONS = f"""[CASE WHEN bull THEN CASE WHEN rsi_14 > 70 THEN '均线多头但RSI超买，追高风险大' WHEN rsi_14 > 60 THEN '均线多头但RSI偏高，谨慎追涨' ELSE '均线多头排列，趋势偏强' END
   WHEN bear THEN CASE WHEN rsi_14 < 30 THEN '均线空头但RSI超卖，可能反弹' WHEN rsi_14 < 40 THEN '均线空头但RSI偏低，关注反弹' ELSE '均线空头排列，趋势偏弱' END
   WHEN contains(trend, '偏多') THEN '均线偏多震荡' WHEN contains(trend, '偏空') THEN '均线偏空震荡' ELSE '均线横盘整理，缺乏明确方向' END,
 {_few(1, 'ret_1', '1, 3')}, {_few(5, 'ret_5', '1, 3, 7')}, {_more(7, 'ret_7d', '1, 3, 7')}, {_more(30, 'ret_30d', '7, 30')}, {_more(60, 'ret_60d', '30')}, {_more(90, 'ret_90d', '30')},
 CASE WHEN dd_30 > 15 THEN '近30天最大回撤较大(' || dd_30 || '%)' END, CASE WHEN dd_60 > 15 THEN '近60天最大回撤较大(' || dd_60 || '%)' END, CASE WHEN dd_90 > 15 AND horizon NOT IN (3, 7) THEN '近90天最大回撤较大(' || dd_90 || '%)' END,
 CASE WHEN vol_30 > 35 AND high_vol THEN '高波动基金，近30天波动率' || vol_30 || '%，不确定性高' WHEN vol_30 > 35 THEN '近30天波动率极高(' || vol_30 || '%)，方向不确定性强' WHEN vol_30 > 25 THEN '近30天波动率较高(' || vol_30 || '%)' WHEN vol_30 < 10 THEN '波动率较低(' || vol_30 || '%)，走势相对平稳' END,
 CASE WHEN sharpe_30 < -1 AND horizon IN (3, 7) THEN '夏普比率为负，风险调整后收益不佳' END,
 CASE WHEN pos_30 > 80 THEN CASE WHEN vol_30 > 25 THEN '净值在近30日高位且波动高，追高风险' END WHEN pos_30 < 20 THEN CASE WHEN soft THEN '净值在近30日低位但趋势仍空头，左侧风险' ELSE '净值在近30日低位，可能接近阶段性底部' END END,
 CASE WHEN pos_60 > 85 THEN '净值在近60日高位区间' END, CASE WHEN pos_90 < 15 THEN '净值在近90日低位区间' END, CASE WHEN rebound_30 > 8 THEN '近期反弹强度' || rebound_30 || '%' END, CASE WHEN pullback_30 > 8 THEN '近期从高点回落' || pullback_30 || '%' END,
 CASE WHEN win_30 < 40 THEN '近30天上涨胜率仅' || win_30 || '%' END,
 CASE WHEN macro_ok AND risk_appetite = 'risk-off' THEN '宏观风险偏好偏避险' END, CASE WHEN macro_ok AND liquidity = 'tight' THEN '银行间资金面偏紧，流动性收缩不利于风险资产' WHEN macro_ok AND liquidity = 'loose' AND risk_appetite <> 'risk-off' THEN '银行间资金面宽松，流动性充裕支持风险资产' END,
 CASE WHEN nav <= ma_20 THEN '净值低于20日均线' END,
 CASE WHEN brief AND nav > ma_5 AND ma_5 > ma_10 THEN '净值站上5日、10日均线，短线结构偏强' WHEN brief AND nav < ma_5 AND ma_5 < ma_10 THEN '净值低于5日、10日均线，短线结构偏弱' END,
 CASE WHEN brief AND streak_days >= 3 THEN CASE streak_dir WHEN '上涨' THEN '已连续上涨' || streak_days || '天，短线惯性偏强' || CASE horizon WHEN 1 THEN '但需防回吐' ELSE '' END WHEN '下跌' THEN '已连续下跌' || streak_days || '天，短线仍承压' END END,
 CASE WHEN brief AND abs(accel) > 1 THEN '5日动能加速度为' || accel || '%，' || CASE horizon WHEN 1 THEN '短线' ELSE '' END || '动能' || CASE WHEN accel > 0 THEN '改善' ELSE '转弱' END END,
 CASE WHEN brief AND pos_7 > 85 AND ret_1 > 0 THEN '净值接近7日高位，' || CASE horizon WHEN 1 THEN '次日' ELSE '3日' END || '追高回撤风险上升' WHEN brief AND pos_7 < 15 AND ret_1 < 0 AND NOT contains(trend, '空头') THEN '净值接近7日低位，存在' || CASE horizon WHEN 1 THEN '短线' ELSE '3日' END || '修复可能' END,
 CASE WHEN brief AND pullback_7 > 3 THEN '近7日从高点回落' || pullback_7 || '%' END,
 CASE WHEN horizon = 7 AND least(ret_1, ret_5, accel) > 0 THEN '1日、5日动能同步为正，7日方向偏强' WHEN horizon = 7 AND greatest(ret_1, ret_5, accel) < 0 THEN '1日、5日动能同步为负，7日方向承压' END,
 CASE WHEN horizon = 7 AND ewma > 0 AND vol_30 > 0 THEN CASE WHEN ewma > vol_30 * 1.15::DOUBLE THEN 'EWMA短线波动高于30日波动，近期不确定性上升' WHEN ewma < vol_30 * 0.85::DOUBLE THEN '短线波动有所收敛，7日判断稳定性略有改善' END END,
 CASE WHEN qdii AND macro_ok THEN CASE overseas WHEN 'bearish' THEN '海外市场偏弱，QDII基金可能承压' WHEN 'bullish' THEN '海外市场偏强，有利于QDII基金' END END,
 CASE WHEN china AND macro_ok THEN CASE risk_appetite WHEN 'risk-on' THEN '国内权益类基金受风险偏好改善支撑' WHEN 'risk-off' THEN '国内权益类基金受风险偏好走弱压制' END END,
 CASE WHEN defensive THEN '债券/货币等低波动品类，涨跌弹性相对有限' END, CASE WHEN regime = '高波动' THEN '当前波动率处于较高分位，预测误差可能放大' END,
 CASE WHEN rsi_14 > 75 THEN 'RSI(14)=' || rsi_14 || '，处于超买区间，短期回调风险累积' WHEN rsi_14 > 65 THEN 'RSI(14)=' || rsi_14 || '，偏强但接近超买' WHEN rsi_14 <= 0 THEN NULL WHEN rsi_14 < 25 THEN 'RSI(14)=' || rsi_14 || '，处于超卖区间，技术性反弹概率上升' WHEN rsi_14 < 35 THEN 'RSI(14)=' || rsi_14 || '，偏弱但接近超卖，关注企稳信号' END,
 CASE WHEN rsi_14 > 0 AND rsi_6 - rsi_14 > 5 AND rsi_6 > rsi_14 + 5 THEN '短期RSI上穿长期RSI，短线动能改善' WHEN rsi_6 > 0 AND rsi_6 < rsi_14 - 5 THEN '短期RSI下穿长期RSI，短线动能转弱' END,
 CASE macd_cross WHEN 'golden' THEN CASE WHEN horizon = 30 THEN 'MACD金叉，中期趋势可能转好' ELSE 'MACD金叉，技术面发出看多信号' END WHEN 'dead' THEN CASE WHEN horizon = 30 THEN 'MACD死叉，中期趋势可能转弱' ELSE 'MACD死叉，技术面发出看空信号' END END,
 CASE WHEN macd_hist < 0 THEN CASE macd_dir WHEN 'rising' THEN 'MACD绿柱收窄，空方动能减弱' WHEN 'falling' THEN 'MACD绿柱扩大，空方动能增强' END WHEN macd_hist > 0 THEN CASE macd_dir WHEN 'falling' THEN 'MACD红柱收窄，多方动能减弱' WHEN 'rising' THEN 'MACD红柱扩大，多方动能增强' END END,
 CASE WHEN bb_pos >= 95 THEN '净值触及布林带上轨，短期超买，回档压力增大' WHEN bb_pos <= 5 THEN '净值触及布林带下轨，短期超卖，技术反弹概率上升' END,
 CASE WHEN bb_width > 20 AND horizon >= 7 THEN '布林带宽度' || bb_width || '%，波动较大，方向不确定性高' WHEN bb_width < 5 AND horizon <> 1 THEN '布林带收窄，可能酝酿方向性突破' END,
 CASE WHEN horizon < 7 THEN NULL WHEN skew < -0.8::DOUBLE THEN '近期收益率左偏（skew=' || skew || '），极端负收益出现概率偏高' WHEN skew > 0.8::DOUBLE THEN '近期收益率右偏（skew=' || skew || '），正收益分布占优' END]"""


def _rises(n: int, c: str, hs: str) -> str:
    return f"CASE WHEN horizon NOT IN ({hs}) THEN NULL WHEN {c} > 2.5 AND NOT hot THEN '近{n}个交易日动能延续且回撤不扩大' WHEN {c} <= -2.5 AND cold THEN '超卖反弹机会' END"


def _falls(n: int, c: str, hs: str) -> str:
    return f"CASE WHEN horizon NOT IN ({hs}) THEN NULL WHEN {c} > 2.5 THEN CASE WHEN hot THEN '短期大涨后高位回调风险' ELSE '短线快速上涨后出现回吐，需防止冲高回落' END WHEN {c} <= -2.5 AND NOT cold THEN '短线跌势未止，继续跌破前低' END"


_UP = f"""[CASE WHEN bull AND rsi_14 <= 60 THEN '均线多头排列持续，且未出现高位放量滞涨' WHEN bear AND rsi_14 < 30 THEN 'RSI超卖后反弹机会' END, CASE WHEN bear THEN '出现放量反弹且站上20日均线，均线开始走平' END,
 {_rises(1, 'ret_1', '1, 3')}, {_rises(5, 'ret_5', '1, 3, 7')},
 {', '.join(f"CASE WHEN horizon IN ({hs}) AND {c} > 10 AND pos_60 <= 85 AND rsi_14 <= 70 THEN '近{n}天涨幅延续且成交量配合' END" for n, c, hs in ((7, 'ret_7d', '1, 3, 7'), (30, 'ret_30d', '7, 30'), (60, 'ret_60d', '30'), (90, 'ret_90d', '30')))},
 CASE WHEN pos_30 < 20 AND NOT soft THEN '低位企稳，出现连续放量阳线' END, CASE WHEN rebound_30 > 8 THEN '反弹持续且放量站上关键均线' END,
 CASE WHEN brief AND nav > ma_5 AND ma_5 > ma_10 THEN '继续站稳5日均线且' || CASE horizon WHEN 1 THEN '单日' ELSE '3日' END || '回撤收窄' END, CASE WHEN brief AND streak_days >= 3 AND streak_dir = '下跌' THEN '连续下跌后出现止跌阳线并收复5日均线' END,
 CASE WHEN rsi_14 > 0 AND rsi_14 < 25 THEN 'RSI从超卖区间回升，配合量能放大' END, CASE WHEN horizon <> 30 AND macd_cross = 'golden' THEN '金叉后DIF继续上行且柱状线扩大' WHEN horizon <> 30 AND macd_cross = 'dead' THEN '死叉失效，DIF重新上穿DEA' END,
 CASE WHEN bb_pos <= 5 THEN '从布林带下轨反弹且站上中轨' END]"""
_DOWN = f"""[CASE WHEN bull AND rsi_14 > 70 THEN 'RSI超买后回调风险' WHEN bear AND rsi_14 >= 40 THEN '空头排列延续，继续创新低' END, CASE WHEN bull THEN '均线出现死叉，或跌破60日均线支撑' END,
 {_falls(1, 'ret_1', '1, 3')}, {_falls(5, 'ret_5', '1, 3, 7')},
 {', '.join(f"CASE WHEN horizon NOT IN ({hs}) THEN NULL WHEN {c} > 10 THEN '近{n}天涨幅过快后出现高位放量回落' WHEN {c} <= -15 THEN '下跌趋势未止住，继续新低' END" for n, c, hs in ((7, 'ret_7d', '1, 3, 7'), (30, 'ret_30d', '7, 30'), (60, 'ret_60d', '30'), (90, 'ret_90d', '30')))},
 CASE WHEN pos_30 > 80 AND vol_30 > 25 THEN '高位放量回落，跌破短期均线' WHEN pos_30 < 20 AND soft THEN '继续创新低，下跌趋势未结束' END, CASE WHEN rebound_30 > 8 THEN '反弹遇阻回落，跌破反弹起点' END, CASE WHEN pullback_30 > 8 THEN '回落幅度扩大，形成下降通道' END,
 CASE WHEN brief AND nav < ma_5 AND ma_5 < ma_10 THEN '跌破5日均线后继续低于10日均线' END, CASE WHEN brief AND streak_days >= 3 AND streak_dir = '上涨' THEN '连续上涨后单日转跌且跌幅扩大' END,
 CASE WHEN rsi_14 > 75 THEN 'RSI从超买区间回落，配合量能放大' END, CASE WHEN horizon <> 30 AND macd_cross = 'golden' THEN '金叉失败，DIF重新下穿DEA' WHEN horizon <> 30 AND macd_cross = 'dead' THEN '死叉后DIF继续下行且柱状线扩大' END,
 CASE WHEN bb_pos >= 95 THEN '从布林带上轨回落且跌破中轨' END]"""


def _once(l: str) -> str:
    return f"list_filter({l}, lambda x, k: x IS NOT NULL AND list_position({l}, x) = k)"


_LISTS = (_SX, f"sl AS (SELECT *, {_REASONS} AS r0, {_UP} AS u0, {_DOWN} AS w0 FROM sx)")
SCORE_REASONS_SQL = with_risk(
    f"SELECT code, i, horizon, array_to_string({_once('r0')}, '；') AS reasons, array_to_string({_once('u0')}[:4], '；') AS up_triggers, array_to_string({_once('w0')}[:4], '；') AS down_triggers FROM sl", dq.CONTEXT, *_LISTS
)
_FORECASTS = (
    *_LISTS,
    dq.GATED_CTE,
    """fl AS (SELECT sl.*, fg.gate, fg.up1, fg.down1, fg.confidence, list_concat(r0, [CASE WHEN sl.risk_score > 70 THEN '综合风险评分较高，下行不确定性大' END, CASE WHEN high_vol THEN '该基金类型波动性较大，概率判断的不确定性较高' END,
        CASE WHEN told THEN '当日估算涨跌' || estimate_change || '%（非正式净值）' END,
        (CASE WHEN horizon >= 7 THEN '多空信号冲突：' ELSE '注意信号冲突：' END) || nullif(concat_ws('；', CASE WHEN ret_30d > 3 AND soft THEN '短期反弹但中期趋势仍为空头' END, CASE WHEN pos_30 < 25 AND soft THEN '处于低位但下跌趋势未结束' END,
          CASE WHEN pos_30 > 75 AND contains(trend, '多头') AND ret_30d > 10 THEN '趋势偏多但处于高位，追高风险' END, CASE WHEN rebound_30 > 10 AND vol_30 > 30 THEN '反弹力度强但波动率仍高，方向不确定' END), '')]) AS r1,
      list_concat(u0, [CASE WHEN told AND estimate_change > 1 THEN '当日估算继续转强并收复5日均线' END]) AS u1, list_concat(w0, [CASE WHEN told AND estimate_change < -1 THEN '当日估算继续走弱且跌破前低' END]) AS w1
      FROM sl JOIN fg USING (code, i, horizon))""",
    f"""ft AS (SELECT code, i, horizon, risk_score, quality, up1, down1, confidence,
      CASE gate WHEN 'insufficient' THEN ['历史数据仅' || (i + 1) || '个交易日，不足以进行' || horizon || '天情景判断'] WHEN 'low_confidence' THEN list_concat({_once('r1')}[:6], ['历史数据少于60个交易日，中期预测置信度低']) ELSE {_once('r1')}[:6] END AS reasons,
      CASE WHEN gate = 'insufficient' THEN ['数据充足后再进行评估'] WHEN len({_once('u1')}) = 0 THEN ['放量站上20日均线且均线开始拐头向上', '短期回撤企稳且出现连续阳线'] ELSE {_once('u1')}[:4] END AS ups,
      CASE WHEN gate = 'insufficient' THEN ['数据充足后再进行评估'] WHEN len({_once('w1')}) = 0 THEN ['跌破近期关键支撑位且放量', '均线出现空头排列信号'] ELSE {_once('w1')}[:4] END AS downs FROM fl)""",
)
FORECAST_REASONS_SQL = with_risk("SELECT code, i, horizon, array_to_string(reasons, '；') AS reasons, array_to_string(ups, '；') AS up_triggers, array_to_string(downs, '；') AS down_triggers FROM ft", dq.CONTEXT, *_FORECASTS)
SUPPORT_SQL = with_risk(
    f"""SELECT code, i, CASE WHEN risk_score > 70 THEN '降低仓位风险' WHEN coalesce(quality, '') = 'low' THEN '观望（回测未验证规则有效性）' WHEN up1 - down1 > 15 AND confidence <> '低' THEN '偏积极' WHEN down1 - up1 > 15 THEN '偏谨慎' ELSE '观望' END AS action_bias,
      array_to_string({_once('u')}[:3], '；') AS buy_watch, array_to_string({_once('w')}[:3], '；') AS reduce_watch, '净值跌破60日均线且放量；波动率突破历史高位（分位>80%）；连续3个交易日下跌且跌幅扩大' AS invalidation_signals,
      CASE WHEN coalesce(quality, 'low') = 'low' THEN '回测未证明规则模型稳定优于基准模型，概率仅作低置信参考，历史回测不代表未来表现。' ELSE '历史回测准确率不代表未来表现，决策应结合多方信息。' END AS model_quality_note
    FROM (SELECT a.*, list_concat(a.ups[:2], b.ups[:2]) AS u, list_concat(a.downs[:2], b.downs[:2]) AS w FROM ft a JOIN ft b ON a.code = b.code AND a.i = b.i WHERE a.horizon = 7 AND b.horizon = 30)""",
    dq.CONTEXT,
    *_FORECASTS,
)
# DEC-1 and DEC-2: what other models would say comes from the stubs, everything else is written out.
_ADVISED = f"""av AS (SELECT *, CASE WHEN risk_score >= 75 THEN 1 WHEN weak AND risk_score > 55 THEN 2 WHEN risk_score >= 60 THEN 3 WHEN strong AND trusted AND risk_score < 55 THEN 4 ELSE 5 END AS rule, coalesce(NOT trusted, TRUE) AS doubt,
    CASE WHEN cost_nav > 0 THEN (nav - cost_nav) / cost_nav * 100 END AS gain, coalesce(has_position, FALSE) AS held
  FROM (SELECT *, regexp_matches(text_7d, '下行|偏跌|下跌|偏弱') OR regexp_matches(text_30d, '下行|偏跌|下跌|偏弱') AS weak, regexp_matches(text_7d, '上行|偏涨|上涨|偏强') AND regexp_matches(text_30d, '上行|偏涨|上涨|偏强') AS strong, quality <> 'low' AND calibrated AS trusted
    FROM {dec.stages_sql('rk', dq.STUBS)}))"""
_KEPT = "list_filter({}, lambda x: x IS NOT NULL)".format
_WARNINGS = _KEPT(
    """[CASE rule WHEN 1 THEN CASE WHEN held THEN '风险评分处于高位，继续持有可能面临较大回撤。' ELSE '高风险环境下追高买入不确定性较大，适合等待风险释放后再评估。' END WHEN 2 THEN CASE WHEN held THEN '走势偏弱叠加风险偏高，若继续下行需关注止损。' ELSE '走势偏弱环境下买入容易被套，耐心等待企稳信号。' END
   WHEN 3 THEN CASE WHEN held THEN '风险处于偏高水平，需密切关注市场变化和个人止损线。' ELSE '当前风险水平下大额买入需承担较大不确定性。' END WHEN 4 THEN '即使信号偏积极，仍需控制总仓位，避免一次性满仓。' END, CASE WHEN doubt THEN '模型概率估计尚不稳定，情景判断可能偏差较大。' END]"""
)
_NAME = "CASE WHEN i % 3 = 0 THEN '该基金' ELSE code END"
ADVICE_SQL = with_risk(
    f"""SELECT code, i, CASE rule WHEN 1 THEN CASE WHEN held THEN '降低仓位' ELSE '暂缓新增' END WHEN 2 THEN CASE WHEN held THEN '谨慎持有' ELSE '观望' END WHEN 3 THEN CASE WHEN held THEN '谨慎持有' ELSE '小额试探' END WHEN 4 THEN '分批关注' ELSE '观望' END AS advice_label,
      array_to_string({_KEPT('''[CASE WHEN rule = 5 AND doubt THEN '回测未证明模型稳定优于基线，方向判断仅低置信参考。' END,
        CASE rule WHEN 1 THEN CASE WHEN held THEN '综合风险评分较高（≥75），当前市场环境不利，可考虑降低仓位风险。' ELSE '综合风险评分较高（≥75），当前不适合新开仓或大额买入。' END
         WHEN 2 THEN CASE WHEN held THEN '短期走势偏弱且风险评分偏高（>55），当前不适合追加仓位。' ELSE '短期走势偏弱且风险评分偏高（>55），适合暂时观望，等待方向明朗。' END
         WHEN 3 THEN CASE WHEN held THEN '风险评分偏高（≥60），适合谨慎持有，暂不追加仓位。' ELSE '风险评分偏高（≥60），若确有意向可小额试探，不宜大额买入。' END WHEN 4 THEN '短期和中期走势均偏强，风险评分较低，回测验证可接受，可考虑分批关注。' ELSE '当前信号不够明确，适合观望等待更清晰的方向选择。' END,
        CASE WHEN rule = 4 THEN '分多批关注有助于避免一次性满仓，降低择时风险。' END, CASE WHEN rule <> 5 AND doubt THEN '回测未证明模型稳定优于基线，方向判断仅低置信参考。' END]''')}, '') AS reasons,
      array_to_string({_WARNINGS}, '') AS risk_warnings,
      CASE WHEN rule = 2 AND NOT held THEN '等待7日或30日走势企稳（方向转为偏强或震荡），且风险评分回落至55以下。' WHEN rule = 3 AND NOT held THEN '试探仓位参考计划金额的10%-20%，确认走势企稳后再考虑追加。'
        WHEN rule = 4 THEN '分2-3批关注，每批间隔至少3-5个交易日，观察走势是否持续偏强。若关注期间走势转弱或风险评分上升至55以上，暂停后续批次。' WHEN rule = 5 THEN '等待7日、30日走势方向一致偏强且风险评分低于55。' ELSE '' END AS buy_conditions,
      CASE WHEN rule = 1 AND held THEN '若跌破个人止损线或关键支撑位，应重新评估是否继续持有。' WHEN rule = 2 AND held THEN '若连续下破关键支撑或亏损扩大，可考虑降低仓位风险。' ELSE '' END
        || CASE WHEN gain < 0 AND -gain >= max_loss_percent * 0.8::DOUBLE THEN '浮亏已逼近最大可承受亏损（' || max_loss_percent || '%），若继续扩大应重新评估止损或降仓。' WHEN gain > 0 AND risk_score > 55 THEN '浮盈状态下若风险评分持续偏高，可考虑适当降低仓位风险。' ELSE '' END AS sell_conditions,
      CASE WHEN rule = 1 AND NOT held THEN '若风险评分回落至60以下且走势企稳，可重新评估。' WHEN rule = 4 THEN '若7日方向转弱或风险评分突破55，暂停关注计划。' ELSE '' END || CASE WHEN doubt THEN '后续需以新的回测结果验证模型是否稳定优于基线。' ELSE '' END AS invalidation_signals,
      CASE WHEN gain < 0 AND max_loss_percent IS NOT NULL THEN '当前浮亏 ' || printf('%.1f', -gain) || CASE WHEN -gain >= max_loss_percent * 0.8::DOUBLE THEN '%，已接近最大亏损线 ' || max_loss_percent || '%，需关注止损纪律。' ELSE '%，暂在可承受范围内。' END
        WHEN gain > 0 AND risk_score > 55 THEN '当前浮盈 ' || printf('%.1f', gain) || '%，但短期风险偏高，可考虑降低仓位风险。' WHEN gain IS NOT NULL THEN '当前浮动盈亏约 ' || printf('%+.1f', gain) || '%。' ELSE '' END AS position_hint,
      {_NAME} || CASE rule WHEN 1 THEN CASE WHEN held THEN '风险评分高，可考虑降低仓位风险。' ELSE '当前风险较高，暂不适合新开仓。' END WHEN 2 THEN CASE WHEN held THEN '适合谨慎持有，暂不追加。' ELSE '信号不明确，适合观望等待。' END
        WHEN 3 THEN CASE WHEN held THEN '适合谨慎持有，暂不追加。' ELSE '可小额试探，不宜大额买入。' END WHEN 4 THEN '信号偏积极，可考虑分批关注。' ELSE '信号不明确，适合观望等待。' END AS advice_summary
    FROM av""",
    dq.CONTEXT,
    _ADVISED,
)
_AGAINST = "CASE WHEN edge_value_{0} <= 0 THEN '该周期历史验证未显示模型优于简单基线，不应据此单独决策。' WHEN conf_{0} = '低' THEN '该周期虽然有信号，但置信度不足，应结合风险评分和仓位控制。' WHEN edge_value_{0} IS NULL THEN '样本不足，不应把该概率当作可靠预测。' END".format
FINAL_SQL = with_risk(
    f"""SELECT code, i, array_to_string({_KEPT('''[CASE WHEN open THEN '历史验证未显示稳定预测优势，当前方向难以判断。' ELSE CASE way WHEN 'up' THEN '7天和30天预测方向均偏涨，风险评分处于可接受区间。' WHEN 'down' THEN '短期或中期预测偏弱，且风险评分偏高，走势可能承压。' WHEN 'neutral' THEN '部分周期偏涨但信号不够一致，整体偏震荡。' ELSE '多周期信号不一致，方向不明确。' END END,
        CASE WHEN open AND NOT held AND risk_score < 70 THEN '预测优势不足，建议等待更明确信号。' END]''')}, '') AS why,
      CASE WHEN held AND risk_score BETWEEN 60 AND 69.99 THEN '关注风险评分变化，若持续上升可考虑降低仓位。' ELSE '' END || CASE WHEN risk_score >= 60 AND risk_score < 75 THEN '风险评分 ' || risk_score || ' 偏高，需持续关注。' ELSE '' END AS watch,
      array_to_string({_once('ws')}[:4], '') AS warning, label AS direction_label, CASE act WHEN 'reduce' THEN '降低仓位' WHEN 'hold' THEN '继续持有' WHEN 'avoid' THEN '暂不参与' WHEN 'buy_watch' THEN '可小额关注' ELSE '观察' END AS action_label,
      CASE WHEN held THEN '已有持仓' ELSE '未持有' END || '，方向' || label || '，风险分 ' || regexp_replace(risk_score::VARCHAR, '\\.0$', '') || '，置信度' || CASE way WHEN 'up' THEN CASE WHEN '高' IN (conf_7d, conf_30d) THEN '高' ELSE '中' END WHEN 'down' THEN '中' ELSE '低' END || '。'
        || CASE act WHEN 'reduce' THEN '优先评估是否降低仓位，避免继续追加。' WHEN 'hold' THEN '以继续观察和控制仓位为主。' WHEN 'avoid' THEN '更适合先放入观察名单，暂不新开仓。' WHEN 'buy_watch' THEN '可列入小额关注候选，仍需分批和控仓。' ELSE '先等待更清晰信号，不急于参与。' END AS final_summary
    FROM (SELECT *, CASE way WHEN 'up' THEN '偏涨' WHEN 'down' THEN '偏跌' WHEN 'neutral' THEN '震荡' ELSE '不确定' END AS label,
        CASE WHEN risk_score >= 70 THEN CASE WHEN held THEN 'reduce' ELSE 'avoid' END WHEN risk_score >= 60 AND held THEN 'hold' WHEN open AND NOT held THEN 'observe' WHEN way = 'up' AND risk_score < 55 THEN 'buy_watch' WHEN way = 'down' AND held THEN 'reduce' ELSE 'observe' END AS act,
        list_concat([CASE WHEN risk_score >= 70 THEN CASE WHEN held THEN '当前持仓且风险评分较高（≥70），不建议追加仓位。' ELSE '风险评分较高（≥70），暂不适合新开仓。' END END, CASE WHEN risk_score >= 75 THEN '综合风险评分 ' || risk_score || '，处于高位，需警惕回撤风险。' END,
          {_AGAINST('7d')}, {_AGAINST('30d')}], {_WARNINGS}[:2]) AS ws
      FROM (SELECT *, CASE WHEN open THEN 'uncertain' WHEN dir_7d = 'up' AND dir_30d = 'up' AND (conf_7d <> '低' OR conf_30d <> '低') AND risk_score < 60 THEN 'up' WHEN (dir_7d <> 'up' OR dir_30d <> 'up') AND risk_score >= 60 THEN 'down' WHEN 'up' IN (dir_7d, dir_30d) THEN 'neutral' ELSE 'uncertain' END AS way
        FROM (SELECT *, NOT edge_7d AND NOT edge_30d OR conf_7d = '低' AND conf_30d = '低' OR pred_quality = 'low' AS open FROM av)))""",
    dq.CONTEXT,
    _ADVISED,
)
