"""Queries on what is told in words, on forecasts that backtests correct and on holdings of years, each with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlattice.operators import backtest as bt
from fundlattice.operators import calendar
from fundlattice.operators import decisions as dec
from fundlattice.operators import documents as docs
from fundlattice.operators import joins, scoring, texts
from fundlattice.plans import backtest_sql as bsql
from fundlattice.plans import decision_queries as dq
from fundlattice.plans import more_queries as mq
from fundlattice.plans import texts_sql as tsql
from fundlattice.plans.calendar_sql import CALENDAR_CTES, RISK_CTES, with_risk
from fundlattice.plans.walkforward_sql import with_samples
from fundlattice.sources import years
from fundlattice.sources.panel import HOLDINGS_SQL, holdings, nav_panel
from fundlattice.sources.store import shared_path

#: Half of the series have no name of their own.
_INPUTS = {"fund_name": "CASE WHEN i % 3 <> 0 THEN code END", **{f"warning_{h}": texts.PREDICTION_WARNING.format(edge=f"edge_value_{h}", confidence=f"conf_{h}") for h in ("7d", "30d")}}


def _joined(df: DataFrame, keys: list[str], lists: list[str], plain: list[str] = (), sep: str = "；") -> DataFrame:
    return df.select(*keys, *[F.array_join(c, sep).alias(c) for c in lists], *plain)


def score_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = dq.judged(s, d).withColumn("horizon", F.explode(F.array(*map(F.lit, scoring.HORIZONS))))
    return _joined(texts.score_texts(rows), ["code", "i", "horizon"], ["reasons", "up_triggers", "down_triggers"])


def forecast_reasons(s: SparkSession, d: str) -> DataFrame:
    return _joined(texts.forecast_texts(dec.forecast(dq.judged(s, d))), ["code", "i", "horizon"], ["reasons", "up_triggers", "down_triggers"])


def decision_support(s: SparkSession, d: str) -> DataFrame:
    told = texts.forecast_texts(dec.forecast(dq.judged(s, d), [7, 30]))
    return _joined(texts.decision_support(told, ["code", "i"]), ["code", "i"], ["buy_watch", "reduce_watch", "invalidation_signals"], ["action_bias", "model_quality_note"])


def advised(s: SparkSession, d: str) -> DataFrame:
    return texts.advice_texts(dec.apply_stages(dq.judged(s, d), [*dq.STUBS, _INPUTS, *dec.ADVICE_STAGES]))


def advice_texts(s: SparkSession, d: str) -> DataFrame:
    out = advised(s, d).withColumnsRenamed({"advice_reasons": "reasons", "advice_warnings": "risk_warnings"})
    return _joined(out, ["code", "i"], ["reasons", "risk_warnings", "buy_conditions", "sell_conditions", "invalidation_signals"], ["advice_label", F.coalesce("position_hint", F.lit("")).alias("position_hint"), "advice_summary"], "")


def final_texts(s: SparkSession, d: str) -> DataFrame:
    return _joined(texts.final_texts(dec.apply_stages(advised(s, d), dec.FINAL_STAGES)), ["code", "i"], ["why", "watch", "warning"], ["direction_label", "action_label", "final_summary"], "")


CORRECTED = ["code", "horizon", "up", "sideways", "down", "direction", "rise_fall", "confidence", "calibration_applied"]


def calibrated_forecast(s: SparkSession, d: str, sm: DataFrame) -> DataFrame:
    """The forecasts of each code's newest row, as its own backtest corrects them."""
    base = dq.judge(calendar.newest_metrics(nav_panel(s, d)), s.sql(dq.CONTEXT))
    return dec.calibrated_forecast(dec.forecast(base), bt.score_buckets(sm), bt.baseline_edge(sm), bt.quality(sm)).select(*CORRECTED)


CALIBRATED_FORECAST_SQL = with_samples(
    """SELECT code, horizon, up, sideways, down, CASE WHEN gate = 'insufficient' OR conflict AND horizon >= 7 THEN '不确定' WHEN up - down >= 20 THEN '偏上行' WHEN down - up >= 20 THEN '偏下行' WHEN abs(up - down) < 15 THEN '震荡' ELSE '不确定' END AS direction,
      CASE WHEN gate = 'insufficient' THEN '不确定' WHEN up - down >= 12 THEN '偏涨' WHEN down - up >= 12 THEN '偏跌' WHEN sideways >= 38 THEN '震荡' ELSE '不确定' END AS rise_fall,
      CASE WHEN hit < 45 THEN '低' WHEN confidence = '高' AND (hit < 50 OR (hit IS NOT NULL OR bq IS NOT NULL) AND (coalesce(bq, 'low') = 'low' OR NOT coalesce(bc, FALSE))) THEN '中' ELSE confidence END AS confidence, applied AS calibration_applied
    FROM (SELECT *, 100 - up - sideways AS down FROM (SELECT *, CASE WHEN applied THEN round_even(u / (u + w + s) * 100, 0) ELSE u END AS up, CASE WHEN applied THEN round_even(s / (u + w + s) * 100, 0) ELSE s END AS sideways
      FROM (SELECT *, CASE WHEN applied THEN greatest(8, 100 - u - w) ELSE side2 END::DOUBLE AS s
        FROM (SELECT *, CASE WHEN NOT applied THEN up1 WHEN raw > 0 THEN least(85, greatest(5, round_even(acc, 0))) WHEN raw < 0 THEN least(85, greatest(5, round_even(100 - acc - side2, 0))) ELSE least(85, greatest(5, up1)) END::DOUBLE AS u,
                CASE WHEN NOT applied THEN down1 WHEN raw < 0 THEN least(85, greatest(5, round_even(acc, 0))) WHEN raw > 0 THEN least(85, greatest(5, round_even(100 - acc - side2, 0))) ELSE least(85, greatest(5, down1)) END::DOUBLE AS w
          FROM (SELECT fn.*, acc, hit, bq, bc, coalesce(acc > 0 AND gate <> 'insufficient', FALSE) AS applied
            FROM (SELECT *, """ + dq._bucket_sql("raw") + """ AS k FROM fg WHERE i = (SELECT max(i) FROM rk WHERE rk.code = fg.code)) fn
            LEFT JOIN (SELECT code, horizon, """ + dq._bucket_sql("raw_score") + """ AS k, avg((prediction = actual)::DOUBLE) * 100 AS acc FROM smp GROUP BY 1, 2, 3 HAVING count(*) >= 5) c ON fn.code = c.code AND fn.horizon = c.horizon AND fn.k = c.k
            LEFT JOIN (SELECT code, horizon, avg((prediction = actual)::DOUBLE) * 100 AS hit FROM smp GROUP BY 1, 2) h ON fn.code = h.code AND fn.horizon = h.horizon
            LEFT JOIN (SELECT code, quality AS bq, calibrated AS bc FROM (""" + bsql.QUALITY + """)) q ON fn.code = q.code)))))""",
    f"ctx AS ({dq.CONTEXT})",
    *CALENDAR_CTES, *RISK_CTES, dq.GATED_CTE,
).replace("WITH ", "WITH RECURSIVE ", 1)
#: The year that holdings are asked of.
NEWEST_YEAR = 1998


def holdings_years(s: SparkSession, d: str) -> DataFrame:
    """Holdings written by year, and of four years the newest quarter's heaviest stocks of each fund, with the number of quarters that those years have."""
    path = shared_path(s, f"holdings-{uuid.uuid4().hex}")
    years.write_years(holdings(s, d), path)
    found = years.holdings_of_years(s, path, NEWEST_YEAR)
    return joins.latest_holdings(found).join(found.groupBy("fund").agg(F.count_distinct("quarter").alias("quarters")), "fund")


HOLDINGS_YEARS_SQL = f"""WITH {HOLDINGS_SQL.strip()}, of AS (SELECT fund::VARCHAR AS fund, stock, quarter, weight_pct, (quarter[1:4] || quarter[6:6])::INT AS q FROM holdings WHERE quarter[1:4]::INT BETWEEN {NEWEST_YEAR - 3} AND {NEWEST_YEAR})
SELECT of.fund, stock, q, weight_pct, row_number() OVER (PARTITION BY of.fund ORDER BY weight_pct DESC, stock)::INT AS rank, quarters FROM of JOIN (SELECT fund, max(q) AS mq, count(DISTINCT quarter) AS quarters FROM of GROUP BY 1) m ON of.fund = m.fund AND q = mq
QUALIFY row_number() OVER (PARTITION BY of.fund ORDER BY weight_pct DESC, stock) <= 8"""


def whole_documents(s: SparkSession, d: str) -> DataFrame:
    """The documents of all customers' series: forecast texts, support, advice and final decision of each, or its failure."""
    out = docs.analyse(mq.customer_panel(s, d), mq.customer_context(s, d))
    lists = {
        "reasons_7d": "forecast.7d.reasons", "triggers_30d": "forecast.30d.up_triggers", "buy_watch": "decision_support.buy_watch", "reduce_watch": "decision_support.reduce_watch",
        "advice_reasons": "advice.reasons", "why": "final.why", "warning": "final.warning",
    }
    plain = {"action_bias": "decision_support.action_bias", "advice": "advice.action", "headline": "final.headline"}
    shown = {n: F.array_join(f"document.{c}", "；") for n, c in lists.items()} | {n: F.col(f"document.{c}") for n, c in plain.items()}
    return out.select("code", "success", *[F.coalesce(x, F.lit("")).alias(n) for n, x in shown.items()])


_OF_CUSTOMERS = "SELECT lpad(c_custkey::VARCHAR, 6, '0') AS code, k.* EXCLUDE (code, quality, calibrated), 'low' AS quality, FALSE AS calibrated FROM customer JOIN (" + dq.CONTEXT + ") k ON k.code = ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1]"
_WEAK, _DOUBT = "'下行|偏跌|下跌|偏弱'", "回测未证明模型稳定优于基线，方向判断仅低置信参考。"
WHOLE_DOCUMENTS_SQL = with_risk(
    f"""SELECT n.code, n.c >= 5 AS success, coalesce(array_to_string(a.reasons, '；'), '') AS reasons_7d, coalesce(array_to_string(b.ups, '；'), '') AS triggers_30d,
      CASE WHEN r.code IS NULL THEN '' WHEN r.risk_score > 70 THEN '降低仓位风险' ELSE '观望（回测未验证规则有效性）' END AS action_bias, coalesce(array_to_string({tsql._once('list_concat(a.ups[:2], b.ups[:2])')}[:3], '；'), '') AS buy_watch,
      coalesce(array_to_string({tsql._once('list_concat(a.downs[:2], b.downs[:2])')}[:3], '；'), '') AS reduce_watch,
      CASE WHEN r.code IS NULL THEN '' WHEN r.risk_score >= 75 THEN CASE WHEN held THEN 'reduce' ELSE 'avoid' END WHEN weak AND r.risk_score > 55 THEN CASE WHEN held THEN 'hold' ELSE 'observe' END WHEN r.risk_score >= 60 THEN CASE WHEN held THEN 'hold' ELSE 'small_trial' END ELSE 'observe' END AS advice,
      CASE WHEN r.code IS NULL THEN '' WHEN r.risk_score >= 75 THEN CASE WHEN held THEN '综合风险评分较高（≥75），当前市场环境不利，可考虑降低仓位风险。' ELSE '综合风险评分较高（≥75），当前不适合新开仓或大额买入。' END || '；{_DOUBT}'
        WHEN weak AND r.risk_score > 55 THEN CASE WHEN held THEN '短期走势偏弱且风险评分偏高（>55），当前不适合追加仓位。' ELSE '短期走势偏弱且风险评分偏高（>55），适合暂时观望，等待方向明朗。' END || '；{_DOUBT}'
        WHEN r.risk_score >= 60 THEN CASE WHEN held THEN '风险评分偏高（≥60），适合谨慎持有，暂不追加仓位。' ELSE '风险评分偏高（≥60），若确有意向可小额试探，不宜大额买入。' END || '；{_DOUBT}' ELSE '{_DOUBT}；当前信号不够明确，适合观望等待更清晰的方向选择。' END AS advice_reasons,
      CASE WHEN r.code IS NULL THEN '' WHEN r.risk_score >= 70 AND NOT held THEN '风险较高，暂不适合参与' WHEN r.risk_score >= 70 THEN '风险偏高，可考虑降低仓位' ELSE '当前偏观察，不适合追买' END AS headline,
      CASE WHEN r.code IS NULL THEN '' ELSE '历史验证未显示稳定预测优势，当前方向难以判断。' || CASE WHEN NOT held AND r.risk_score < 70 THEN '；预测优势不足，建议等待更明确信号。' ELSE '' END END AS why,
      CASE WHEN r.code IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN r.risk_score >= 70 THEN CASE WHEN held THEN '当前持仓且风险评分较高（≥70），不建议追加仓位。' ELSE '风险评分较高（≥70），暂不适合新开仓。' END END, CASE WHEN r.risk_score >= 75 THEN '综合风险评分 ' || r.risk_score || '，处于高位，需警惕回撤风险。' END, '样本不足，不应把该概率当作可靠预测。',
          CASE WHEN r.risk_score >= 75 THEN CASE WHEN held THEN '风险评分处于高位，继续持有可能面临较大回撤。' ELSE '高风险环境下追高买入不确定性较大，适合等待风险释放后再评估。' END WHEN weak AND r.risk_score > 55 THEN CASE WHEN held THEN '走势偏弱叠加风险偏高，若继续下行需关注止损。' ELSE '走势偏弱环境下买入容易被套，耐心等待企稳信号。' END
            WHEN r.risk_score >= 60 THEN CASE WHEN held THEN '风险处于偏高水平，需密切关注市场变化和个人止损线。' ELSE '当前风险水平下大额买入需承担较大不确定性。' END END, '模型概率估计尚不稳定，情景判断可能偏差较大。'], lambda x: x IS NOT NULL)[:4], '；') END AS warning
    FROM (SELECT code, count(*) AS c FROM nav GROUP BY code) n
    LEFT JOIN (SELECT rk.*, coalesce(has_position, FALSE) AS held, z.weak FROM rk JOIN (SELECT code, i, bool_or(regexp_matches(direction2 || ' ' || rise_fall, {_WEAK})) FILTER (horizon IN (7, 30)) AS weak FROM fg GROUP BY ALL) z ON rk.code = z.code AND rk.i = z.i
      QUALIFY rk.i = max(rk.i) OVER (PARTITION BY rk.code)) r ON n.code = r.code
    LEFT JOIN ft a ON r.code = a.code AND r.i = a.i AND a.horizon = 7 LEFT JOIN ft b ON r.code = b.code AND r.i = b.i AND b.horizon = 30""",
    _OF_CUSTOMERS,
    *tsql._FORECASTS,
    nav=mq._CUSTOMER_NAV,
)
