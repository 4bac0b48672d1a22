"""Queries on sources, gates and smaller rules, each with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlattice.functions.numeric import round_half_up
from fundlattice.operators import backtest as bt
from fundlattice.operators import calendar
from fundlattice.operators import decisions as dec
from fundlattice.operators import documents as docs
from fundlattice.operators import indicators as ind
from fundlattice.operators import joins, keywords, portfolio
from fundlattice.plans import backtest_sql as bsql
from fundlattice.plans import decision_queries as dq
from fundlattice.plans.calendar_sql import CALENDAR_CTES, RISK_CTES
from fundlattice.plans.indicator_sql import OVER, RETURNS_CALENDAR, rows, with_nav
from fundlattice.plans.walkforward_sql import with_samples
from fundlattice.sources import profiles, readers
from fundlattice.sources.panel import PRICE_SQL, index_panel, nav_panel, price_panel, table
from fundlattice.sources.store import KeyedStore, shared_path
from fundlattice.streaming import daily, estimates


def forecast_gates(s: SparkSession, d: str) -> DataFrame:
    return dec.forecast_gates(nav_panel(s, d)).select("code", "i", "horizon", "gate")


FORECAST_GATES_SQL = with_nav(
    """SELECT code, i, h AS horizon, CASE WHEN h = 1 AND i < 7 OR h = 3 AND i < 11 OR h = 7 AND i < 14 THEN 'insufficient' WHEN h = 30 AND i < 59 THEN 'low_confidence' ELSE 'open' END AS gate
    FROM nav CROSS JOIN (VALUES (1), (3), (7), (30)) t(h)"""
)
STREAK_C_SQL = with_nav(
    """SELECT code, d, i, CASE WHEN i = 0 THEN 0 WHEN s = 0 THEN 1 ELSE row_number() OVER (PARTITION BY code, isl ORDER BY i) END AS days, CASE WHEN s > 0 THEN 'up' WHEN s < 0 THEN 'down' ELSE 'flat' END AS direction
    FROM (SELECT *, count(*) FILTER (s IS DISTINCT FROM ps) OVER (PARTITION BY code ORDER BY i) AS isl FROM (SELECT *, lag(s) OVER (PARTITION BY code ORDER BY i) AS ps FROM (SELECT code, d, i, sign(r) AS s FROM nav)))"""
)
RANGE_60_SQL = with_nav(
    f"""SELECT code, d, i, CASE WHEN i >= 59 THEN (nav / lag(nav, 59) {OVER} - 1) * 100 ELSE 0 END AS ret_60, CASE WHEN hi > lo THEN (nav - lo) / (hi - lo) * 100 ELSE 50 END AS pos_60
    FROM (SELECT *, min(nav) {rows(60)} AS lo, max(nav) {rows(60)} AS hi FROM nav)"""
)
SUMMARY_SQL = with_nav(
    """SELECT code, n AS data_days, CASE WHEN n >= 5 THEN strftime(a, '%Y-%m-%d') END AS data_start, CASE WHEN n >= 5 THEN strftime(z, '%Y-%m-%d') END AS data_end, CASE WHEN n >= 5 THEN floor(last * 10000 + 0.5) / 10000 END AS latest_nav,
    CASE WHEN n < 5 THEN '净值数据不足（仅 ' || n || ' 条）' END AS error FROM (SELECT code, count(*) AS n, min(d) AS a, max(d) AS z, arg_max(nav, d) AS last FROM nav GROUP BY code)"""
)


def acc_nav(s: SparkSession, d: str) -> DataFrame:
    """Returns of accumulated values; here these are the values plus a thousandth for each row before."""
    p = nav_panel(s, d).withColumn("acc_nav", F.col("nav") + F.col("i") / 1000)
    return ind.returns_calendar(p, periods=(30, 90), col="acc_nav").drop("acc_nav")


ACC_NAV_SQL = with_nav(
    "SELECT code, d, i, " + ", ".join(f"CASE WHEN i >= 2 THEN s{n} END AS start_{n}, CASE WHEN i >= 2 THEN (x - x{n}) / x{n} * 100 END AS ret_{n}" for n in (30, 90))
    + " FROM (SELECT a.*, b30.d AS s30, b30.x AS x30, b90.d AS s90, b90.x AS x90 FROM acc a ASOF LEFT JOIN acc b30 ON a.code = b30.code AND a.d - 30 >= b30.d ASOF LEFT JOIN acc b90 ON a.code = b90.code AND a.d - 90 >= b90.d)",
    "acc AS (SELECT code, d, i, nav + i / 1000e0 AS x FROM nav)",
)
MACRO_RISKS_SQL = f"""WITH {dq._MOVES}, x AS (SELECT event_type, d, avg(CASE WHEN idx = 0 THEN change_pct END) AS us, avg(CASE WHEN idx = 1 THEN change_pct / 20 + 7.2 END) AS fx, avg(CASE WHEN idx = 2 THEN change_pct / 4 + 2 END) AS r FROM m GROUP BY 1, 2)
SELECT event_type, d, concat_ws('；', CASE WHEN us < -1 THEN '纳斯达克指数下跌，科技股风险偏好下降' END, CASE WHEN fx > 7.2 THEN '人民币汇率承压，可能影响跨境资金流动和外资持仓偏好' END,
  CASE WHEN r > 2.5 THEN 'SHIBOR隔夜利率偏高，短期资金面偏紧，可能对股市估值形成压力' WHEN r < 1.2 THEN '银行间流动性极度宽松，需关注资金空转和政策调控风险' END,
  CASE WHEN us IS NOT NULL OR fx IS NOT NULL THEN '国际地缘政治风险可能影响全球资本市场情绪' END, CASE WHEN us IS NOT NULL OR fx IS NOT NULL THEN '美联储货币政策不确定性可能影响全球流动性和QDII基金表现' END) AS risks FROM x"""


def macro_risks(s: SparkSession, d: str) -> DataFrame:
    out = portfolio.macro_risks(portfolio.macro_summary(dq.macro_rows(s, d), ["event_type", "d"]))
    return out.select("event_type", "d", F.array_join("risks", "；").alias("risks"))


def missing_keys(s: SparkSession, d: str) -> DataFrame:
    held = dq.positions(s, d).where("risk_score < 60").select("code")
    return portfolio.missing_keys(held, dq.positions(s, d).where("risk_score > 50").select("code"))


MISSING_SQL = f"WITH {dq._P} SELECT DISTINCT code FROM p WHERE risk_score > 50 AND NOT coalesce(risk_score < 60, FALSE)"


def quotes(s: SparkSession, d: str) -> DataFrame:
    """Quote lines made of events, read again; every seventh has too few fields."""
    price, before = F.col("value").cast("string"), (F.col("event_id") % 50).cast("string")
    line = F.concat(F.lit('v_x="1~n'), F.col("event_id"), F.lit("~"), F.col("event_id"), F.lit("~"), price, F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("~"), before, F.lit("~a~b~c~d~e"))), F.lit('";'))
    return readers.parse_quotes(table(s, d, "events").select(line.alias("value")))


QUOTES_SQL = """SELECT CAST(event_id AS VARCHAR) AS code, 'n' || event_id AS name, p AS price, b AS prev_close, CASE WHEN b > 0 THEN (p - b) / b * 100 END AS change_pct
FROM (SELECT event_id, value AS p, (event_id % 50)::DOUBLE AS b FROM events WHERE event_id % 7 <> 0)"""


def keyword_search(s: SparkSession, d: str) -> DataFrame:
    return readers.search(table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name")), "a")


SEARCH_SQL = "SELECT p_partkey AS code, p_name AS name FROM part WHERE contains(p_name, 'a') ORDER BY 1 LIMIT 20"


def symbols(s: SparkSession, d: str) -> DataFrame:
    code = F.col("o_orderkey").cast("string")
    return table(s, d, "orders").select("o_orderkey", readers.exchange(code).alias("exchange"), readers.exchange_symbol(code).alias("symbol"))


SYMBOLS_SQL = """SELECT o_orderkey, CASE WHEN left(c, 1) IN ('5', '6', '9') THEN 'sh' ELSE 'sz' END AS exchange,
CASE WHEN left(x, 1) IN ('5', '6', '9') THEN 'sh' WHEN left(x, 1) IN ('4', '8') THEN 'bj' ELSE 'sz' END || x AS symbol FROM (SELECT o_orderkey, c, left(lpad(c, 6, '0'), 6) AS x FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS c FROM orders))"""


def _items(s: SparkSession, d: str) -> DataFrame:
    """Items of parts under the names that a provider might give them: code, item, value, ord."""
    p = table(s, d, "part")
    pairs = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(item).alias("item"), value.alias("value")) for n, (item, value) in enumerate((("基金全称", F.col("p_name")), ("基金管理公司", F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand"))), ("托管公司", F.col("p_type")), ("类型说明", F.col("p_type"))))])
    return p.select(F.col("p_partkey").alias("code"), F.explode(pairs).alias("x")).select("code", "x.*")


def profile_pivot(s: SparkSession, d: str) -> DataFrame:
    aliases = s.createDataFrame([("name", "全称"), ("manager", "管理公司"), ("type", "类型"), ("type", "基金类型说明书")], "field string, alias string")
    return readers.profile_quality(readers.pivot_profile(_items(s, d), aliases, ["name", "manager", "type"]), ["name", "manager", "type"])


PIVOT_SQL = """SELECT p_partkey AS code, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS manager, p_type AS type,
CASE WHEN (CASE WHEN p_partkey % 4 <> 0 THEN 3 ELSE 2 END) / 3e0 >= 0.7 THEN 'good' ELSE 'partial' END AS data_quality FROM part"""
COMPANY_SQL = "SELECT p_partkey AS code, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END AS company FROM part"


def prices_normalised(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("stock"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("交易日期"), F.when(F.col("l_linenumber") == 3, "停牌").when(F.col("l_linenumber") == 4, "-1").otherwise(F.col("l_quantity").cast("string")).alias("收盘价"))
    return profiles.normalise_prices(raw, F.col("stock"))


PRICES_SQL = "SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS d, max(l_quantity)::DOUBLE AS close FROM lineitem WHERE l_linenumber NOT IN (3, 4) AND l_quantity > 0 GROUP BY 1, 2"


def positional(s: SparkSession, d: str) -> DataFrame:
    """The n-th order of a priority beside the n-th of the priority's urgent ones (by key)."""
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("d"), F.col("o_custkey").alias("left_value"), "o_orderstatus")
    right = o.where("o_orderstatus = 'F'").select("code", "d", F.col("left_value").alias("right_value"))
    return joins.positional_join(o.drop("o_orderstatus"), right)


POSITIONAL_SQL = """WITH l AS (SELECT o_orderpriority AS code, o_orderkey AS d, o_custkey AS left_value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_orderpriority AS code, o_custkey AS right_value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT l.code, l.d, left_value, right_value FROM l LEFT JOIN r ON l.code = r.code AND l.n = r.n"""


def nav_delay(s: SparkSession, d: str) -> DataFrame:
    navs = table(s, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.to_date(F.max("o_orderdate")).alias("data_end"))
    return daily.delay_days(navs, "1998-08-02")


DELAY_SQL = "SELECT code, data_end, date_diff('day', data_end, DATE '1998-08-02') AS days_behind, date_diff('day', data_end, DATE '1998-08-02') >= 2 AS delayed FROM (SELECT o_custkey AS code, CAST(max(o_orderdate) AS DATE) AS data_end FROM orders GROUP BY 1)"
NARRATIVE_SQL = dq._judged_sql(
    "SELECT code, d, printf('%s：风险分 %.1f（%s），趋势%s，近30日收益 %.2f%%，最大回撤 %.2f%%，波动率 %.2f%%。%s。仅供个人研究参考，不构成投资建议。', code, risk_score, risk_level, trend, ret_30d, dd_30, vol_30, headline) AS narrative FROM {rows}", [*dq.STUBS, *dec.FINAL_STAGES]
)
ONE_YEAR_SQL = with_nav("SELECT code, d, i FROM (SELECT *, max(d) OVER (PARTITION BY code) AS z FROM nav) WHERE d >= z - 365")
UNCERTAIN_SQL = with_samples(
    """SELECT code, CASE WHEN coalesce(a, b, c, e) IS NULL THEN '回测样本量尚可，但历史表现不代表未来' ELSE concat_ws('；', a, b, c, e) END AS uncertainties FROM (
      SELECT code, arg_min(horizon || 'd周期阈值较高（' || printf('%.2f', t) || '%），反映波动较大，方向预测误差可能放大', horizon) FILTER (t > 5) AS a, CASE WHEN min(n) < 30 THEN '部分周期回测样本较少，历史准确率参考价值有限' END AS b,
        CASE WHEN count(*) FILTER (hit < 50) >= 2 THEN '多个周期方向准确率低于随机猜测，需谨慎参考' END AS c, arg_min(horizon || 'd周期实际走势极端偏向震荡，方向预测区分度可能不足', horizon) FILTER (sideways > 80) AS e
      FROM (SELECT code, horizon, count(*) AS n, avg((prediction = actual)::DOUBLE) * 100 AS hit, avg((actual = 'sideways')::DOUBLE) * 100 AS sideways, avg(threshold) AS t FROM smp GROUP BY 1, 2) GROUP BY code)"""
)


def uncertainties(sm: DataFrame) -> DataFrame:
    return bt.uncertainties(sm).select("code", F.array_join("uncertainties", "；").alias("uncertainties"))


CONTEXT_SQL = f"""WITH {dq._MOVES} SELECT event_type, d, '## 市场环境' || chr(10) || '主要指数:' || chr(10) || lines || chr(10) || '市场情绪: ' ||
  CASE WHEN mean > 1.5 AND up >= n * 0.75 THEN '非常乐观' WHEN mean > 0.5 AND up >= n * 0.6 THEN '偏乐观' WHEN mean < -1.5 AND up <= n * 0.25 THEN '非常悲观' WHEN mean < -0.5 AND up <= n * 0.4 THEN '偏悲观' ELSE '中性' END || chr(10) || '资金流向: ' ||
  CASE WHEN mean > 0.8 THEN '大幅流入' WHEN mean > 0.3 THEN '净流入' WHEN mean < -0.8 THEN '大幅流出' WHEN mean < -0.3 THEN '净流出' ELSE '平衡' END AS context
  FROM (SELECT event_type, d, avg(change_pct) AS mean, count(*) FILTER (change_pct > 0) AS up, count(*) AS n, string_agg('  - ' || idx || printf(': %+.2f%%', floor(change_pct * 100 + 0.5) / 100), chr(10) ORDER BY idx) AS lines FROM m GROUP BY 1, 2)"""
_ROUTED = {"trained": "code = '3-MEDIUM'"}


def routed(sm: DataFrame) -> DataFrame:
    out = dec.apply_stages(sm, [dq._LLM | _ROUTED, *dec.ROUTE_STAGES])
    return out.select("code", "horizon", "i", "route", "route_up", "route_direction", "route_confidence")


ROUTED_SQL = with_samples(
    """SELECT code, horizon, i, CASE WHEN code = '3-MEDIUM' THEN 'trained' WHEN llm IS NULL THEN 'rules' ELSE 'ensemble' END AS route,
      CASE WHEN code = '3-MEDIUM' THEN p WHEN llm IS NULL THEN CASE s WHEN 'low' THEN 60 WHEN 'high' THEN 40 ELSE 50 END ELSE b END AS route_up,
      CASE WHEN code = '3-MEDIUM' THEN CASE WHEN p >= 58 THEN 'up' WHEN p <= 45 THEN 'down_or_flat' ELSE 'uncertain' END WHEN llm IS NULL THEN CASE s WHEN 'low' THEN 'up' WHEN 'high' THEN 'down_or_flat' ELSE 'uncertain' END
        WHEN b >= 58 THEN 'up' WHEN b <= 42 THEN 'down_or_flat' ELSE 'uncertain' END AS route_direction,
      CASE WHEN code = '3-MEDIUM' THEN '低' WHEN llm IS NULL THEN CASE WHEN s = 'mid' THEN '低' ELSE '中' END WHEN pts >= 5 THEN '高' WHEN pts >= 3 THEN '中' ELSE '低' END AS route_confidence
    FROM (SELECT *, CASE WHEN i % 2 = 0 THEN 3 WHEN i % 5 = 0 THEN 2 ELSE 1 END + CASE WHEN abs(b - 50) > 15 THEN 2 WHEN abs(b - 50) > 10 THEN 1 ELSE 0 END + (rsi_14 < 30 OR rsi_14 > 70 OR bb_pos < 10 OR bb_pos > 90)::INT AS pts FROM
      (SELECT *, 0.6 * llm + 0.2 * p + 0.2 * least(90, greatest(10, 50 + CASE WHEN x < 25 THEN 25 WHEN x < 30 THEN 18 WHEN x < 35 THEN 10 WHEN x > 75 THEN -25 WHEN x > 70 THEN -18 WHEN x > 65 THEN -10 ELSE 0 END
          + CASE WHEN bb_pos < 5 THEN 15 WHEN bb_pos < 10 THEN 10 WHEN bb_pos > 95 THEN -15 WHEN bb_pos > 90 THEN -10 ELSE 0 END)) AS b,
        CASE WHEN x < 30 OR bb_pos < 15 THEN 'low' WHEN x > 70 OR bb_pos > 85 THEN 'high' ELSE 'mid' END AS s FROM
      (SELECT *, probability * 100 AS p, CASE WHEN horizon <= 3 THEN rsi_6 ELSE rsi_14 END AS x, CASE WHEN i % 3 <> 0 THEN 50 + ret_1 * 8 END AS llm FROM smp)))"""
)


def price_sources(s: SparkSession, d: str) -> DataFrame:
    """Prices of suppliers from four sources in order: two providers, each adjusted first; the first that has any counts."""
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 2 == 1).alias("adjusted"), (F.col("l_returnflag") == "R").alias("first"))
    pick = lambda first, adjusted: lines.where((F.col("first") == first) & (F.col("adjusted") == adjusted)).select("code", "k")
    out = readers.with_fallback([pick(True, True), pick(True, False), pick(False, True), pick(False, False)], enough=1, least=1)
    return out.groupBy("code").agg(F.count("*").alias("n"), F.min("k").alias("first_k"))


PRICE_SOURCES_SQL = """WITH x AS (SELECT l_suppkey AS code, l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 2 END + CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 1 END AS src FROM lineitem)
SELECT code, count(*) AS n, min(k) AS first_k FROM x WHERE src = (SELECT min(src) FROM x y WHERE y.code = x.code) GROUP BY code"""


def holding_results(s: SparkSession, d: str) -> DataFrame:
    p = dq.positions(s, d)
    return portfolio.with_results(p.select("portfolio", "code"), p.where("risk_score > 50").select("code", "risk_score", "action"))


HOLDING_RESULTS_SQL = f"WITH {dq._P} SELECT p.portfolio, p.code, r.risk_score, r.action FROM p LEFT JOIN (SELECT * FROM p WHERE risk_score > 50) r ON p.code = r.code"


def short_profiles(s: SparkSession, d: str) -> DataFrame:
    return profiles.short_profile(profile_pivot(s, d), ["type", "manager", "size"])


SHORT_PROFILES_SQL = "SELECT p_partkey AS code, p_type AS type, CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE 'unavailable' END AS manager, 'unavailable' AS size FROM part"
ALIASES_SQL = f"SELECT code, i, ret_7 AS return_7d, ret_30 AS return_30d, ret_60 AS return_60d, ret_90 AS return_90d FROM ({RETURNS_CALENDAR})"
BRANDS = [f"Brand{n}" for n in range(1, 26)]


def _named(brand):
    """Brand#11 as a column's name."""
    return F.regexp_replace(brand, "#", "")


def outer_prices(s: SparkSession, d: str) -> DataFrame:
    prices = price_panel(s, d)
    return joins.outer_prices(prices.select(_named(F.col("stock")).alias("stock"), "d", round_half_up(F.col("close"), 4).alias("close")), BRANDS)


_FILLED = ", ".join(f"last_value(max(floor(close * 10000 + 0.5) / 10000) FILTER (replace(stock, '#', '') = '{b}') IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {b}" for b in BRANDS)
OUTER_PRICES_SQL = f"WITH {PRICE_SQL.strip()} SELECT d, {_FILLED} FROM prices GROUP BY d"
#: What only trained codes have; no code of the panel is one.
_UNTRAINED = {"status": "'ok'", "specific": "FALSE", "selective_valid": "FALSE", "validation_ok": "FALSE", "cv_ok": "FALSE", **{c: "CAST(NULL AS DOUBLE)" for c in ("hit_bound", "validation_hit", "validation_n", "avg_return", "profit_factor")}}
_DECIDED = ["risk_score", "advice", "advice_confidence", "buy_amount", "final_direction", "final_action", "final_confidence", "headline", "gate_action", "failed_gates", "gate_score"]
_JUDGING = [_UNTRAINED, *dec.ADVICE_STAGES, *dec.FINAL_STAGES, *dec.GATE_STAGES]


def present_decisions(s: SparkSession, d: str, sm: DataFrame, now: DataFrame) -> DataFrame:
    """What to do about each code now: risk of its present row, its predictions, forecasts and backtest, and the decision tables over them."""
    context = s.sql(dq.CONTEXT).drop("quality", "calibrated")
    base = dq.judge(calendar.newest_metrics(nav_panel(s, d)), context)
    said = F.concat_ws(" ", "direction2", "rise_fall")
    texts = dec.forecast(base, [7, 30]).groupBy("code").agg(*[F.max(F.when(F.col("horizon") == h, said)).alias(f"text_{h}d") for h in (7, 30)])
    predicted = docs.predictions(sm, now)
    quality = docs.prediction_quality(predicted).select("code", F.col("quality").alias("pred_quality"))
    tested = bt.quality(sm).select("code", "quality", "calibrated")
    joined = base
    for part in (texts, docs.by_horizon(predicted), quality, tested):
        joined = joined.join(part, "code", "left")
    joined = joined.withColumns({"quality": F.coalesce("quality", F.lit("low")), "calibrated": F.coalesce("calibrated", F.lit(False))})
    return dec.apply_stages(joined, _JUDGING).select("code", *_DECIDED)


def present_decisions_sql(predictions: str) -> str:
    text = ", ".join(f"(SELECT direction2 || ' ' || rise_fall FROM {dec.stages_sql('(SELECT * FROM jp j WHERE j.code = jp.code)', dec.forecast_stages(h, 'round_even'))}) AS text_{h}d" for h in (7, 30))
    wide = ", ".join(
        f"max({x}) FILTER (horizon = {h}) AS {name}_{h}d" for h in (7, 30)
        for name, x in (("dir", "direction"), ("conf", "confidence"), ("edge_value", "edge"), ("edge", "coalesce(edge > 0 OR passes AND selective_edge > 0, FALSE)"), ("hit", "hit"), ("passes", "passes"), ("selective_hit", "selective_hit"), ("selective_n", "signals"), ("selective_edge", "selective_edge"))
    )
    rows_of = f"(SELECT jp.*, {text}, w.* EXCLUDE (code), coalesce(t.quality, 'low') AS quality, coalesce(t.calibrated, FALSE) AS calibrated FROM jp LEFT JOIN w ON jp.code = w.code LEFT JOIN t ON jp.code = t.code)"
    return with_samples(
        f"SELECT code, {', '.join(_DECIDED)} FROM {dec.stages_sql(rows_of, _JUDGING)}",
        f"ctx AS (SELECT * EXCLUDE (quality, calibrated) FROM ({dq.CONTEXT}))",
        *CALENDAR_CTES, *RISK_CTES,
        "jp AS (SELECT * FROM rk QUALIFY i = max(i) OVER (PARTITION BY code))",
        f"pr AS ({predictions})",
        f"w AS (SELECT code, {wide}, CASE WHEN count(*) FILTER (usable) = 0 THEN 'low' WHEN count(*) FILTER (usable) >= 3 THEN 'high' ELSE 'medium' END AS pred_quality FROM pr GROUP BY code)",
        f"t AS (SELECT code, quality, calibrated FROM ({bsql.QUALITY}))",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def portfolio_store(s: SparkSession, d: str) -> DataFrame:
    """Positions in a keyed store: all are put in, those of more risk again at another value, and those of much risk deleted."""
    p = dq.positions(s, d).select("code", "portfolio", "nav", "risk_score")
    store = KeyedStore(s, shared_path(s, f"portfolio-{uuid.uuid4().hex}"), "code string, portfolio string, nav double, risk_score double")
    store.upsert(p)
    store.upsert(p.where("risk_score > 50").withColumn("nav", F.col("nav") + 1))
    store.delete(p.where("risk_score > 90").select("code"))
    return store.read()


STORE_SQL = f"WITH {dq._P} SELECT code, portfolio, CASE WHEN risk_score > 50 THEN nav + 1 ELSE nav END AS nav, risk_score FROM p WHERE NOT coalesce(risk_score > 90, FALSE)"


def current_values(s: SparkSession, d: str) -> DataFrame:
    """Events as readings, every third an official value and the others estimates: what each user's value is now."""
    kind = F.when(F.col("event_id") % 3 == 0, "official").otherwise("estimate")
    return estimates.current_values(table(s, d, "events").select(F.col("user_id").cast("string").alias("code"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.col("value").cast("double").alias("value"))).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


CURRENT_SQL = """WITH e AS (SELECT user_id, max({'at': ts::TIMESTAMP, 'v': value::DOUBLE}) FILTER (event_id % 3 <> 0) AS e, max({'at': ts::TIMESTAMP, 'v': value::DOUBLE}) FILTER (event_id % 3 = 0) AS o FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
f AS (SELECT *, e IS NOT NULL AND (o IS NULL OR e['at']::DATE > o['at']::DATE) AS fresh FROM e)
SELECT user_id::VARCHAR AS code, strftime(CASE WHEN fresh THEN e['at'] ELSE o['at'] END, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN fresh THEN 'estimate' ELSE 'official' END AS source, CASE WHEN fresh THEN e['v'] ELSE o['v'] END AS value FROM f"""


def keyword_match(s: SparkSession, d: str) -> DataFrame:
    """For each part the first of many keywords, by the smallest part it comes from, that its name, type and brand contain."""
    parts = table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    words = table(s, d, "part").select(F.explode(F.array(F.concat_ws(" ", F.element_at(F.split("p_type", " "), -1), "p_brand"), F.element_at(F.split("p_name", " "), -1), F.concat(F.left("p_type", F.lit(9)), F.lit("?")))).alias("keyword"), "p_partkey")
    return keywords.first_match(parts, words.groupBy("keyword").agg(F.min("p_partkey").alias("ord"))).select("p_partkey", "keyword")


KEYWORD_SQL = """WITH k AS (SELECT keyword, min(p_partkey) AS ord FROM (SELECT p_partkey, unnest([split_part(p_type, ' ', -1) || ' ' || p_brand, split_part(p_name, ' ', -1), left(p_type, 9) || '?']) AS keyword FROM part) GROUP BY 1),
n AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part)
SELECT p_partkey, (SELECT keyword FROM k WHERE contains(n.name, k.keyword) ORDER BY ord, keyword LIMIT 1) AS keyword FROM n"""


#: Kinds of funds that parts stand for.
_KINDS = ("QDII科技股票", "债券型-短债", "混合型", "指数型-白酒", "医药混合", "货币型", "金融ETF联接", "未知")


def part_kinds(s: SparkSession, d: str) -> DataFrame:
    """Every part as a fund of some kind: code, fund_type."""
    kinds = F.array(*map(F.lit, _KINDS))
    return table(s, d, "part").select(F.col("p_partkey").alias("code"), F.get(kinds, F.col("p_partkey") % 8).alias("fund_type"))


_PART_KINDS = f"(SELECT p_partkey AS code, {list(_KINDS)!r}[p_partkey % 8 + 1] AS fund_type FROM part)"
KEYWORD_TYPES_SQL = f"""SELECT code, regexp_matches(fund_type, 'QDII|科技|医药|医疗|新能源|半导体|芯片|军工|传媒') AS high_vol, contains(upper(fund_type), 'QDII') AS qdii, regexp_matches(fund_type, '债券|货币|同业存单|短债|纯债') AS defensive,
 regexp_matches(fund_type, '股票|指数|混合|ETF|LOF|增强|联接') AND NOT regexp_matches(fund_type, '债券|货币|同业存单|短债|纯债') AND NOT contains(upper(fund_type), 'QDII') AS china FROM {_PART_KINDS}"""
SECTOR_LOOKUP_SQL = f"""SELECT code, unnest(CASE WHEN regexp_matches(fund_type, '消费|白酒') THEN ['consumer'] WHEN regexp_matches(fund_type, '医药|医疗') THEN ['healthcare'] WHEN regexp_matches(fund_type, '科技|TMT') THEN ['technology']
 WHEN regexp_matches(fund_type, '金融|银行') THEN ['finance'] ELSE ['consumer', 'technology'] END) AS sector, 0::DOUBLE AS change_pct, 'unavailable' AS status FROM {_PART_KINDS}"""


def customer_panel(s: SparkSession, d: str) -> DataFrame:
    """A series for each customer, of the mean value of a day's orders: thousands of codes with one row to some dozens."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    daily_of = table(s, d, "orders").groupBy(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"), F.to_date("o_orderdate").alias("d")).agg((F.sum(cents).cast("double") / (F.count("*").cast("double") * 25_000_000.0)).alias("nav"))
    return index_panel(daily_of)


_CUSTOMER_NAV = """nav0 AS (SELECT lpad(o_custkey::VARCHAR, 6, '0') AS code, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * 25000000.0) AS nav FROM orders GROUP BY 1, 2),
nav AS (SELECT code, d, nav, row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS i, nav / lag(nav) OVER (PARTITION BY code ORDER BY d) - 1 AS r FROM nav0)"""
_KIND_OF = {k: v for k, v in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))}


def customer_context(s: SparkSession, d: str) -> DataFrame:
    """A kind, market and position for each customer's series."""
    kinds = F.array(*map(F.lit, _KIND_OF.values()))
    of = table(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("c"), F.get(kinds, F.col("c_custkey") % 5).alias("code"))
    return of.join(F.broadcast(s.sql(dq.CONTEXT)), "code").drop("code").withColumnRenamed("c", "code")


def batch_analysis(s: SparkSession, d: str) -> DataFrame:
    """All customers' series in one batch: what each document says, and why the others have none."""
    out = docs.analyse(customer_panel(s, d), customer_context(s, d))
    said = lambda h: F.col("document.forecast")[f"{h}d"]
    return out.select("code", "data_days", "success", F.coalesce("error", F.lit("")).alias("error"), "document.latest_nav", "document.metrics.ret_30d", "document.risk.risk_score", F.coalesce("document.risk.risk_level", F.lit("")).alias("risk_level"), *[F.coalesce(said(h)["direction"], F.lit("")).alias(f"direction_{h}d") for h in (1, 3, 7, 30)], F.coalesce(said(7)["gate"], F.lit("")).alias("gate_7d"))


BATCH_SQL = dq.with_risk(
    """SELECT n.code, n.data_days, n.data_days >= 5 AS success, CASE WHEN n.data_days < 5 THEN '净值数据不足（仅 ' || n.data_days || ' 条）' ELSE '' END AS error, r.nav AS latest_nav, r.ret_30d, r.risk_score, coalesce(r.risk_level, '') AS risk_level,
      coalesce(f.d1, '') AS direction_1d, coalesce(f.d3, '') AS direction_3d, coalesce(f.d7, '') AS direction_7d, coalesce(f.d30, '') AS direction_30d, coalesce(f.g7, '') AS gate_7d
    FROM (SELECT code, count(*) AS data_days FROM nav GROUP BY code) n LEFT JOIN (SELECT * FROM rk QUALIFY i = max(i) OVER (PARTITION BY code)) r ON n.code = r.code
    LEFT JOIN (SELECT code, i, max(direction2) FILTER (horizon = 1) AS d1, max(direction2) FILTER (horizon = 3) AS d3, max(direction2) FILTER (horizon = 7) AS d7, max(direction2) FILTER (horizon = 30) AS d30, max(gate) FILTER (horizon = 7) AS g7 FROM fg GROUP BY ALL) f ON r.code = f.code AND r.i = f.i""",
    f"SELECT lpad(c_custkey::VARCHAR, 6, '0') AS code, k.* EXCLUDE (code) FROM customer JOIN ({dq.CONTEXT}) k ON k.code = ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1]",
    dq.GATED_CTE,
    nav=_CUSTOMER_NAV,
)
