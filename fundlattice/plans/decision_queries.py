"""Queries on joins, rules, risk, forecasts, decisions, portfolios and sources, with the same in SQL.

The decision tables take any table with their columns. Here the inputs that the star-schema tables lack (a fund's
kind, the market, positions, other models' outputs) come from a few fixed rows and plain expressions, which are
part of both forms of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlattice.operators import backtest as bt
from fundlattice.operators import calendar
from fundlattice.operators import decisions as dec
from fundlattice.operators import joins, portfolio, scoring
from fundlattice.operators import prediction as pred
from fundlattice.plans.calendar_sql import with_risk
from fundlattice.plans.indicator_sql import with_nav
from fundlattice.plans.walkforward_sql import with_samples
from fundlattice.sources import profiles, readers
from fundlattice.sources.panel import HOLDINGS_SQL, PRICE_SQL, holdings, nav_panel, price_panel, table
from fundlattice.streaming import daily

CONTEXT = """SELECT * FROM (VALUES
 ('1-URGENT', 'QDII科技股票', TRUE, 'risk-on', 'bullish', 'tight', '有一定贬值压力', 'data_available', 0.95e0, 15e0, '平衡', 10000e0, 0e0, 10000e0, DATE '2001-07-30', 1.2e0, 'medium', TRUE),
 ('2-HIGH', '债券型-短债', TRUE, 'risk-off', 'bearish', 'loose', 'stable', '扰动', 1.1e0, 10e0, '保守', 600000e0, 0e0, 0e0, DATE '1999-01-01', -2.5e0, 'low', FALSE),
 ('3-MEDIUM', '混合型', TRUE, 'neutral', 'mixed', 'unknown', '贬值压力较大', 'none', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), '激进', CAST(NULL AS DOUBLE), 0e0, 9000e0, CAST(NULL AS DATE), CAST(NULL AS DOUBLE), 'high', TRUE),
 ('4-NOT SPECIFIED', '指数型-股票', FALSE, 'neutral', 'mixed', 'unknown', 'stable', 'none', 0.9e0, 20e0, '激进', 0e0, 1000e0, CAST(NULL AS DOUBLE), DATE '2002-01-01', 0.4e0, 'medium', TRUE),
 ('5-LOW', '医药混合', TRUE, 'risk-off', 'mixed', 'tight', 'stable', 'none', CAST(NULL AS DOUBLE), 12e0, '平衡', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 5000e0, CAST(NULL AS DATE), 0e0, 'medium', FALSE)
) AS t(code, fund_type, macro_ok, risk_appetite, overseas, liquidity, forex_pressure, commodity_disturbance, cost_nav, max_loss_percent, preference, holding_amount, holding_units, planned_buy_amount, estimate_day, estimate_change, quality, calibrated)"""
#: What other models would say.
STUBS = [
    {
        "text_7d": "CASE WHEN ret_7d > 1 THEN '偏上行 偏涨' WHEN ret_7d < -1 THEN '偏下行 偏跌' ELSE '震荡' END", "text_30d": "CASE WHEN ret_30d > 1 THEN '偏上行' WHEN ret_30d < -2 THEN '偏跌' ELSE '不确定' END",
        "edge_7d": "accel > 0", "edge_30d": "ret_30d > 0", "conf_7d": "CASE WHEN abs(accel) > 2 THEN '高' WHEN abs(accel) > 1 THEN '中' ELSE '低' END", "conf_30d": "CASE WHEN abs(skew) > 0.6e0 THEN '高' WHEN abs(skew) > 0.3e0 THEN '中' ELSE '低' END",
        "pred_quality": "CASE WHEN pct > 70 THEN 'low' ELSE 'medium' END", "dir_7d": "CASE WHEN ret_7d > 0.5e0 THEN 'up' WHEN ret_7d < -0.5e0 THEN 'down_or_flat' ELSE 'uncertain' END", "dir_30d": "CASE WHEN ret_30d > 1 THEN 'up' WHEN ret_30d < -1 THEN 'down_or_flat' ELSE 'uncertain' END",
        "status": "CASE WHEN i < 100 THEN 'unavailable' ELSE 'ok' END", "edge_value_7d": "accel * 3", "edge_value_30d": "ret_30d", "hit_7d": "50 + win_30 / 5", "hit_30d": "45 + win_30 / 4", "passes_7d": "ret_7d > 1", "passes_30d": "ret_30d > 2",
        "selective_hit_7d": "55 + win_30 / 4", "selective_n_7d": "20 + streak_days", "selective_edge_7d": "2 + accel", "selective_hit_30d": "70 + win_30 / 4", "selective_n_30d": "20 + streak_days", "selective_edge_30d": "4 + ret_1",
        "specific": "code = '3-MEDIUM'", "selective_valid": "ret_60d > 0", "validation_ok": "ret_90d > 0", "cv_ok": "ret_30d > 0", "hit_bound": "50 + win_30 / 6", "validation_hit": "75 + win_30 / 8", "validation_n": "3 + streak_days", "avg_return": "ret_30d", "profit_factor": "1 + ret_30d / 5",
    }
]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar metrics and risk of every code and date; codes without context have no kind, market or position."""
    return judge(calendar.metrics(nav_panel(spark, sf_dir)), spark.sql(CONTEXT))


def judge(metrics: DataFrame, context: DataFrame) -> DataFrame:
    """Metrics as scores take them, with what is known of each code, its kind and its risk."""
    return dec.with_risk(dec.with_kinds(calendar.neutral(metrics).join(F.broadcast(context), "code", "left")))


def _judged_sql(select: str, stages: list = ()) -> str:
    return with_risk(select.format(rows=dec.stages_sql("rk", list(stages))), CONTEXT)


def _query(name: str, columns: str, stages: list, doubles: str):
    cols = f"code i {columns}".split()
    return name, lambda s, d: dec.apply_stages(judged(s, d), stages).select(*cols), _judged_sql(f"SELECT {', '.join(cols)} FROM {{rows}}", stages), doubles


REASONS_SQL = _judged_sql(
    f"SELECT code, i, {scoring.told(scoring.REASONS)} AS risk_reasons, {scoring.told(scoring.WARNINGS)} AS risk_warnings FROM (SELECT * REPLACE (round(nav, 4) AS nav) FROM {{rows}})"
)


def forecasts(s: SparkSession, d: str) -> DataFrame:
    return dec.forecast(judged(s, d)).select("code", "i", "horizon", *dec.FORECAST_COLUMNS)


_UNGATED = " UNION ALL ".join(f"SELECT code, i, {p} AS horizon, risk_score, quality, {', '.join(dec.FORECAST_COLUMNS[1:])} FROM {dec.stages_sql('rk', dec.forecast_stages(p, 'round_even'))}" for p in scoring.HORIZONS)
_OPEN = lambda c, unsaid: f"CASE WHEN gate = 'insufficient' THEN {unsaid} ELSE {c} END AS {c}"
#: Forecasts with the gates of short histories.
GATED_CTE = f"""fg AS (SELECT * REPLACE ({', '.join(_OPEN(c, u) for c, u in (("raw", "0"), ("squashed", "0"), ("up1", "33"), ("side2", "34"), ("down1", "33"), ("direction2", "'不确定'"), ("rise_fall", "'不确定'"), ("confidence", "'低'"), ("conflict", "FALSE"), ("range_low", "NULL"), ("range_high", "NULL")))})
  FROM (SELECT *, CASE WHEN horizon = 1 AND i < 7 OR horizon = 3 AND i < 11 OR horizon = 7 AND i < 14 THEN 'insufficient' WHEN horizon = 30 AND i < 59 THEN 'low_confidence' ELSE 'open' END AS gate FROM ({_UNGATED})))"""
FORECAST_SQL = with_risk(f"SELECT code, i, horizon, {', '.join(dec.FORECAST_COLUMNS)} FROM fg", CONTEXT, GATED_CTE)


def calibrated(sm: DataFrame) -> DataFrame:
    return dec.calibration_lookup(sm.select("code", "horizon", "i", F.col("raw_score").alias("raw")), bt.score_buckets(sm)).select("code", "horizon", "i", "raw", "observed")


def _bucket_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN {k}" for k, (lo, hi) in enumerate(zip(bt.BUCKETS, bt.BUCKETS[1:]))) + " END"


CALIBRATED_SQL = with_samples(
    """SELECT b.code, b.horizon, b.i, raw_score AS raw, c.observed FROM b LEFT JOIN (SELECT code, horizon, k, avg((prediction = actual)::DOUBLE) * 100 AS observed, count(*) AS n FROM b GROUP BY 1, 2, 3) c
    ON b.code = c.code AND b.horizon = c.horizon AND b.k = c.k AND c.n >= 5""",
    f"b AS (SELECT *, {_bucket_sql('raw_score')} AS k FROM smp)",
)
_LLM = {"rule_up": "probability * 100", "llm_up": "CASE WHEN i % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE 50 + ret_1 * 8 END", "llm_confidence": "CASE WHEN i % 2 = 0 THEN '高' WHEN i % 5 = 0 THEN '中' ELSE '低' END"}
ENSEMBLE = ["code", "horizon", "i", "oversold", "blend", "ensemble_direction", "ensemble_confidence"]


def basket(s: SparkSession, d: str) -> DataFrame:
    return joins.basket_features(joins.baskets(joins.latest_holdings(holdings(s, d)), price_panel(s, d)))


_TOP = f"""q AS (SELECT *, CAST(regexp_extract(quarter, '(\\d+)年(\\d+)季度', 1) AS INT) * 10 + CAST(regexp_extract(quarter, '(\\d+)年(\\d+)季度', 2) AS INT) AS q FROM holdings),
top AS (SELECT * FROM (SELECT fund, stock, q, weight_pct, row_number() OVER (PARTITION BY fund ORDER BY weight_pct DESC, stock)::INT AS rank FROM (SELECT *, max(q) OVER (PARTITION BY fund) AS mq FROM q) WHERE q = mq) WHERE rank <= 8)"""
_BASKET = """w AS (SELECT fund, stock, weight_pct / sum(weight_pct) OVER (PARTITION BY fund) AS w, count(*) OVER (PARTITION BY fund) AS n FROM top),
own AS (SELECT fund, p.stock, w, d, close FROM w JOIN prices p ON w.stock = p.stock WHERE n >= 2),
g AS (SELECT a.fund, a.d, w.stock, w.w FROM (SELECT DISTINCT fund, d FROM own) a JOIN w ON a.fund = w.fund),
f AS (SELECT g.fund, g.d, g.w, last_value(o.close IGNORE NULLS) OVER x AS l, first_value(o.close IGNORE NULLS) OVER x AS f FROM g LEFT JOIN own o ON g.fund = o.fund AND g.d = o.d AND g.stock = o.stock
  WINDOW x AS (PARTITION BY g.fund, g.stock ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b0 AS (SELECT fund, d, sum(l / f * w) AS v FROM f GROUP BY 1, 2 HAVING sum(l / f * w) IS NOT NULL),
b1 AS (SELECT *, v / lag(v) OVER (PARTITION BY fund ORDER BY d) - 1 AS r FROM b0),
bf AS (SELECT fund, d, (v / lag(v, 1) OVER p - 1) * 100 AS factor_return_1d, (v / lag(v, 5) OVER p - 1) * 100 AS factor_return_5d, (v / lag(v, 20) OVER p - 1) * 100 AS factor_return_20d,
  CASE WHEN count(v) OVER p30 >= 5 AND max(v) OVER p30 > min(v) OVER p30 THEN (v - min(v) OVER p30) / (max(v) OVER p30 - min(v) OVER p30) * 100 ELSE 50 END AS factor_position_30d,
  CASE WHEN count(v) OVER p20 >= 5 AND v >= avg(v) OVER p20 THEN 1::DOUBLE ELSE 0 END AS factor_above_ma20, CASE WHEN count(r) OVER p20 >= 5 THEN stddev_samp(r) OVER p20 * sqrt(252) * 100 END AS factor_volatility_20d
  FROM b1 WINDOW p AS (PARTITION BY fund ORDER BY d), p30 AS (PARTITION BY fund ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), p20 AS (PARTITION BY fund ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
BASKET_CTES = (HOLDINGS_SQL.strip(), _TOP, PRICE_SQL.strip(), _BASKET)


CODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def code_factors(s: SparkSession, d: str) -> DataFrame:
    """The factors of five funds under the codes of the panel's series, one for each."""
    return basket(s, d).join(F.broadcast(s.createDataFrame(list(enumerate(CODES)), "fund long, code string")), "fund").drop("fund")


def asof_factors(s: SparkSession, d: str) -> DataFrame:
    """The factors of every fund as of each date of the panel's code that the fund goes by."""
    names = F.array(*map(F.lit, CODES))
    funds = table(s, d, "nation").select(F.col("n_nationkey").alias("fund"), F.element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("code"))
    dates = nav_panel(s, d).select("code", "d", "i").join(F.broadcast(funds), "code").drop("code")  # a fund for each nation
    return joins.as_of_join(dates, basket(s, d), key="fund")


ASOF_SQL = with_nav(
    "SELECT fund, d, i, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY fund ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in joins.FACTORS) + " FROM j",
    *BASKET_CTES,
    "fn AS (SELECT n_nationkey AS fund, d, i FROM nation JOIN nav ON code = ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][n_nationkey % 5 + 1])",
    "j AS (SELECT n.fund, n.d, n.i, " + ", ".join(f"bf.{c}" for c in joins.FACTORS) + " FROM fn n ASOF LEFT JOIN bf ON n.fund = bf.fund AND n.d >= bf.d)",
)
# rule search
_KEYS = [f"{f}_{side}" for f in pred.FEATURES for side in ("min", "max")]
_MORE_KEYS = _KEYS + [f"{f}_{side}" for f in pred.EXTERNAL for side in ("min", "max")]
_BOUNDS = lambda keys, external: ", ".join(f"({h}, {n}, {', '.join('NULL::DOUBLE' if rule.get(k) is None else repr(float(rule[k])) for k in keys)})" for h in scoring.HORIZONS for n, rule in enumerate(pred.rule_templates(h, external)))
_MEETS = lambda keys: " AND ".join(f"({k} IS NULL OR {(pred.FEATURES | pred.EXTERNAL)[k[:-4]]} {'>=' if k.endswith('min') else '<='} {k})" for k in keys)
_SUMS = "count(*) AS c, count(*) FILTER (up) AS h, sum(ret) AS s, sum(greatest(ret, 0)) AS g, sum(least(ret, 0)) AS l, min(ret) AS m"
_CASE = lambda values: "CASE horizon " + " ".join(f"WHEN {h} THEN {v}" for h, v in values.items()) + " END"


def _passes(p: str, least: str, goal: float, edge: float, pf: float) -> str:
    return f"(c{p} >= {least} AND h{p} * 100.0::DOUBLE / nullif(c{p}, 0) >= {goal} AND h{p} * 100.0::DOUBLE / nullif(c{p}, 0) - base >= {edge} AND s{p} > 0 AND (CASE WHEN l{p} < -1e-9 THEN g{p} / -l{p} WHEN g{p} > 0 THEN 99 ELSE 0 END) >= {pf})"


def _wilson(p: str) -> str:
    q, n = f"(h{p} / c{p}::DOUBLE)", f"c{p}::DOUBLE"
    return f"greatest(0, ({q} + 3.8416 / (2 * {n}) - 1.96 * sqrt(({q} * (1 - {q}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n}) * 100)"


def _rule_sql(external: bool = False) -> str:
    keys = _MORE_KEYS if external else _KEYS
    _MET, rules = _MEETS(keys), _BOUNDS(keys, external)
    known = ", ".join(pred.EXTERNAL)
    more = (
        *BASKET_CTES,
        f"fc AS (SELECT [{', '.join(map(repr, CODES))}][fund + 1] AS code, * EXCLUDE (fund) FROM bf WHERE fund < 5)",
        "fj AS (SELECT n.code, n.d, n.i, " + ", ".join(f"fc.{c}" for c in pred.EXTERNAL) + " FROM nav n ASOF LEFT JOIN fc ON n.code = fc.code AND n.d >= fc.d)",
        "fk AS (SELECT code, i, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in pred.EXTERNAL) + " FROM fj)",
    ) if external else ()
    samples = f"(SELECT s.*, {known} FROM smp s LEFT JOIN fk ON s.code = fk.code AND s.i - 1 = fk.i)" if external else "smp"
    present = f"(SELECT s.*, {known} FROM now s LEFT JOIN fk ON s.code = fk.code AND s.i = fk.i)" if external else "now"
    part = lambda cond, tag: ", ".join(f"coalesce(sum({x}) FILTER ({cond}), 0) AS {x}{tag}" for x in "chsgl")
    least, val = _CASE(pred.MIN_SIGNALS), _CASE(pred.MIN_VALIDATION)
    least_t = _CASE({h: max(pred.MIN_VALIDATION[h], -(-pred.MIN_SIGNALS[h] * 65 // 100)) for h in pred.MIN_SIGNALS})
    fold_min = _CASE({h: max(2, -(-v * 6 // 10)) for h, v in pred.MIN_VALIDATION.items()})
    folds = range(1, 5)
    seen = " + ".join(f"(c_{f} >= {fold_min})::INT" for f in folds)
    good = " + ".join(f"coalesce(c_{f} >= {fold_min} AND {_passes(f'_{f}', fold_min, 65, 2, 1)}, FALSE)::INT" for f in folds)
    mean = " + ".join(f"CASE WHEN c_{f} >= {fold_min} THEN s_{f} / c_{f} ELSE 0 END" for f in folds)
    return with_samples(
        f"""SELECT code, horizon, ord, 0.55::DOUBLE + t * 0.005::DOUBLE AS threshold, c AS signals, h * 100.0::DOUBLE / c AS hit, c * 100.0::DOUBLE / n AS coverage, s / c AS avg_return,
          CASE WHEN l < -1e-9 THEN g / -l WHEN g > 0 THEN 99 ELSE 0 END AS profit_factor, {_wilson('')} AS bound, train_ok, validation_ok, cv_ok, train_ok AND validation_ok AND cv_ok AS valid, matches_now, m AS worst_return,
          (SELECT median(p.ret) FROM pt p JOIN ru ON p.horizon = ru.horizon AND {_MET} WHERE p.code = bst.code AND p.horizon = bst.horizon AND ru.ord = bst.ord AND p.k >= bst.t) AS median_return
        FROM (SELECT *, row_number() OVER (PARTITION BY code, horizon ORDER BY train_ok AND validation_ok AND cv_ok DESC, matches_now DESC, round(h * 100.0::DOUBLE / c, 9) DESC, c DESC, t, ord) AS rk FROM
          (SELECT *, coalesce(c_t > 0 AND {_passes('_t', least_t, 80, 5, 1.05)} AND {_wilson('_t')} >= 55, FALSE) AS train_ok, coalesce({_passes('_v', val, 80, 5, 1)}, FALSE) AS validation_ok,
             ({seen}) >= 2 AND ({good}) * 100 >= ({seen}) * 50 AND ({mean}) > 0 AS cv_ok,
             EXISTS (SELECT 1 FROM {present} p JOIN ru ON p.horizon = ru.horizon AND {_MET} WHERE p.code = agg.code AND p.horizon = agg.horizon AND ru.ord = agg.ord AND p.probability >= 0.55::DOUBLE + t * 0.005::DOUBLE) AS matches_now
           FROM agg WHERE {_passes('', least, 80, 5, 1.05)} AND {_wilson('')} >= 55)) bst WHERE rk = 1""",
        *more,
        "bs AS (SELECT code, horizon, greatest(avg(up::DOUBLE), avg((momentum_up = up)::DOUBLE)) * 100 AS base FROM smp GROUP BY 1, 2)",
        f"ru(horizon, ord, {', '.join(keys)}) AS (VALUES {rules})",
        f"""pt AS (SELECT *, ntile(4) OVER (PARTITION BY code, horizon ORDER BY i) AS fold, row_number() OVER (PARTITION BY code, horizon ORDER BY i) <= count(*) OVER (PARTITION BY code, horizon) - ceil(count(*) OVER (PARTITION BY code, horizon) * 0.3::DOUBLE) AS train,
          count(*) OVER (PARTITION BY code, horizon) AS n, least(70, floor((probability - 0.55::DOUBLE) / 0.005::DOUBLE + 1e-9)) AS k FROM {samples})""",
        f"ce AS (SELECT p.code, p.horizon, ord, k, fold, train, n, {_SUMS} FROM pt p JOIN ru ON p.horizon = ru.horizon AND {_MET} WHERE k >= 0 GROUP BY ALL)",
        f"agg AS (SELECT ce.code, ce.horizon, ord, t, ce.n, any_value(base) AS base, sum(c) AS c, sum(h) AS h, sum(s) AS s, sum(g) AS g, sum(l) AS l, min(m) AS m, {part('train', '_t')}, {part('NOT train', '_v')}, {', '.join(part(f'fold = {f}', f'_{f}') for f in folds)} FROM ce JOIN range(71) r(t) ON t <= k JOIN bs ON ce.code = bs.code AND ce.horizon = bs.horizon GROUP BY 1, 2, 3, 4, 5)",
    )


# portfolios from customers
_POSITIONS = """SELECT c_mktsegment AS portfolio, lpad(CAST(c_custkey AS STRING), 6, '0') AS code, CASE WHEN c_custkey % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE 0.8e0 + c_custkey % 50 / 100e0 END AS cost_nav,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE c_acctbal END AS holding_amount, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 * 10e0 END AS holding_units, 10e0 + c_custkey % 20 AS max_loss_percent,
  0.9e0 + c_custkey % 30 / 100e0 AS nav, CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE c_custkey % 101 * 1e0 END AS risk_score, CASE WHEN c_custkey % 4 = 0 THEN 'low' ELSE 'medium' END AS quality,
  CASE c_custkey % 6 WHEN 0 THEN 'reduce' WHEN 1 THEN 'avoid' WHEN 2 THEN 'observe' WHEN 3 THEN 'hold' WHEN 4 THEN 'buy_watch' END AS action FROM customer"""


def positions(s: SparkSession, d: str) -> DataFrame:
    """Positions out of customers; integer remainders keep both engines on the same numbers."""
    table(s, d, "customer").createOrReplaceTempView("fundlattice_customer")
    return s.sql(_POSITIONS.replace("FROM customer", "FROM fundlattice_customer"))


_P = f"p AS ({_POSITIONS})"
_UNITS = "coalesce(nullif(holding_units, 0), nullif(holding_amount, 0) / cost_nav, 0)"
_OK = f"cost_nav > 0 AND {_UNITS} > 0"
_SUMMARY = f"""SELECT *, CASE WHEN cost <> 0 THEN pnl / cost * 100 END AS pnl_pct FROM (SELECT portfolio, count(*) AS funds, {", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in portfolio.PRIORITY)},
  sum(coalesce(holding_amount, 0)) AS total_holding, sum((nav - cost_nav) * {_UNITS}) FILTER ({_OK}) AS pnl, sum(cost_nav * {_UNITS}) FILTER ({_OK}) AS cost, avg(risk_score) AS mean_risk,
  count(*) FILTER (risk_score > 70) AS high_risk, count(*) FILTER (quality = 'low') AS low_quality, count(*) FILTER ((nav - cost_nav) / cost_nav * -100 >= max_loss_percent * 0.7) AS near_max_loss FROM p GROUP BY 1)"""
_WARN = [("high_risk / funds::DOUBLE > 0.3", "high_risk"), ("n_reduce + n_avoid > 0", "reduce_first"), ("n_buy_watch > 0", "opportunity"), ("low_quality / funds::DOUBLE > 0.5", "low_quality"), ("near_max_loss > 0", "near_max_loss")]
_MOVES = """m AS (SELECT event_type, CAST(ts AS DATE) AS d, user_id % 4 AS idx, (sum(CAST(round(value * 100) AS BIGINT)) / 100e0 / count(*) - 50) / 7 AS change_pct FROM events GROUP BY 1, 2, 3)"""


def moves(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("d"), (F.col("user_id") % 4).alias("idx")).agg(((F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100.0) / F.count("*") - 50) / 7).alias("change_pct"))


def macro_rows(s: SparkSession, d: str) -> DataFrame:
    x = F.col("change_pct")
    pick = lambda k, v: F.when(F.col("idx") == k, v)
    return moves(s, d).select("event_type", "d", pick(0, x).alias("us_change"), pick(1, x / 20 + 7.2).alias("usdcny"), pick(2, x / 4 + 2).alias("on_rate"), pick(3, x / 4 + 2.3).alias("m1_rate"))


_MACRO = """SELECT *, CASE WHEN us_change > 1 THEN 'bullish' WHEN us_change < -1 THEN 'bearish' ELSE 'mixed' END AS overseas,
  CASE WHEN on_rate > 2.5 AND us_change > 1 THEN 'neutral' WHEN on_rate < 1.5 AND NOT coalesce(us_change > 1 OR us_change < -1, FALSE) THEN 'risk-on' WHEN us_change > 1 THEN 'risk-on' WHEN us_change < -1 THEN 'risk-off' ELSE 'neutral' END AS risk_appetite,
  CASE WHEN m1_rate - on_rate < 0.1 THEN 'tight' WHEN on_rate > 2.5 THEN 'tight' WHEN on_rate < 1.5 THEN 'loose' WHEN on_rate IS NOT NULL THEN 'neutral' ELSE 'unknown' END AS liquidity,
  CASE WHEN usdcny > 7.3 THEN '贬值压力较大' WHEN usdcny > 7.1 THEN '有一定贬值压力' ELSE 'stable' END AS forex_pressure, m1_rate - on_rate AS spread
  FROM (SELECT event_type, d, avg(CASE WHEN idx = 0 THEN change_pct END) AS us_change, avg(CASE WHEN idx = 1 THEN change_pct / 20 + 7.2 END) AS usdcny, avg(CASE WHEN idx = 2 THEN change_pct / 4 + 2 END) AS on_rate, avg(CASE WHEN idx = 3 THEN change_pct / 4 + 2.3 END) AS m1_rate FROM m GROUP BY 1, 2)"""


def dedup_source(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("code"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("price"))


def estimates(s: SparkSession, d: str) -> DataFrame:
    """Quote-like lines made of events, parsed again."""
    line = F.format_string('jsonpgz({"fundcode":"%06d","name":"f%d","jzrq":"2024-01-01","dwjz":"%s","gsz":"%s","gszzl":"0.5","gztime":"%s"});', "user_id", "event_id", F.col("value").cast("string"), F.col("value").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return readers.parse_estimates(table(s, d, "events").select(line.alias("value")))


def override(s: SparkSession, d: str) -> DataFrame:
    navs = table(s, d, "events").groupBy(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code")).agg(F.date_add(F.to_date(F.min("ts")), 10).alias("data_end"), F.min("value").alias("unit_nav"))
    return daily.estimate_override(estimates(s, d).select("code", "estimate_time", "estimated_nav"), navs)


def fallback(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    out = readers.with_fallback([o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus")])
    return out.groupBy("code").agg(F.count("*").alias("n"), F.min("k").alias("first_k"))


FALLBACK_SQL = """WITH o AS (SELECT o_custkey AS code, o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS src FROM orders),
c AS (SELECT code, src, count(*) AS n, min(k) AS first_k FROM o GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT code, n, first_k FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n >= 5 DESC, CASE WHEN n >= 5 THEN src END, n DESC, src) AS rk FROM c) WHERE rk = 1"""


# dimensions and snapshots
def dimension(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("code"), "p_name", "p_brand", "p_type", F.col("p_partkey").alias("k"))
    first = p.where("k % 2 = 0").select("code", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("p_name")).alias("name"))
    second = p.where("k % 5 <> 0").select("code", F.col("p_brand").alias("name"), F.when(F.col("k") % 7 == 0, "unavailable").otherwise(F.col("p_type")).alias("type"))
    return profiles.first_known([first, second], ["name", "type"])


DIMENSION_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS code, coalesce(CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN p_name END, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END) AS name,
 CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_type END AS type FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0"""


def padding(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    expected = e.select(F.col("event_type").alias("category")).distinct().withColumn("name", F.explode(F.array(*map(F.lit, ("0", "1", "2", "x")))))
    rows = moves(s, d).select(F.col("event_type").alias("category"), F.col("idx").cast("string").alias("name"), (F.col("change_pct") * 2).alias("latest"), "change_pct", F.col("d").alias("as_of"))
    return profiles.padded(expected, rows)


PADDING_SQL = f"""WITH {_MOVES}, e AS (SELECT DISTINCT event_type AS category, unnest(['0', '1', '2', 'x']) AS name FROM events)
SELECT e.category, e.name, arg_max(change_pct, d) * 2 AS latest, arg_max(change_pct, d) AS change_pct, max(d) AS as_of, CASE WHEN max(d) IS NULL THEN 'unavailable' ELSE 'ok' END AS status
FROM e LEFT JOIN m ON e.category = m.event_type AND e.name = CAST(m.idx AS VARCHAR) GROUP BY 1, 2"""


def status(s: SparkSession, d: str) -> DataFrame:
    return readers.source_status(table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice")).alias("nav")))


STATUS_SQL = """SELECT o_custkey AS code, o_orderstatus AS source, count(*) FILTER (o_totalprice > 100000) > 0 AS available, count(*) FILTER (o_totalprice > 100000) || ' rows' AS detail FROM orders GROUP BY 1, 2"""


def normalised(s: SparkSession, d: str) -> DataFrame:
    raw = nav_panel(s, d).select("code", F.date_format("d", "yyyy-MM-dd").alias("净值日期"), F.when(F.col("i") % 10 == 3, "--").otherwise((F.floor(F.col("nav") * 1e4 + 0.5) / 1e4).cast("string")).alias("Unit_Nav"))
    return readers.normalise_nav(raw).select("code", "nav_date", "unit_nav", "daily_ret_pct")


NORMALISED_SQL = with_nav(
    """SELECT code, d AS nav_date, v AS unit_nav, (v / lag(v) OVER (PARTITION BY code ORDER BY d) - 1) * 100 AS daily_ret_pct
    FROM (SELECT code, d, floor(nav * 10000 + 0.5) / 10000 AS v FROM nav WHERE i % 10 <> 3)"""
)
