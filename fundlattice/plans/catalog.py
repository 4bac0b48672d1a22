"""The registered queries: each a name, a function of (spark, sf_dir) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlattice.operators import backtest as bt
from fundlattice.operators import calendar as cal
from fundlattice.operators import indicators as ind
from fundlattice.operators import prediction as pred
from fundlattice.operators import walkforward as wf
from fundlattice.operators import decisions as dec
from fundlattice.operators import documents as docs
from fundlattice.operators import joins, portfolio, scoring
from fundlattice.plans import backtest_sql as bsql
from fundlattice.plans import calendar_sql as csql
from fundlattice.plans import decision_queries as dq
from fundlattice.plans import indicator_sql as isql
from fundlattice.plans import more_queries as mq
from fundlattice.plans import text_queries as tq
from fundlattice.plans import texts_sql as tsql
from fundlattice.plans.walkforward_sql import with_samples
from fundlattice.sources import profiles
from fundlattice.sources.panel import HOLDINGS_SQL, holdings, nav_panel, table
from fundlattice.streaming import daily

#: Doubles are compared at so many places.
PLACES = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    #: names of the columns that hold doubles, space-separated
    doubles: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.withColumns({c: F.round(c, PLACES) + F.lit(0.0) for c in self.doubles.split()}) if self.doubles else df

    def oracle(self) -> str | None:
        if not self.sql or not self.doubles:
            return self.sql
        rounded = ", ".join(f"round({c}, {PLACES}) + 0.0::DOUBLE AS {c}" for c in self.doubles.split())
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql})"


def on_panel(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(nav_panel(spark, sf_dir))


def _names(pattern: str, values) -> str:
    return " ".join(pattern.format(v) for v in values)


_MACD = ["macd_line", "signal_line", "histogram", "histogram_prev", "crossover", "direction"]
INDICATORS = [
    Query("returns_trading", on_panel(ind.returns_trading), isql.RETURNS_TRADING, _names("ret_{0}_a ret_{0}_b", (1, 5, 10, 20, 60))),
    Query("returns_calendar", on_panel(ind.returns_calendar), isql.RETURNS_CALENDAR, _names("ret_{}", (7, 30, 60, 90))),
    Query("sma_trend", on_panel(ind.sma_trend), isql.SMA_TREND, _names("ma_{}", (5, 10, 20, 60))),
    Query("trend_b", on_panel(ind.trend_b), isql.TREND_B, _names("ma_{}", (5, 10, 20, 60))),
    Query("vol_windows", on_panel(ind.vol_windows), isql.VOL_WINDOWS, "vol_30 vol_60 vol_90 down_30 down_60"),
    Query("drawdown_calendar", on_panel(ind.drawdown_calendar), isql.DRAWDOWN_CALENDAR, _names("dd_{}", (7, 30, 60, 90))),
    Query("drawdown_trading", on_panel(ind.drawdown_trading), isql.DRAWDOWN_TRADING, "dd_5_a dd_20_a dd_60_a dd_5_b dd_20_b dd_40_b dd_60_b"),
    Query("range_position", on_panel(ind.range_position), isql.RANGE_POSITION, _names("pos_{}_a", (7, 30, 60, 90)) + " " + _names("pos_{}_b", (5, 20, 40, 60))),
    Query("rebound_pullback", on_panel(ind.rebound_pullback), isql.REBOUND_PULLBACK, _names("rebound_{0}_a pullback_{0}_a", (7, 30)) + " " + _names("rebound_{0}_b pullback_{0}_b", (5, 20))),
    Query("sharpe_calmar", on_panel(ind.sharpe_calmar), isql.SHARPE_CALMAR, "sharpe_30_a sharpe_60_a calmar_60_a calmar_90_a calmar_40_b calmar_60_b"),
    Query("win_rate_stats", on_panel(ind.win_rate_stats), isql.WIN_RATE, "win_20 win_60 day_mean day_max day_min"),
    Query("momentum_accel", on_panel(ind.momentum_accel), isql.MOMENTUM, "accel_a accel_b accel_c"),
    Query("ewma_vol", on_panel(ind.ewma_vol), isql.EWMA, "ewma_a ewma_b"),
    Query("vol_percentile", on_panel(ind.vol_percentile), isql.VOL_PERCENTILE, "pct"),
    Query("vol_percentile_b", on_panel(ind.vol_percentile_b), isql.VOL_PERCENTILE_B, "pct"),
    Query("streaks", on_panel(ind.streaks), isql.STREAKS),
    Query("rsi_wilder", on_panel(ind.rsi_wilder), isql.RSI_WILDER, "rsi_6 rsi_14 rsi_28"),
    Query("rsi_wilder_daily", on_panel(lambda p: cal.wilder_rsi(p).select("code", "i", "rsi_6", "rsi_14", "rsi_28")), csql.RSI_DAILY, "rsi_6 rsi_14 rsi_28"),
    Query("macd_a_daily", on_panel(lambda p: cal.macd(p).select("code", "i", *_MACD)), csql.MACD_DAILY, " ".join(_MACD[:4])),
    Query("calendar_metrics", on_panel(cal.metrics), csql.CALENDAR_METRICS, csql.DOUBLES),
    Query("rsi_simple", on_panel(ind.rsi_simple), isql.RSI_SIMPLE, "rsi_6 rsi_14 rsi_28"),
    Query("macd_a", on_panel(ind.macd_a), isql.MACD_A, "macd_line signal_line histogram histogram_prev"),
    Query("macd_b", on_panel(ind.macd_b), isql.MACD_B, "histogram"),
    Query("bollinger", on_panel(ind.bollinger), isql.BOLLINGER, "pos_a width_a upper lower pos_b width_b pos_c"),
    Query("skews", on_panel(ind.skews), isql.SKEWS, "skew_a skew_b"),
    Query("short_features", on_panel(ind.short_features), isql.SHORT, _names("ret_{}", (1, 3, 5, 10)) + " " + _names("ma_{}", (3, 5, 10, 20)) + " support resistance vol_10 llm_ret_7d llm_ret_30d llm_vol"),
]


#: What the aggregates and models read of a sample.
SAMPLE = "code horizon i market prediction actual momentum threshold ret raw_score score adjusted probability prev_return up momentum_up pos_30 pos_60 rsi_6 rsi_14 bb_pos ret_1 ret_5 ret_20"


PRESENT = ["code", "horizon", "i", "probability", *dict.fromkeys(pred.FEATURES.values())]
_kept: list[DataFrame] = []


def _keep(df: DataFrame) -> DataFrame:
    """df, kept for passes to come (in memory, else on disk; lost parts are made again); what was kept before is released."""
    while _kept:
        _kept.pop().unpersist()
    _kept.append(df.persist())
    return df


def on_samples(f: Callable[[DataFrame], DataFrame], passes: int = 1) -> Callable[[SparkSession, str], DataFrame]:
    """f over walk-forward samples; those that f passes over more than once are kept."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = wf.samples(nav_panel(spark, sf_dir)).select(*SAMPLE.split())
        return f(_keep(s) if passes > 1 else s)

    return run


def on_models(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f over walk-forward samples and the present rows."""
    return lambda spark, sf_dir: on_samples(lambda s: f(s, wf.present(nav_panel(spark, sf_dir)).select(*PRESENT)), passes=2)(spark, sf_dir)


def external_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule search with templates on the factors of a fund's basket, for codes that stand for a fund each."""
    panel, factors = nav_panel(spark, sf_dir), dq.code_factors(spark, sf_dir)

    def search(s: DataFrame, now: DataFrame) -> DataFrame:
        s = _keep(joins.with_factors(s, panel, factors, behind=1))
        return pred.rule_search(s, pred.rule_table(spark, external=True), joins.with_factors(now, panel, factors, behind=0), pred.FEATURES | pred.EXTERNAL)

    return search(wf.samples(panel).select(*SAMPLE.split()), wf.present(panel).select(*PRESENT))


BACKTEST = [
    Query("walkforward_features", on_panel(lambda p: wf.features(p).select("code", "i", *bsql.FEATURE_DOUBLES.split(), *bsql.FEATURE_LABELS.split())), bsql.WALKFORWARD_FEATURES, bsql.FEATURE_DOUBLES),
    Query("walkforward_labels", on_samples(lambda s: s.select(*bsql.LABEL_COLUMNS.split(), "threshold", "ret", "raw_score", "score")), bsql.LABELS_SQL, "threshold ret raw_score score"),
    Query("confusion_matrix", on_samples(bt.confusion_matrix), bsql.CONFUSION),
    Query("actual_distribution", on_samples(bt.actual_distribution), bsql.DISTRIBUTION, "up_pct sideways_pct down_pct threshold_mean threshold_median"),
    Query("brier_multiclass", on_samples(bt.brier_multiclass), bsql.BRIER, "brier"),
    Query("calibration_bins", on_samples(bt.calibration_bins), bsql.CALIBRATION, "expected observed gap"),
    Query("hit_by_confidence", on_samples(bt.hit_by_move, passes=2), bsql.HIT_BY_MOVE, "hit_high hit_medium hit_low"),
    Query("return_stats", on_samples(bt.return_stats), bsql.RETURN_STATS, "mean median p10 p90"),
    Query("score_buckets", on_samples(bt.score_buckets), bsql.SCORE_BUCKETS, "accuracy pct"),
    Query("score_stats", on_samples(bt.score_stats), bsql.SCORE_STATS, "mean std p10 p50 p90"),
    Query("baseline_edge", on_samples(bt.baseline_edge), bsql.BASELINE, "rule_acc sideways_acc momentum_acc edge"),
    Query("down_precision_recall", on_samples(bt.down_metrics), bsql.DOWN, "precision recall f1"),
    Query("probability_quality", on_samples(bt.quality, passes=2), bsql.QUALITY),
    Query("up_probability", on_samples(lambda s: s.select("code", "horizon", "i", "adjusted", "probability", "prev_return", "up", "momentum_up")), bsql.UP_PROBABILITY, "adjusted probability prev_return"),
    Query("binary_metrics", on_samples(pred.binary_metrics), bsql.BINARY, "hit up_rate momentum_hit brier majority_hit edge"),
    Query("kernel_calibration", on_models(pred.kernel_calibration), bsql.KERNEL, "now base calibrated"),
    Query("threshold_sweep", on_samples(pred.threshold_sweep, passes=4), bsql.SWEEP, "threshold hit edge"),
    Query("ts_cv_folds", on_samples(pred.ts_cv_folds), bsql.FOLDS_SQL, "hit"),
]
SCORES = "trend_risk drawdown_risk volatility_risk position_risk macro_risk personal_risk risk_score"
JOINS = [
    Query("latest_holdings_topk", lambda s, d: joins.latest_holdings(holdings(s, d)), f"WITH {HOLDINGS_SQL.strip()}, {dq._TOP} SELECT * FROM top", "weight_pct"),
    Query("basket_factors", dq.basket, f"WITH {', '.join(dq.BASKET_CTES)} SELECT * FROM bf", " ".join(joins.FACTORS)),
    Query("asof_factors", dq.asof_factors, dq.ASOF_SQL, " ".join(joins.FACTORS)),
    Query("source_fallback", dq.fallback, dq.FALLBACK_SQL),
    Query("dedup_last_wins", lambda s, d: portfolio.dedup_last_wins(dq.dedup_source(s, d)), "SELECT CAST(o_custkey AS VARCHAR) AS code, min(o_orderkey) AS place, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1"),
    Query("valid_codes", lambda s, d: portfolio.valid_codes(table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("code")).distinct()), "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS code FROM orders WHERE regexp_full_match(CAST(o_orderkey AS VARCHAR), '[0-9]{5,6}')"),
    Query(
        "json_props", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", F.col("p.k").cast("long").alias("k")).where("k is not null"),
        "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL",
    ),
    Query(
        "estimate_override", dq.override,
        """SELECT e.code, e.t AS estimate_time, n.data_end, CAST(left(e.t, 10) AS DATE) > n.data_end AS fresh, CASE WHEN CAST(left(e.t, 10) AS DATE) > n.data_end THEN e.value ELSE n.v END AS nav
        FROM (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, strftime(ts, '%Y-%m-%d %H:%M') AS t, value FROM events) e
        JOIN (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, CAST(min(ts) AS DATE) + 10 AS data_end, min(value) AS v FROM events GROUP BY 1) n ON e.code = n.code""", "nav",
    ),
    Query("daily_events", lambda s, d: daily.daily_series(table(s, d, "events")), "SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2"),
]
DECISIONS = [
    Query(*dq._query("risk_score", f"{SCORES} risk_level risk_colour", [], SCORES)),
    Query("risk_reasons", lambda s, d: dec.apply_stages(dq.judged(s, d).withColumns({"has_position": F.expr(dec.HAS_POSITION), "nav": F.round("nav", 4)}), [{"risk_reasons": scoring.told(scoring.REASONS), "risk_warnings": scoring.told(scoring.WARNINGS)}]).select("code", "i", "risk_reasons", "risk_warnings"), dq.REASONS_SQL),
    Query("keyword_types", lambda s, d: dec.with_kinds(mq.part_kinds(s, d)).select("code", "high_vol", "qdii", "defensive", "china"), mq.KEYWORD_TYPES_SQL),
    Query("forecast_probs", dq.forecasts, dq.FORECAST_SQL, "raw squashed up1 side2 down1 range_low range_high"),
    Query("calibration_lookup", on_samples(dq.calibrated, passes=2), dq.CALIBRATED_SQL, "raw observed"),
    Query("ensemble", on_samples(lambda s: dec.apply_stages(s, [dq._LLM, *dec.ENSEMBLE_STAGES]).select(*dq.ENSEMBLE)), dq.with_samples(f"SELECT {', '.join(dq.ENSEMBLE)} FROM {dec.stages_sql('smp', [dq._LLM, *dec.ENSEMBLE_STAGES])}"), "oversold blend"),
    Query(*dq._query("decision_advice", "risk_score advice advice_confidence buy_pct buy_amount near_max_loss", [*dq.STUBS, *dec.ADVICE_STAGES], "risk_score buy_amount")),
    Query(*dq._query("final_decision", "final_direction final_action final_confidence headline", [*dq.STUBS, *dec.FINAL_STAGES], "")),
    Query(*dq._query("high_confidence_gate", "failed_gates passed swing gate_action gate_score max_pct", [*dq.STUBS, *dec.GATE_STAGES], "gate_score")),
    Query("calibrated_forecast", lambda s, d: on_samples(lambda sm: tq.calibrated_forecast(s, d, sm), passes=3)(s, d), tq.CALIBRATED_FORECAST_SQL, "up sideways down"),
    Query("holdings_years", tq.holdings_years, tq.HOLDINGS_YEARS_SQL, "weight_pct"),
    Query("score_reasons", tq.score_reasons, tsql.SCORE_REASONS_SQL),
    Query("forecast_reasons", tq.forecast_reasons, tsql.FORECAST_REASONS_SQL),
    Query("decision_support", tq.decision_support, tsql.SUPPORT_SQL),
    Query("advice_texts", tq.advice_texts, tsql.ADVICE_SQL),
    Query("final_texts", tq.final_texts, tsql.FINAL_SQL),
    Query("narrative", lambda s, d: dec.narrative(dec.apply_stages(dq.judged(s, d), [*dq.STUBS, *dec.FINAL_STAGES])), mq.NARRATIVE_SQL),
    Query("rule_search_external", external_rules, dq._rule_sql(external=True), "threshold hit coverage avg_return worst_return median_return profit_factor bound"),
    Query("rule_search", on_models(lambda s, now: pred.rule_search(s, pred.rule_table(s.sparkSession), now)), dq._rule_sql(), "threshold hit coverage avg_return worst_return median_return profit_factor bound"),
]
PORTFOLIO = [
    Query("portfolio_summary", lambda s, d: portfolio.summary(dq.positions(s, d)), f"WITH {dq._P} {dq._SUMMARY}", "total_holding pnl cost mean_risk pnl_pct"),
    Query(
        "portfolio_warnings", lambda s, d: portfolio.warnings(portfolio.summary(dq.positions(s, d))),
        f"WITH {dq._P}, t AS ({dq._SUMMARY}) SELECT portfolio, coalesce(nullif(concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{w}{chr(39)} END' for c, w in dq._WARN)}), ''), 'none') AS warnings FROM t",
    ),
    Query(
        "portfolio_priority_sort", lambda s, d: portfolio.priority_order(dq.positions(s, d)).select("portfolio", "code", "priority", "rank"),
        f"WITH {dq._P}, q AS (SELECT *, CASE coalesce(action, 'observe') {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {n}' for n, a in enumerate(portfolio.PRIORITY))} END AS priority FROM p) SELECT portfolio, code, priority, row_number() OVER (PARTITION BY portfolio ORDER BY priority, coalesce(risk_score, 0) DESC, code)::INT AS rank FROM q",
    ),
    Query(
        "portfolio_upsert", lambda s, d: portfolio.upsert(dq.positions(s, d).where("risk_score < 60").select("code", "nav"), dq.positions(s, d).where("risk_score > 50").select("code", (F.col("nav") + 1).alias("nav"))),
        f"WITH {dq._P} SELECT code, nav FROM p WHERE risk_score <= 50 UNION ALL SELECT code, nav + 1 FROM p WHERE risk_score > 50", "nav",
    ),
    Query("portfolio_delete", lambda s, d: portfolio.delete(dq.positions(s, d).select("code", "nav"), dq.positions(s, d).where("risk_score > 50").select("code")), f"WITH {dq._P} SELECT code, nav FROM p WHERE NOT coalesce(risk_score > 50, FALSE)", "nav"),
    Query(
        "market_sentiment", lambda s, d: portfolio.market_sentiment(dq.moves(s, d), ["event_type", "d"]),
        f"""WITH {dq._MOVES} SELECT event_type, d, mean, up, n, CASE WHEN mean > 1.5 AND up >= n * 0.75 THEN 'very_bullish' WHEN mean > 0.5 AND up >= n * 0.6 THEN 'bullish' WHEN mean < -1.5 AND up <= n * 0.25 THEN 'very_bearish' WHEN mean < -0.5 AND up <= n * 0.4 THEN 'bearish' ELSE 'neutral' END AS sentiment,
        CASE WHEN mean > 0.8 THEN 'strong_inflow' WHEN mean > 0.3 THEN 'inflow' WHEN mean < -0.8 THEN 'strong_outflow' WHEN mean < -0.3 THEN 'outflow' ELSE 'neutral' END AS flow
        FROM (SELECT event_type, d, avg(change_pct) AS mean, count(*) FILTER (change_pct > 0) AS up, count(change_pct) AS n FROM m GROUP BY 1, 2)""", "mean",
    ),
    Query("macro_summary", lambda s, d: portfolio.macro_summary(dq.macro_rows(s, d), ["event_type", "d"]), f"WITH {dq._MOVES} {dq._MACRO}", "us_change usdcny on_rate m1_rate spread"),
]
_JUDGED = ", ".join(f"CASE WHEN n >= {wf.MIN_SAMPLES} THEN {x} END AS {c}" for x, c in (("b.hit", "hit"), ("b.edge", "edge"), ("brier", "brier"), ("calibrated", "judged"), ("threshold", "threshold"), ("signals", "signals"), ("s.hit", "selective_hit"), ("s.edge", "selective_edge")))
_PREDICTED = f"""SELECT w.code, w.horizon, w.now, coalesce(n, 0) AS n, coalesce(judged, w.now) AS calibrated, hit, edge, brier, threshold, signals, selective_hit, selective_edge
 FROM ({with_samples("SELECT code, horizon, probability AS now FROM now")}) w LEFT JOIN (SELECT b.code, b.horizon, n, {_JUDGED}
 FROM ({bsql.BINARY}) b JOIN ({bsql.KERNEL}) k ON b.code = k.code AND b.horizon = k.horizon JOIN ({bsql.SWEEP}) s ON b.code = s.code AND b.horizon = s.horizon) j ON w.code = j.code AND w.horizon = j.horizon"""
_PREDICTIONS = f"SELECT code, horizon, n, hit, edge, brier, calibrated, passes, confidence, direction, label, usable, signals, selective_hit, selective_edge FROM {dec.stages_sql(f'({_PREDICTED})', docs.STAGES)}"
_BIAS = dq.with_risk(f"SELECT code, i, {docs.ACTION_BIAS} AS action_bias FROM fg WHERE horizon = 7", dq.CONTEXT, dq.GATED_CTE)
DOCUMENTS = [
    Query("predictions", on_models(docs.predictions), _PREDICTIONS, "hit edge brier calibrated selective_hit selective_edge"),
    Query("present_decisions", lambda s, d: on_models(lambda sm, now: mq.present_decisions(s, d, sm, now))(s, d), mq.present_decisions_sql(_PREDICTIONS), "risk_score buy_amount gate_score"),
    Query("prediction_quality", on_models(lambda s, now: docs.prediction_quality(docs.predictions(s, now))), f"SELECT *, {docs.QUALITY} AS quality FROM (SELECT code, count(*) FILTER (usable) AS usable, sum(n)::BIGINT AS samples, FALSE AS trained FROM ({_PREDICTIONS}) GROUP BY code)"),
    Query(
        "analysis_documents", on_models(lambda s, now: docs.documents(docs.predictions(s, now))),
        f"""SELECT code, '{{"code":' || to_json(code) || ',"periods":{{' || string_agg('"' || horizon || 'd":' || to_json({{'n': n, 'calibrated': round(calibrated, 4), 'confidence': confidence, 'direction': direction, 'label': label, 'edge': round(edge, 2), 'brier': round(brier, 4)}}), ',' ORDER BY horizon || 'd')
        || '}},"disclaimer":"仅供个人研究参考，不构成投资建议。"}}' AS document FROM ({_PREDICTIONS}) GROUP BY code""",
    ),
    Query("action_bias", lambda s, d: dec.forecast(dq.judged(s, d), [7]).select("code", "i", F.expr(docs.ACTION_BIAS).alias("action_bias")), _BIAS),
    Query("one_year_return", on_panel(profiles.one_year_return), dq.with_nav(f"SELECT code, arg_max_null(x, d) AS return_1y FROM (SELECT code, d, (nav / lag(nav, 249) {isql.OVER} - 1) * 100 AS x FROM nav) GROUP BY code"), "return_1y"),
    Query("history_range", on_panel(profiles.date_range), dq.with_nav("SELECT code, strftime(min(d) - INTERVAL 10 DAYS, '%Y%m%d') AS start, strftime(max(d) + INTERVAL 1 DAY, '%Y%m%d') AS \"end\" FROM nav GROUP BY code")),
    Query("fund_dimension", dq.dimension, dq.DIMENSION_SQL),
    Query("macro_padding", dq.padding, dq.PADDING_SQL, "latest change_pct"),
    Query("whole_documents", tq.whole_documents, tq.WHOLE_DOCUMENTS_SQL),
    Query("batch_analysis", mq.batch_analysis, mq.BATCH_SQL, "latest_nav ret_30d risk_score"),
    Query("sector_lookup", lambda s, d: profiles.sectors(mq.part_kinds(s, d)), mq.SECTOR_LOOKUP_SQL, "change_pct"),
    Query("source_status", dq.status, dq.STATUS_SQL),
    Query("nav_normalised", dq.normalised, dq.NORMALISED_SQL, "unit_nav daily_ret_pct"),
]
MORE = [
    Query("outer_prices", mq.outer_prices, mq.OUTER_PRICES_SQL, " ".join(mq.BRANDS)),
    Query("one_year_cut", on_panel(lambda p: ind.one_year(p).select("code", "d", "i")), mq.ONE_YEAR_SQL),
    Query("metric_aliases", on_panel(lambda p: ind.with_aliases(ind.returns_calendar(p)).select("code", "i", "return_7d", "return_30d", "return_60d", "return_90d")), mq.ALIASES_SQL, "return_7d return_30d return_60d return_90d"),
    Query("uncertainties", on_samples(mq.uncertainties), mq.UNCERTAIN_SQL),
    Query("market_context", lambda s, d: portfolio.market_context(dq.moves(s, d), ["event_type", "d"]), mq.CONTEXT_SQL),
    Query("short_term_route", on_samples(mq.routed), mq.ROUTED_SQL, "route_up"),
    Query("price_sources", mq.price_sources, mq.PRICE_SOURCES_SQL),
    Query("holding_results", mq.holding_results, mq.HOLDING_RESULTS_SQL, "risk_score"),
    Query("short_profiles", mq.short_profiles, mq.SHORT_PROFILES_SQL),
    Query("forecast_gates", mq.forecast_gates, mq.FORECAST_GATES_SQL),
    Query("short_streak", on_panel(ind.streak_c), mq.STREAK_C_SQL),
    Query("range_60", on_panel(ind.range_60), mq.RANGE_60_SQL, "ret_60 pos_60"),
    Query("metrics_summary", on_panel(ind.summary), mq.SUMMARY_SQL, "latest_nav"),
    Query("returns_acc_nav", mq.acc_nav, mq.ACC_NAV_SQL, "ret_30 ret_90"),
    Query("macro_risks", mq.macro_risks, mq.MACRO_RISKS_SQL),
    Query("portfolio_store", mq.portfolio_store, mq.STORE_SQL, "nav risk_score"),
    Query("current_values", mq.current_values, mq.CURRENT_SQL, "value"),
    Query("keyword_match", mq.keyword_match, mq.KEYWORD_SQL),
    Query("portfolio_missing", mq.missing_keys, mq.MISSING_SQL),
    Query("quotes", mq.quotes, mq.QUOTES_SQL, "price prev_close change_pct"),
    Query("keyword_search", mq.keyword_search, mq.SEARCH_SQL),
    Query("exchange_symbols", mq.symbols, mq.SYMBOLS_SQL),
    Query("profile_pivot", mq.profile_pivot, mq.PIVOT_SQL),
    Query("company", lambda s, d: profiles.company_of(mq._items(s, d)), mq.COMPANY_SQL),
    Query("prices_normalised", mq.prices_normalised, mq.PRICES_SQL, "close"),
    Query("positional_join", mq.positional, mq.POSITIONAL_SQL),
    Query("nav_delay", mq.nav_delay, mq.DELAY_SQL),
    Query(
        "batch_report", on_models(lambda s, now: docs.batch_report(docs.prediction_quality(docs.predictions(s, now)), now.select("code").distinct())),
        f"SELECT count(*) AS codes, {', '.join(f'count(*) FILTER (quality = {chr(39)}{x}{chr(39)}) AS n_{x}' for x in ('high', 'medium', 'low'))}, 0 AS n_failed FROM (SELECT {docs.QUALITY} AS quality FROM (SELECT code, count(*) FILTER (usable) AS usable, FALSE AS trained FROM ({_PREDICTIONS}) GROUP BY code))",
    ),
]
QUERIES = [*INDICATORS, *BACKTEST, *JOINS, *DECISIONS, *PORTFOLIO, *DOCUMENTS, *MORE]
