"""Forecast documents: predictions by horizon, quality of a fund's predictions, decision support, and their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlattice.operators import backtest as bt
from fundlattice.operators import calendar
from fundlattice.operators import decisions as dec
from fundlattice.operators import prediction as pred
from fundlattice.operators import texts
from fundlattice.operators.indicators import summary_columns
from fundlattice.operators.decisions import apply_stages
from fundlattice.operators.walkforward import MIN_SAMPLES

LABELS = {"up": "偏上涨", "down_or_flat": "偏不涨", "uncertain": "不确定"}
# fixed values: gates of confidence and direction
#: PRD-6 over now, calibrated, threshold, signals, selective_hit, selective_edge, n, edge, brier.
STAGES = [
    {"passes": "coalesce(now >= threshold, FALSE)"},
    {"confidence": """CASE WHEN passes AND selective_hit >= 60 AND signals >= 20 AND selective_edge >= 3 THEN CASE WHEN signals >= 30 THEN '高' ELSE '中' END
 WHEN n >= 100 AND edge >= 8 AND brier <= 0.22e0 AND abs(calibrated - 0.5e0) >= 0.15e0 THEN '高' WHEN n >= 50 AND edge >= 4 AND brier <= 0.25e0 AND abs(calibrated - 0.5e0) >= 0.1e0 THEN '中' ELSE '低' END"""},
    {"direction": "CASE WHEN passes AND confidence <> '低' THEN 'up' WHEN edge < 3 OR confidence = '低' THEN 'uncertain' WHEN calibrated >= 0.58e0 THEN 'up' WHEN calibrated <= 0.45e0 THEN 'down_or_flat' ELSE 'uncertain' END"},
    {"label": "CASE direction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END", "usable": "passes AND confidence <> '低'"},
]
#: SCR-16 over risk_score, quality, up1, down1, confidence.
ACTION_BIAS = """CASE WHEN risk_score > 70 THEN '降低仓位风险' WHEN quality = 'low' THEN '观望（回测未验证规则有效性）' WHEN up1 > down1 + 15 AND confidence IN ('高', '中') THEN '偏积极' WHEN down1 > up1 + 15 THEN '偏谨慎' ELSE '观望' END"""
QUALITY = "CASE WHEN usable = 0 THEN 'low' WHEN usable >= CASE WHEN trained THEN 2 ELSE 3 END THEN 'high' ELSE 'medium' END"


def predictions(s: DataFrame, present: DataFrame) -> DataFrame:
    """PRD-2, PRD-6: one row for each code and horizon of the present: calibrated probability, confidence, direction and label.

    A horizon with fewer samples than MIN_SAMPLES is judged by nothing: its probability is the raw one, its direction open.
    """
    keys = list(pred.KEYS)
    figures = pred.binary_metrics(s).select(*keys, "n", "hit", "edge", "brier")
    enough = F.col("n") >= MIN_SAMPLES
    figures = figures.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("hit", "edge", "brier")])
    sweep = pred.threshold_sweep(s).select(*keys, "threshold", "signals", F.col("hit").alias("selective_hit"), F.col("edge").alias("selective_edge"))
    judged = figures.join(pred.kernel_calibration(s, present).select(*keys, "calibrated"), keys).join(sweep, keys)
    judged = judged.select(*keys, "n", "hit", "edge", "brier", *[F.when(enough, F.col(c)).alias(c) for c in ("calibrated", "threshold", "signals", "selective_hit", "selective_edge")])
    joined = present.select(*keys, F.col("probability").alias("now")).join(judged, keys, "left")
    joined = joined.withColumns({"n": F.coalesce("n", F.lit(0)), "calibrated": F.coalesce("calibrated", "now")})
    return apply_stages(joined, STAGES).select(*keys, "n", "hit", "edge", "brier", "calibrated", "passes", "confidence", "direction", "label", "usable", "signals", "selective_hit", "selective_edge")


def by_horizon(p: DataFrame, horizons=(7, 30)) -> DataFrame:
    """Predictions as one row for each code, with the columns that the decision tables ask for."""
    columns = {"dir": F.col("direction"), "conf": F.col("confidence"), "edge_value": F.col("edge"), "edge": F.coalesce((F.col("edge") > 0) | (F.col("passes") & (F.col("selective_edge") > 0)), F.lit(False)), "hit": F.col("hit"), "passes": F.col("passes"), "selective_hit": F.col("selective_hit"), "selective_n": F.col("signals"), "selective_edge": F.col("selective_edge")}
    return p.groupBy("code").agg(*[F.max(F.when(F.col("horizon") == h, x)).alias(f"{name}_{h}d") for h in horizons for name, x in columns.items()])


def prediction_quality(p: DataFrame) -> DataFrame:
    """PRD-1, JOIN-10: quality by code, from its usable horizons; trained codes need fewer."""
    out = p.groupBy("code").agg(F.count_if("usable").alias("usable"), F.sum("n").alias("samples")).withColumn("trained", F.col("code").isin(*pred.TRAINED_CODES))
    return out.withColumn("quality", F.expr(QUALITY))


def batch_report(q: DataFrame, known: DataFrame) -> DataFrame:
    """SNK-7: one row for a whole batch of codes: how many there are of each quality, and how many have failed.

    q: prediction_quality; known: all codes of the batch (see indicators.summary), of which those without a prediction failed.
    """
    rows = known.select("code").join(q.select("code", "quality"), "code", "left")
    return rows.agg(F.count("*").alias("codes"), *[F.count_if(F.col("quality") == x).alias(f"n_{x}") for x in ("high", "medium", "low")], F.count_if(F.col("quality").isNull()).alias("n_failed"))


def with_failures(docs: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """SNK-5: one row for each code of a batch, its document or the reason why it has none: code, document, error."""
    reason = F.concat(F.lit("历史净值样本不足（"), F.col("data_days").cast("string"), F.lit(f" 条，至少 {least} 条）"))
    return known.select("code", "data_days").join(docs, "code", "left").select("code", "document", F.when(F.col("document").isNull(), reason).alias("error"))


def documents(p: DataFrame) -> DataFrame:
    """SNK-4: one JSON document for each code, with a struct for each horizon; figures are rounded as they are shown."""
    shown = [F.round("calibrated", 4).alias("calibrated"), "confidence", "direction", "label", F.round("edge", 2).alias("edge"), F.round("brier", 4).alias("brier")]
    period = F.struct("n", *shown)
    periods = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.col("horizon").cast("string"), F.lit("d")).alias("key"), period.alias("value")))))
    return p.groupBy("code").agg(periods.alias("periods")).select("code", F.to_json(F.struct("code", "periods", F.lit("仅供个人研究参考，不构成投资建议。").alias("disclaimer"))).alias("document"))


#: What a document tells of a code's metrics and risk.
TOLD_METRICS = ("ret_7d", "ret_30d", "ret_90d", "dd_30", "dd_90", "vol_30", "sharpe_30", "pos_30", "rsi_14", "ma_20", "trend", "regime", "macd_cross", "streak_dir", "streak_days")
TOLD_RISK = ("risk_score", "risk_level", "risk_colour", *dec.RISK_PARTS)


#: What a document tells of advice and of the final decision.
TOLD_ADVICE = {"action": "advice", "label": "advice_label", "confidence": "advice_confidence", "buy_pct": "buy_pct", "buy_amount": "buy_amount", "summary": "advice_summary", "position_hint": "position_hint", "reasons": "advice_reasons", "warnings": "advice_warnings", "buy_conditions": "buy_conditions", "sell_conditions": "sell_conditions", "invalidation_signals": "invalidation_signals"}
TOLD_FINAL = {"headline": "headline", "summary": "final_summary", "direction": "final_direction", "direction_label": "direction_label", "action": "final_action", "action_label": "action_label", "confidence": "final_confidence", "why": "why", "watch": "watch", "warning": "warning"}
#: What is taken of a code that no backtest has tested: quality, calibration and predictions.
UNTESTED = {"quality": ("string", "'low'"), "calibrated": ("boolean", "FALSE"), "pred_quality": ("string", "'low'"), **{f"dir_{h}": ("string", "'uncertain'") for h in ("7d", "30d")}, **{f"conf_{h}": ("string", "'低'") for h in ("7d", "30d")}, **{f"edge_{h}": ("boolean", "FALSE") for h in ("7d", "30d")}, **{f"edge_value_{h}": ("double", "NULL") for h in ("7d", "30d")}}


def tested(samples: DataFrame, now: DataFrame) -> DataFrame:
    """What backtest and predictions say of each code that has samples: code and the columns of UNTESTED."""
    predicted = predictions(samples, now)
    quality_of = prediction_quality(predicted).select("code", F.col("quality").alias("pred_quality"))
    out = by_horizon(predicted).join(quality_of, "code", "left").join(bt.quality(samples).select("code", "quality", "calibrated"), "code", "left")
    return out.select("code", *UNTESTED)


def analyse(panel: DataFrame, context: DataFrame, judged_by: DataFrame | None = None) -> DataFrame:
    """SNK-4, SNK-5: one row for each code of a panel, however short its history: code, data_days, success, error, document.

    document holds metrics and risk of the code's last row, a forecast by horizon with its reasons and triggers (an empty one where the history is
    too short for it), support, advice and the final decision; it is null where error says why there is none. The panel is one job, and a code that
    fails takes nothing from others. context has a row for each code with its kind, market and position, or none; judged_by (see tested) a
    row for each code with a backtest; the others are taken as UNTESTED.
    """
    rows = calendar.newest_metrics(panel, least=1, more=(F.min("d").alias("data_start"),))
    base = dec.with_risk(dec.with_kinds(calendar.neutral(rows).join(context, "code", "left"))).drop(*UNTESTED)
    base = base.withColumns({c: F.lit(None).cast(t) for c, (t, _) in UNTESTED.items()}) if judged_by is None else base.join(judged_by, "code", "left")
    base = base.withColumns({c: F.coalesce(c, F.expr(f"CAST({v} AS {t})")) for c, (t, v) in UNTESTED.items()})
    # a code's row goes through the aggregation of its horizons beside one of them, so it is made once
    base = base.withColumn("_row", F.struct(*[c for c in base.columns if c != "code"]))
    said = texts.forecast_texts(dec.forecast(base))
    period = F.struct("gate", F.col("direction2").alias("direction"), "rise_fall", F.col("up1").alias("up"), F.col("side2").alias("sideways"), F.col("down1").alias("down"), "confidence", "range_low", "range_high", "reasons", "up_triggers", "down_triggers")
    entry = F.struct(F.concat(F.col("horizon").cast("string"), F.lit("d")), period)
    words = {f"text_{h}d": F.max(F.when(F.col("horizon") == h, F.concat_ws(" ", "direction2", "rise_fall"))) for h in (7, 30)}
    row = F.first(F.when(F.col("horizon") == 7, F.col("_row")), ignorenulls=True)
    decided = said.groupBy("code").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("forecast"), row.alias("_row"), *texts.support_sums(), *[x.alias(n) for n, x in words.items()])
    decided = decided.select("code", "forecast", *words, F.struct(*texts.support_columns()).alias("decision_support"), "_row.*")
    warned = {f"warning_{h}": F.expr(texts.PREDICTION_WARNING.format(edge=f"edge_value_{h}", confidence=f"conf_{h}")) for h in ("7d", "30d")}
    decided = texts.advice_texts(dec.apply_stages(decided.withColumns(warned), dec.ADVICE_STAGES))
    decided = texts.final_texts(dec.apply_stages(decided, dec.FINAL_STAGES))
    part = lambda told: F.struct(*[F.col(c).alias(n) for n, c in told.items()])
    parts = {"metrics": F.struct(*TOLD_METRICS), "risk": F.struct(*TOLD_RISK), "forecast": F.col("forecast"), "decision_support": F.col("decision_support"), "advice": part(TOLD_ADVICE), "final": part(TOLD_FINAL)}
    out = decided.select("code", *summary_columns(F.col("i") + 1, F.col("data_start"), F.col("d"), F.col("nav")), *[x.alias(n) for n, x in parts.items()])
    document = F.when(F.col("error").isNull(), F.struct("code", "data_start", "data_end", "latest_nav", *parts, F.lit("仅供个人研究参考，不构成投资建议。").alias("disclaimer")))
    return out.select("code", "data_days", F.col("error").isNull().alias("success"), "error", document.alias("document"))
