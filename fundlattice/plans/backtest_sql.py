"""Backtest and up-probability queries in SQL for the comparison engine."""

from __future__ import annotations

from fundlattice.operators.backtest import BUCKETS, LABELS
from fundlattice.operators.prediction import DEFAULT_THRESHOLDS, FEATURES, MIN_SIGNALS, MIN_VALIDATION
from fundlattice.plans.indicator_sql import with_nav
from fundlattice.plans.walkforward_sql import FEATURE_CTES, with_samples

FEATURE_DOUBLES = "nav ret_1 ret_5 ret_30d ret_90d ma_5 ma_60 dd_30 dd_90 vol_30 vol_60 down_30 sharpe_30 pos_7 pos_90 rebound_30 pullback_7 rsi_6 rsi_14 bb_pos bb_width skew accel ewma pct calmar_60 win_30 macd_hist"
FEATURE_LABELS = "macd_cross macd_dir regime trend streak_days streak_dir"
WALKFORWARD_FEATURES = with_nav(f"SELECT code, i, {', '.join(FEATURE_DOUBLES.split() + FEATURE_LABELS.split())} FROM fx", *FEATURE_CTES)
LABEL_COLUMNS = "code horizon i market prediction actual momentum"
LABELS_SQL = with_samples("SELECT code, horizon, i, market, prediction, actual, momentum, threshold, ret, raw_score, score FROM smp")
CONFUSION = with_samples("SELECT code, horizon, " + ", ".join(f"count(*) FILTER (prediction = '{p}' AND actual = '{a}') AS {p}_{a}" for p in LABELS for a in LABELS) + " FROM smp GROUP BY 1, 2")
DISTRIBUTION = with_samples("SELECT code, horizon, " + ", ".join(f"avg((actual = '{a}')::DOUBLE) * 100 AS {a}_pct" for a in LABELS) + ", avg(threshold) AS threshold_mean, median(threshold) AS threshold_median FROM smp GROUP BY 1, 2")
_C = "(0.35::DOUBLE + 0.30::DOUBLE * least(abs(raw_score), 80) / 80)"
_BRIER = f"""least(1, greatest(0, avg(CASE WHEN prediction = actual THEN pow({_C} - 1, 2) + 2 * pow((1 - {_C}) / 2, 2) ELSE pow({_C}, 2) + pow((1 - {_C}) / 2 - 1, 2) + pow((1 - {_C}) / 2, 2) END) / 2))"""
BRIER = with_samples(f"SELECT code, horizon, {_BRIER} AS brier, count(*) AS n FROM smp GROUP BY 1, 2")


def _bucket(x: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN {k}" for k, (lo, hi) in enumerate(zip(edges, edges[1:]))) + " END"


CALIBRATION = with_samples(
    f"""SELECT code, horizon, bin, avg({_C}) AS expected, avg((prediction = actual)::DOUBLE) AS observed, count(*) AS n, abs(avg({_C}) - avg((prediction = actual)::DOUBLE)) AS gap
    FROM (SELECT *, {_bucket('abs(raw_score)', (0, 20, 40, 60, 80, 200))} AS bin FROM smp) WHERE bin IS NOT NULL GROUP BY 1, 2, 3"""
)
HIT_BY_MOVE = with_samples(
    """SELECT code, horizon, avg(CASE WHEN size = 'high' THEN hit END) * 100 AS hit_high, avg(CASE WHEN size = 'medium' THEN hit END) * 100 AS hit_medium, avg(CASE WHEN size = 'low' THEN hit END) * 100 AS hit_low
    FROM (SELECT s.code, s.horizon, (prediction = actual)::DOUBLE AS hit, CASE WHEN abs(ret) >= hi THEN 'high' WHEN abs(ret) <= lo THEN 'low' ELSE 'medium' END AS size FROM smp s JOIN q ON s.code = q.code AND s.horizon = q.horizon WHERE n >= 10) GROUP BY 1, 2""",
    "q AS (SELECT code, horizon, quantile_cont(abs(ret), 0.75) AS hi, quantile_cont(abs(ret), 0.25) AS lo, count(*) AS n FROM smp GROUP BY 1, 2)",
)
RETURN_STATS = with_samples("SELECT code, horizon, avg(ret) AS mean, median(ret) AS median, quantile_cont(ret, 0.1) AS p10, quantile_cont(ret, 0.9) AS p90 FROM smp GROUP BY 1, 2")
SCORE_BUCKETS = with_samples(
    f"""SELECT code, horizon, bucket, n, accuracy, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY code, horizon) * 100 AS pct FROM
    (SELECT code, horizon, {_bucket('raw_score', BUCKETS)} AS bucket, count(*) AS n, avg((prediction = actual)::DOUBLE) * 100 AS accuracy FROM smp GROUP BY 1, 2, 3)"""
)
SCORE_STATS = with_samples("SELECT code, horizon, avg(raw_score) AS mean, stddev_pop(raw_score) AS std, quantile_cont(raw_score, 0.1) AS p10, quantile_cont(raw_score, 0.5) AS p50, quantile_cont(raw_score, 0.9) AS p90 FROM smp GROUP BY 1, 2")
_BASE = """b AS (SELECT code, horizon, count(*) AS n, avg((prediction = actual)::DOUBLE) * 100 AS rule_acc, avg((actual = 'sideways')::DOUBLE) * 100 AS sideways_acc, avg((momentum = actual)::DOUBLE) * 100 AS momentum_acc FROM smp GROUP BY 1, 2)"""
BASELINE = with_samples("SELECT *, rule_acc - greatest(sideways_acc, momentum_acc) AS edge FROM b", _BASE)
DOWN = with_samples(
    """SELECT horizon, avg(precision) AS precision, avg(coalesce(recall, 0)) AS recall, avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END) AS f1, count(*) AS codes FROM
    (SELECT code, horizon, CASE WHEN p > 0 THEN tp * 100.0::DOUBLE / p END AS precision, CASE WHEN a > 0 THEN tp * 100.0::DOUBLE / a END AS recall FROM
     (SELECT code, horizon, count(*) FILTER (prediction = 'down' AND actual = 'down') AS tp, count(*) FILTER (prediction = 'down') AS p, count(*) FILTER (actual = 'down') AS a FROM smp GROUP BY 1, 2)) GROUP BY horizon"""
)
QUALITY = with_samples(
    """SELECT code, periods, total, good, strong, q AS quality, NOT low AND (sideways > 80 OR q <> 'low') AS calibrated FROM
    (SELECT *, CASE WHEN low THEN 'low' WHEN sideways > 80 THEN CASE WHEN strong * 2 >= periods AND total >= 60 THEN 'medium' ELSE 'low' END
       WHEN strong * 2 > periods AND total >= 120 THEN 'high' WHEN good >= 2 AND total >= 60 THEN 'medium' ELSE 'low' END AS q FROM
     (SELECT *, periods < 2 OR total < 30 OR worst > 0.4 OR good = 0 AS low FROM
      (SELECT b.code, count(*) AS periods, sum(b.n)::BIGINT AS total, count(*) FILTER (rule_acc - greatest(sideways_acc, momentum_acc) >= 0) AS good,
         count(*) FILTER (rule_acc - greatest(sideways_acc, momentum_acc) > 3) AS strong, max(brier) AS worst, max(sideways_acc) AS sideways
       FROM b JOIN br ON b.code = br.code AND b.horizon = br.horizon WHERE b.n >= 10 GROUP BY b.code)))""",
    _BASE,
    f"br AS (SELECT code, horizon, {_BRIER} AS brier FROM smp GROUP BY 1, 2)",
)
UP_PROBABILITY = with_samples("SELECT code, horizon, i, adjusted, probability, prev_return, up, momentum_up FROM smp")
_BIN = """bm AS (SELECT *, greatest(up_rate, 100 - up_rate) AS majority_hit, hit - greatest(up_rate, 100 - up_rate, momentum_hit) AS edge FROM
  (SELECT code, horizon, count(*) AS n, avg(((probability >= 0.5) = up)::DOUBLE) * 100 AS hit, avg(up::DOUBLE) * 100 AS up_rate, avg((momentum_up = up)::DOUBLE) * 100 AS momentum_hit, avg(pow(probability - up::DOUBLE, 2)) AS brier FROM smp GROUP BY 1, 2))"""
BINARY = with_samples("SELECT * FROM bm", _BIN)
KERNEL = with_samples(
    """SELECT code, horizon, now, base, n_near, CASE WHEN n_near >= 12 THEN 0.65 * (seen * n_near + base * 8) / (n_near + 8) + 0.35 * now ELSE 0.5 * weighted + 0.3 * now + 0.2 * base END AS calibrated FROM
    (SELECT s.code, s.horizon, any_value(now) AS now, avg(up::DOUBLE) AS base, count(*) FILTER (abs(probability - now) <= 0.08) AS n_near, avg(up::DOUBLE) FILTER (abs(probability - now) <= 0.08) AS seen,
       sum(up::DOUBLE / (abs(probability - now) + 0.05)) / sum(1 / (abs(probability - now) + 0.05)) AS weighted
     FROM smp s JOIN (SELECT code, horizon, probability AS now FROM now) l ON s.code = l.code AND s.horizon = l.horizon GROUP BY 1, 2)"""
)
_DEFAULT = "CASE horizon " + " ".join(f"WHEN {h} THEN {t}::DOUBLE" for h, t in DEFAULT_THRESHOLDS.items()) + " END"
SWEEP = with_samples(
    f"""SELECT bm.code, bm.horizon, coalesce(x.t, d.t) AS threshold, coalesce(x.signals, d.signals) AS signals, coalesce(x.hit, d.hit) AS hit, coalesce(x.hit, d.hit) - greatest(up_rate, momentum_hit) AS edge, x.t IS NOT NULL AS valid
    FROM bm LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, horizon ORDER BY hit DESC, signals DESC, k) AS rk FROM
        (SELECT c.code, c.horizon, k, 0.55::DOUBLE + k * 0.01::DOUBLE AS t, count(*) AS signals, avg(up::DOUBLE) * 100 AS hit, any_value(greatest(b.up_rate, b.momentum_hit)) AS base
         FROM smp c JOIN bm b ON c.code = b.code AND c.horizon = b.horizon JOIN range(21) g(k) ON floor((c.probability - 0.55::DOUBLE) / 0.01::DOUBLE + 1e-9) >= k GROUP BY 1, 2, 3, 4)
        WHERE signals >= 20 AND hit >= 60 AND hit - base >= 3) WHERE rk = 1) x ON bm.code = x.code AND bm.horizon = x.horizon
    JOIN (SELECT code, horizon, {_DEFAULT} AS t, count(*) FILTER (probability >= {_DEFAULT}) AS signals, avg(up::DOUBLE) FILTER (probability >= {_DEFAULT}) * 100 AS hit FROM smp GROUP BY 1, 2) d ON bm.code = d.code AND bm.horizon = d.horizon""",
    _BIN,
)
FOLDS_SQL = with_samples(
    """SELECT code, horizon, fold, count(*) AS n, min(i) AS first_i, max(i) AS last_i, count(*) FILTER (train) AS n_train, avg(((probability >= 0.5) = up)::DOUBLE) * 100 AS hit FROM
    (SELECT *, ntile(4) OVER (PARTITION BY code, horizon ORDER BY i) AS fold, row_number() OVER (PARTITION BY code, horizon ORDER BY i) <= count(*) OVER (PARTITION BY code, horizon) - ceil(count(*) OVER (PARTITION BY code, horizon) * 0.3::DOUBLE) AS train FROM smp)
    GROUP BY 1, 2, 3"""
)
