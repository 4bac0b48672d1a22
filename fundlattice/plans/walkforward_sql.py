"""Walk-forward features and samples in SQL for the comparison engine; rules come from the scoring tables."""

from __future__ import annotations

from fundlattice.operators import scoring
from fundlattice.operators.walkforward import FALLBACK_VOL, FLOORS
from fundlattice.plans.indicator_sql import MACD_B_COLUMNS, MACD_B_STATES, OVER, TREND_B_CASE, rows, with_nav


def r(x: str, places: int = 2) -> str:
    return f"floor(({x}) * {10**places} + 0.5) / {10**places}"


def lag(k: int) -> str:
    return f"lag(nav, {k}) {OVER}"


def _dd(n: int) -> str:
    return f"""s{n} AS (SELECT code, i, present, max((pk - nav) / pk) * 100 AS dd FROM (SELECT a.code, a.i, a.present, b.nav, max(b.nav) OVER (PARTITION BY a.code, a.i, a.present ORDER BY b.i) AS pk
      FROM lk a JOIN nav b ON a.code = b.code AND b.i > a.i - least({n}, look) AND b.i <= a.i) GROUP BY code, i, present)"""


def _within(f: str) -> str:
    """f over 40 returns, or over the 39 that a lookback of 40 rows holds."""
    return f"(CASE WHEN look > 40 THEN {f.format(rows(40))} ELSE {f.format(rows(39))} END)"


_POS = "CASE WHEN max(nav) {0} = min(nav) {0} THEN 50 ELSE (nav - min(nav) {0}) / (max(nav) {0} - min(nav) {0}) * 100 END"
_RSI = "CASE WHEN l{0} = 0 THEN CASE WHEN g{0} > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g{0} / l{0}) END"
_WINDOWS = ", ".join(
    [f"{r(f'CASE WHEN look > {k} THEN (nav / {lag(k)} - 1) * 100 ELSE 0 END')} AS {name}" for name, k in (("ret_1", 1), ("ret_5", 5), ("ret_20", 20), ("ret_7d", 5), ("ret_30d", 20), ("ret_60d", 40), ("ret_90d", 60))]
    + [f"CASE WHEN look >= {k} THEN {r(f'avg(nav) {rows(k)}', 4)} END AS ma_{k}" for k in (5, 10, 20, 60)]
    + [r(f"stddev_samp(r) {rows(20)} * sqrt(250) * 100") + " AS vol_30", r(_within("stddev_samp(r) {}") + " * sqrt(250) * 100") + " AS vol_60"]
    + [r(f"CASE WHEN count(r) FILTER (r < 0) {rows(20)} < 2 THEN 0 ELSE stddev_samp(r) FILTER (r < 0) {rows(20)} * sqrt(250) * 100 END") + " AS down_30"]
    + [r(f"CASE WHEN {s} = 0 THEN 0 ELSE {m} / {s} * sqrt(250) END") + f" AS {name}" for name, s, m in (("sharpe_30", f"stddev_samp(r) {rows(20)}", f"avg(r) {rows(20)}"), ("sharpe_60", _within("stddev_samp(r) {}"), _within("avg(r) {}")))]
    + [f"{r(_POS.format(rows(n)), 1)} AS {name}" for name, n in (("pos_7", 5), ("pos_30", 20), ("pos_60", 40))]
    + [f"{r(f'(nav - min(nav) {rows(n)}) / min(nav) {rows(n)} * 100')} AS {name}" for name, n in (("rebound_7", 5), ("rebound_30", 20))]
    + [f"{r(f'(max(nav) {rows(n)} - nav) / max(nav) {rows(n)} * 100')} AS {name}" for name, n in (("pullback_7", 5), ("pullback_30", 20))]
    + [f"sum(greatest(c, 0)) {rows(w)} AS g{w}, sum(greatest(-c, 0)) {rows(w)} AS l{w}" for w in (6, 14)]
    + [f"avg(nav) {rows(20)} AS mid, stddev_samp(nav) {rows(20)} AS dev"]
    + [f"CASE WHEN look > 40 THEN list(r) {rows(40)} ELSE list(r) {rows(39)} END AS r40, list(r) {rows(20)} AS r20"]
    + [r(f"(nav / {lag(2)} - 1) * 100 - ({lag(3)} / {lag(5)} - 1) * 100") + " AS accel"]
    + [_within("avg(r) {}") + " AS mean_40"]
    + [r(f"CAST(count(r) FILTER (r > 0) {rows(20)} AS DOUBLE) / 20 * 100", 1) + " AS win_30"]
    + [f"stddev_pop(r) {rows(30)} AS vol_pop_30"]
    + [f"avg(nav) {rows(k)} AS raw_{k}" for k in (5, 10, 20)]
    + [f"(nav - {lag(4)}) / {lag(4)} * 100 AS slope, ({lag(9)} - {lag(19)}) / {lag(19)} * 100 AS long_slope"]
    + [f"lead(nav, {h + 1}) {OVER} AS after_{h}, (nav / {lag(h)} - 1) * 100 AS prev_{h}" for h in scoring.HORIZONS]
)
FEATURE_CTES = (
    "cn AS (SELECT *, nav - lag(nav) OVER (PARTITION BY code ORDER BY i) AS c, count(*) OVER (PARTITION BY code) AS n FROM nav)",
    # each row with its code's lookback, and each code's last row again with all rows before it
    "cl AS (SELECT *, least(90, greatest(40, n // 2)) AS look, FALSE AS present FROM cn WHERE n >= 60 UNION ALL BY NAME SELECT *, n AS look, TRUE AS present FROM cn WHERE n >= 60)",
    "lk AS (SELECT code, i, look, present FROM cl WHERE i >= look - 1)",
    f"w1 AS (SELECT code, d, i, nav, look, present, {_WINDOWS} FROM cl)".replace("PARTITION BY code ORDER", "PARTITION BY code, present ORDER"),
    *map(_dd, (20, 40, 60)),
    """e AS (SELECT a.code, a.i, a.present, min(b.nav) FILTER (b.i > a.i - least(60, look)) AS lo, max(b.nav) FILTER (b.i > a.i - least(60, look)) AS hi, avg(b.r) FILTER (b.i > a.i - least(60, look - 1)) AS mean_60,
      stddev_pop(b.r) FILTER (b.i > a.i - look + 1) AS vol_pop, list(b.nav ORDER BY b.i) AS h FROM lk a JOIN nav b ON a.code = b.code AND b.i > a.i - look AND b.i <= a.i GROUP BY a.code, a.i, a.present)""",
    f"v AS (SELECT code, d, i, CASE WHEN i >= 20 THEN stddev_samp(r) {rows(20)} END AS v FROM nav)",
    f"""pc AS (SELECT a.code, a.i, lk.present, {r("CAST(count(*) FILTER (b.v < a.v) AS DOUBLE) / count(b.v) * 100", 1)} AS pct FROM lk JOIN v a ON lk.code = a.code AND lk.i = a.i JOIN v b ON a.code = b.code AND b.i > a.i - look + 20 AND b.i <= a.i GROUP BY a.code, a.i, lk.present)""",
    f"""st AS (SELECT code, i, CASE WHEN s = 0 THEN 0 ELSE row_number() OVER (PARTITION BY code, isl ORDER BY i) END AS streak_days, CASE WHEN s > 0 THEN '上涨' WHEN s < 0 THEN '下跌' ELSE '平' END AS streak_dir
      FROM (SELECT *, sum(CASE WHEN s IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY i) AS isl FROM (SELECT *, lag(s) OVER (PARTITION BY code ORDER BY i) AS ps FROM (SELECT code, i, sign(r) AS s FROM nav WHERE i >= 1))))""",
    MACD_B_STATES.replace("code, d, i,", "code, i, present,").replace("FROM hist", "FROM e"),
    f"mm AS (SELECT code, i, present, {MACD_B_COLUMNS} FROM mb)",
    f"""fa AS (SELECT w1.*, vol_pop, {r("s20.dd")} AS dd_30, {r("s40.dd")} AS dd_60, {r("s60.dd")} AS dd_90, {r("CASE WHEN hi = lo THEN 50 ELSE (nav - lo) / (hi - lo) * 100 END", 1)} AS pos_90, {r(_RSI.format(6), 1)} AS rsi_6, {r(_RSI.format(14), 1)} AS rsi_14,
      {r("greatest(0, least(100, CASE WHEN dev = 0 THEN 50 ELSE (nav - (mid - dev * 2)) / (dev * 4) * 100 END))", 1)} AS bb_pos, {r("dev * 4 / mid * 100")} AS bb_width,
      {r("list_sum(list_transform(r40, lambda x: pow(x - list_avg(r40), 3))) / (len(r40) * pow(list_stddev_samp(r40), 3))")} AS skew,
      {r("sqrt(list_reduce(list_prepend(r20[1] * r20[1], r20[2:]), lambda s, v: 0.94 * s + 0.06 * v * v)) * sqrt(250) * 100")} AS ewma,
      pct, {r(f"CASE WHEN {r('s40.dd')} = 0 THEN 0 ELSE mean_40 * 250 * 100 / ({r('s40.dd')}) END")} AS calmar_60, {r(f"CASE WHEN {r('s60.dd')} = 0 THEN 0 ELSE mean_60 * 250 * 100 / ({r('s60.dd')}) END")} AS calmar_90,
      streak_days, streak_dir, {r("histogram", 6)} AS macd_hist, crossover AS macd_cross, direction AS macd_dir,
      CASE WHEN pct > 75 THEN '高波动' WHEN pct < 25 THEN '低波动' ELSE '正常' END AS regime, {TREND_B_CASE} AS trend
      FROM w1 JOIN s20 USING (code, i, present) JOIN s40 USING (code, i, present) JOIN s60 USING (code, i, present) JOIN e USING (code, i, present) JOIN pc USING (code, i, present) JOIN st USING (code, i) JOIN mm USING (code, i, present))""",
    "fx AS (SELECT * FROM fa WHERE NOT present)",
)
_SIGMA = f"(CASE WHEN coalesce(vol_pop, 0) > 0 THEN vol_pop ELSE {FALLBACK_VOL!r}::DOUBLE END)"
MARKET = f"""CASE WHEN {_SIGMA} * sqrt(250) * 100 > 35 THEN 'high_volatility'
  WHEN abs(slope) > 0.3 AND ((raw_5 > raw_10 AND raw_10 > raw_20 AND ((slope > 0 AND long_slope > -0.5) OR (slope < 0 AND long_slope < 0.5))) OR (raw_5 < raw_10 AND raw_10 < raw_20)) THEN 'trending'
  WHEN abs(raw_5 - raw_20) / raw_20 * 100 < 1 OR (abs(raw_5 - raw_20) / raw_20 * 100 < 2 AND ((100 - 100 / (1 + g14 / (CASE WHEN l14 > 0 THEN l14 ELSE 1e-10 END))) < 25 OR (100 - 100 / (1 + g14 / (CASE WHEN l14 > 0 THEN l14 ELSE 1e-10 END))) > 75)) THEN 'mean_reverting'
  ELSE 'trending' END"""
_LABEL = "CASE WHEN {0} > threshold THEN 'up' WHEN {0} < -threshold THEN 'down' ELSE 'sideways' END"
_BY_HORIZON = lambda f: "CASE " + " ".join(f"WHEN horizon = {h} THEN {f(h)}" for h in scoring.HORIZONS) + " END"
_UNION = " UNION ALL ".join(
    f"SELECT *, {h} AS horizon, {scoring.direction_score(h)} AS score, after_{h} AS after, prev_{h} AS prev_return, least(20e0, greatest({FLOORS[h]}e0, {_SIGMA} * sqrt({h}::DOUBLE) * 100)) AS threshold FROM mk WHERE present OR after_{h} IS NOT NULL" for h in scoring.HORIZONS
)
SAMPLE_CTES = (
    *FEATURE_CTES,
    f"mk AS (SELECT *, {MARKET} AS market FROM fa)",
    f"u AS ({_UNION})",
    f"""u2 AS (SELECT *, CASE WHEN market = 'mean_reverting' AND rsi_14 < 30 THEN score + 8 WHEN market = 'mean_reverting' AND rsi_14 > 70 THEN score - 8 WHEN market = 'high_volatility' THEN score * 0.75 ELSE score END AS raw_score,
      (after - nav) / nav * 100 AS ret, {_BY_HORIZON(scoring.binary_score)} AS adjusted FROM u)""",
    f"u3 AS (SELECT *, {_BY_HORIZON(lambda h: scoring.up_probability(h, days='look'))} AS probability FROM u2)",
    f"""smp AS (SELECT * REPLACE (i + 1 AS i), CASE WHEN raw_score >= 12 THEN 'up' WHEN raw_score <= -12 THEN 'down' ELSE 'sideways' END AS prediction, {_LABEL.format('ret')} AS actual,
      {_LABEL.format('prev_return')} AS momentum, ret > 0 AS up, prev_return > 0 AS momentum_up FROM u3 WHERE NOT present)""",
    "now AS (SELECT * FROM u3 WHERE present)",
)


def with_samples(select: str, *more: str) -> str:
    return with_nav(select, *SAMPLE_CTES, *more)
