"""The indicator queries in SQL for the comparison engine, written on its own terms (self-joins, list folds)."""

from __future__ import annotations

from fundlattice.sources.panel import NAV_SQL

OVER = "OVER (PARTITION BY code ORDER BY d)"


def with_nav(select: str, *more: str) -> str:
    return f"WITH {NAV_SQL.strip()}{''.join(', ' + m for m in more)} {select}"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def days(n: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY d RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND CURRENT ROW)"


def or_tail(n: int, least: int, agg: str, cond: str = "") -> str:
    return f"(CASE WHEN count(nav) {days(n)} < {least} THEN {agg} {cond} {rows(max(least, n // 2))} ELSE {agg} {cond} {days(n)} END)"


def segment_dd(n_rows: int | None, n_days: int | None = None) -> str:
    """Largest falls by a self-join and a running maximum, with the short-window rule of the calendar family."""
    if n_rows:
        on = f"b.i BETWEEN a.i - {n_rows - 1} AND a.i"
    else:
        on = f"b.i <= a.i AND CASE WHEN a.cnt < 3 THEN b.i > a.i - {max(3, n_days // 2)} ELSE b.d >= a.d - INTERVAL {n_days} DAYS END"
    count = f", count(nav) {days(n_days)} AS cnt" if n_days else ""
    return f"""(SELECT code, i, max((pk - nav) / pk) AS dd FROM (
      SELECT a.code, a.i, b.nav, max(b.nav) OVER (PARTITION BY a.code, a.i ORDER BY b.i) AS pk
      FROM (SELECT *{count} FROM nav) a JOIN nav b ON a.code = b.code AND {on}) GROUP BY code, i)"""


RETURNS_TRADING = with_nav(
    "SELECT code, d, i, "
    + ", ".join(
        f"CASE WHEN i >= 1 THEN (nav / coalesce(lag(nav, {k}) {OVER}, first_value(nav) {OVER}) - 1) * 100 END AS ret_{k}_a, CASE WHEN i >= {k} THEN (nav / lag(nav, {k}) {OVER} - 1) * 100 ELSE 0 END AS ret_{k}_b" for k in (1, 5, 10, 20, 60)
    )
    + " FROM nav"
)
RETURNS_CALENDAR = with_nav(
    "SELECT n.code, n.d, n.i, "
    + ", ".join(f"CASE WHEN n.i >= 2 THEN p{k}.d END AS start_{k}, CASE WHEN n.i >= 2 THEN (n.nav - p{k}.nav) / p{k}.nav * 100 END AS ret_{k}" for k in (7, 30, 60, 90))
    + " FROM nav n "
    + " ".join(f"ASOF LEFT JOIN nav p{k} ON n.code = p{k}.code AND n.d - INTERVAL {k} DAYS >= p{k}.d" for k in (7, 30, 60, 90))
)
_MAS = ", ".join(f"CASE WHEN i >= {k - 1} THEN avg(nav) {rows(k)} END AS ma_{k}" for k in (5, 10, 20, 60))
SMA_TREND = with_nav(
    """SELECT code, d, i, ma_5, ma_10, ma_20, ma_60, CASE WHEN i < 29 THEN '数据不足，无法判断趋势'
    WHEN nav > ma_5 AND ma_5 > ma_10 AND ma_10 > ma_20 AND ma_20 > ma_60 THEN '多头排列（上升趋势）'
    WHEN nav < ma_5 AND ma_5 < ma_10 AND ma_10 < ma_20 AND ma_20 < ma_60 THEN '空头排列（下降趋势）'
    WHEN nav > ma_20 AND ma_5 > ma_20 THEN '偏多震荡' WHEN nav < ma_20 AND ma_5 < ma_20 THEN '偏空震荡' ELSE '横盘整理' END AS trend FROM m""",
    f"m AS (SELECT code, d, i, nav, {_MAS} FROM nav)",
)
TREND_B_CASE = """CASE WHEN ma_60 IS NOT NULL AND ma_5 > ma_10 AND ma_10 > ma_20 AND ma_20 > ma_60 AND nav > ma_5 THEN '多头排列'
    WHEN ma_60 IS NOT NULL AND ma_5 < ma_10 AND ma_10 < ma_20 AND ma_20 < ma_60 AND nav < ma_5 THEN '空头排列'
    WHEN ma_60 IS NOT NULL AND ma_5 > ma_10 AND ma_20 > ma_60 THEN '偏多震荡' WHEN ma_60 IS NOT NULL AND ma_5 < ma_10 AND ma_20 < ma_60 THEN '偏空震荡'
    WHEN ma_5 > ma_10 AND nav > ma_5 THEN '偏多震荡' WHEN ma_5 < ma_10 AND nav < ma_5 THEN '偏空震荡' ELSE '横盘整理' END"""
MAS_4 = ", ".join(f"CASE WHEN i >= {k - 1} THEN floor(avg(nav) {rows(k)} * 10000 + 0.5) / 10000 END AS ma_{k}" for k in (5, 10, 20, 60))
TREND_B = with_nav(f"SELECT code, d, i, ma_5, ma_10, ma_20, ma_60, {TREND_B_CASE} AS trend FROM m", f"m AS (SELECT code, d, i, nav, {MAS_4} FROM nav)")


def _vol(n: int) -> str:
    enough = f"{or_tail(n, 5, 'count(r)')} >= 3"
    out = f"CASE WHEN {enough} THEN {or_tail(n, 5, 'stddev_samp(r)')} * sqrt(250) * 100 END AS vol_{n}"
    if n < 90:
        neg = "FILTER (r < 0)"
        out += f", CASE WHEN {enough} THEN CASE WHEN {or_tail(n, 5, 'count(r)', neg)} < 2 THEN 0 ELSE {or_tail(n, 5, 'stddev_samp(r)', neg)} * sqrt(250) * 100 END END AS down_{n}"
    return out


VOL_WINDOWS = with_nav(f"SELECT code, d, i, {', '.join(_vol(n) for n in (30, 60, 90))} FROM nav")
DRAWDOWN_CALENDAR = with_nav(
    "SELECT n.code, n.d, n.i, " + ", ".join(f"s{k}.dd * -100 AS dd_{k}" for k in (7, 30, 60, 90)) + " FROM nav n " + " ".join(f"JOIN {segment_dd(None, k)} s{k} ON n.code = s{k}.code AND n.i = s{k}.i" for k in (7, 30, 60, 90))
)
_DD = [(6, "dd_5_a", -100), (21, "dd_20_a", -100), (61, "dd_60_a", -100), (5, "dd_5_b", 100), (20, "dd_20_b", 100), (40, "dd_40_b", 100), (60, "dd_60_b", 100)]
DRAWDOWN_TRADING = with_nav(
    "SELECT n.code, n.d, n.i, "
    + ", ".join(f"CASE WHEN n.i >= {2 if f < 0 else 1} THEN s{j}.dd * {f} {'ELSE 0 ' if f > 0 else ''}END AS {name}" for j, (k, name, f) in enumerate(_DD))
    + " FROM nav n "
    + " ".join(f"JOIN {segment_dd(k)} s{j} ON n.code = s{j}.code AND n.i = s{j}.i" for j, (k, _, _) in enumerate(_DD))
)


def _pos(hi: str, lo: str) -> str:
    return f"CASE WHEN {hi} = {lo} THEN 50 ELSE (nav - {lo}) / ({hi} - {lo}) * 100 END"


RANGE_POSITION = with_nav(
    "SELECT code, d, i, "
    + ", ".join(f"{_pos(or_tail(n, 5, 'max(nav)'), or_tail(n, 5, 'min(nav)'))} AS pos_{n}_a" for n in (7, 30, 60, 90))
    + ", "
    + ", ".join(f"CASE WHEN i >= 1 THEN {_pos(f'max(nav) {rows(n)}', f'min(nav) {rows(n)}')} ELSE 50 END AS pos_{n}_b" for n in (5, 20, 40, 60))
    + " FROM nav"
)
REBOUND_PULLBACK = with_nav(
    "SELECT code, d, i, "
    + ", ".join(
        f"CASE WHEN count(nav) {days(n)} >= 5 THEN (nav - min(nav) {days(n)}) / min(nav) {days(n)} * 100 END AS rebound_{n}_a, CASE WHEN count(nav) {days(n)} >= 5 THEN (max(nav) {days(n)} - nav) / max(nav) {days(n)} * 100 END AS pullback_{n}_a" for n in (7, 30)
    )
    + ", "
    + ", ".join(f"CASE WHEN i >= 1 THEN (nav - min(nav) {rows(n)}) / min(nav) {rows(n)} * 100 ELSE 0 END AS rebound_{n}_b, CASE WHEN i >= 1 THEN (max(nav) {rows(n)} - nav) / max(nav) {rows(n)} * 100 ELSE 0 END AS pullback_{n}_b" for n in (5, 20))
    + " FROM nav"
)


def _calmar(n: int, j: str, b: bool) -> str:
    if b:
        return f"CASE WHEN n.i >= 2 AND {j}.dd > 0 THEN n.mean_{n} * 250 * 100 / ({j}.dd * 100) ELSE 0 END AS calmar_{n}_b"
    return f"CASE WHEN n.cnt_{n} >= 3 AND {j}.dd > 0 THEN abs(n.avg_{n} * 250 / {j}.dd) END AS calmar_{n}_a"


SHARPE_CALMAR = with_nav(
    "SELECT n.code, n.d, n.i, "
    + ", ".join(f"CASE WHEN n.cnt_{n} >= 5 THEN CASE WHEN n.std_{n} = 0 THEN 0 ELSE n.avg_{n} / n.std_{n} * sqrt(250) END END AS sharpe_{n}_a" for n in (30, 60))
    + f", {_calmar(60, 'a60', False)}, {_calmar(90, 'a90', False)}, {_calmar(40, 'b40', True)}, {_calmar(60, 'b60', True)} FROM x n "
    + " ".join(f"JOIN {segment_dd(None, k)} a{k} ON n.code = a{k}.code AND n.i = a{k}.i" for k in (60, 90))
    + " "
    + " ".join(f"JOIN {segment_dd(k)} b{k} ON n.code = b{k}.code AND n.i = b{k}.i" for k in (40, 60)),
    "x AS (SELECT *, "
    + ", ".join(f"{or_tail(n, 5, 'count(r)')} AS cnt_{n}, {or_tail(n, 5, 'avg(r)')} AS avg_{n}, {or_tail(n, 5, 'stddev_samp(r)')} AS std_{n}" for n in (30, 60, 90))
    + f", avg(r) {rows(40)} AS mean_40, avg(r) {rows(60)} AS mean_60 FROM nav)",
)
WIN_RATE = with_nav(
    "SELECT code, d, i, "
    + ", ".join(f"CASE WHEN count(r) {rows(n)} >= 3 THEN CAST(count(r) FILTER (r > 0) {rows(n)} AS DOUBLE) / count(r) {rows(n)} * 100 END AS win_{n}" for n in (20, 60))
    + ", "
    + ", ".join(f"CASE WHEN count(r) {rows(20)} >= 3 THEN {g}(r) {rows(20)} * 100 END AS day_{name}" for name, g in (("mean", "avg"), ("max", "max"), ("min", "min")))
    + f", CASE WHEN count(r) {rows(20)} >= 3 THEN count(r) FILTER (r > 0) {rows(20)} END AS up_days, CASE WHEN count(r) {rows(20)} >= 3 THEN count(r) FILTER (r < 0) {rows(20)} END AS down_days FROM nav"
)


def _lag(k: int) -> str:
    return f"lag(nav, {k}) {OVER}"


MOMENTUM = with_nav(
    f"""SELECT code, d, i, CASE WHEN i >= 10 THEN (nav / {_lag(5)} - {_lag(5)} / {_lag(10)}) * 100 END AS accel_a,
    CASE WHEN i >= 5 THEN (nav / {_lag(2)} - {_lag(3)} / {_lag(5)}) * 100 ELSE 0 END AS accel_b,
    CASE WHEN i >= 6 THEN (nav / {_lag(3)} - {_lag(3)} / {_lag(6)}) * 100 ELSE 0 END AS accel_c FROM nav"""
)


def fold(values: str, seed: str, step: str) -> str:
    return f"list_reduce(list_prepend({seed}, {values}[2:]), lambda s, v: {step})"


def _ewma(h: str) -> str:
    return f"sqrt({fold(h, f'{h}[1] * {h}[1]', '0.94 * s + 0.06 * v * v')}) * sqrt(250) * 100"


EWMA = with_nav(
    f"SELECT code, d, i, CASE WHEN len(a) >= 5 THEN {_ewma('a')} END AS ewma_a, CASE WHEN len(b) >= 2 THEN {_ewma('b')} ELSE 0 END AS ewma_b FROM h",
    f"h AS (SELECT code, d, i, list(r) FILTER (r IS NOT NULL) {rows(21)} AS a, list(r) FILTER (r IS NOT NULL) {rows(20)} AS b FROM nav)",
)
_REGIME = "CASE WHEN pct IS NULL THEN '未知' WHEN pct >= 75 THEN '高波动' WHEN pct <= 25 THEN '低波动' ELSE '常态波动' END"
VOL_PERCENTILE = with_nav(
    f"SELECT code, d, i, pct, {_REGIME} AS regime FROM p",
    f"v AS (SELECT code, d, i, CASE WHEN i >= 30 THEN stddev_samp(r) {rows(30)} END AS v FROM nav)",
    "p AS (SELECT a.code, a.d, a.i, CASE WHEN a.i >= 40 THEN CAST(count(*) FILTER (b.v <= a.v) AS DOUBLE) / count(b.v) * 100 END AS pct FROM v a JOIN v b ON a.code = b.code AND b.i <= a.i GROUP BY a.code, a.d, a.i)",
)
VOL_PERCENTILE_B = with_nav(
    "SELECT code, d, i, pct, CASE WHEN pct > 75 THEN '高波动' WHEN pct < 25 THEN '低波动' ELSE '正常' END AS regime FROM p",
    f"v AS (SELECT code, d, i, CASE WHEN i >= 20 THEN stddev_samp(r) {rows(20)} END AS v FROM nav)",
    "p AS (SELECT a.code, a.d, a.i, CAST(count(*) FILTER (b.v < a.v) AS DOUBLE) / count(b.v) * 100 AS pct FROM v a JOIN v b ON a.code = b.code AND b.i BETWEEN a.i - 69 AND a.i WHERE a.i >= 89 GROUP BY a.code, a.d, a.i)",
)
STREAKS = with_nav(
    """SELECT b.code, b.d, b.i, CASE WHEN s > 0 THEN '上涨' WHEN s < 0 THEN '下跌' ELSE '平' END AS dir_b, CASE WHEN s = 0 THEN 0 ELSE run END AS days_b,
    CASE WHEN cnt < 2 THEN '未知' WHEN fs > 0 THEN '上涨' WHEN fs < 0 THEN '下跌' ELSE '平盘' END AS dir_a,
    CASE WHEN cnt < 2 THEN 0 ELSE coalesce(greatest(f - greatest(coalesce(brk, 0), b.i - 30, 0), 0), 0) END AS days_a FROM b JOIN a2 ON b.code = a2.code AND b.i = a2.i""",
    f"""b AS (SELECT *, row_number() OVER (PARTITION BY code, isl ORDER BY d) AS run FROM (SELECT *, sum(CASE WHEN s IS DISTINCT FROM ps THEN 1 ELSE 0 END) {OVER} AS isl
      FROM (SELECT *, lag(s) {OVER} AS ps FROM (SELECT code, d, i, sign(r) AS s FROM nav WHERE i >= 1))))""",
    f"""t AS (SELECT code, d, i, CASE WHEN r * 100 > 0.01 THEN 1 WHEN r * 100 < -0.01 THEN -1 ELSE 0 END AS s FROM nav WHERE i >= 1)""",
    """f AS (SELECT x.code, x.i, max(y.i) FILTER (y.s <> 0) AS f, least(count(*), 30) AS cnt FROM t x JOIN t y ON x.code = y.code AND y.i BETWEEN x.i - 29 AND x.i GROUP BY x.code, x.i)""",
    """fs AS (SELECT f.*, t.s AS fs FROM f LEFT JOIN t ON f.code = t.code AND f.f = t.i)""",
    """a2 AS (SELECT fs.code, fs.i, any_value(fs.f) AS f, any_value(fs.fs) AS fs, any_value(cnt) AS cnt, max(y.i) AS brk FROM fs LEFT JOIN t y ON fs.code = y.code AND y.i <= fs.f AND y.s <> fs.fs GROUP BY fs.code, fs.i)""",
)
_LATEST = "l AS (SELECT code, list(nav ORDER BY i) AS navs, list(r * 100 ORDER BY i) FILTER (r IS NOT NULL) AS rets FROM nav GROUP BY code)"


def _wilder(sign: int, w: int) -> str:
    x = f"list_transform(rets, lambda x: greatest(x * {sign}, 0))"
    return f"list_reduce({x}, lambda s, v: v / {w}.0 + s * (1 - 1 / {w}.0))"


RSI_WILDER = with_nav("SELECT code, " + ", ".join(f"CASE WHEN len(rets) > {w} AND {_wilder(-1, w)} <> 0 THEN 100 - 100 / (1 + {_wilder(1, w)} / {_wilder(-1, w)}) END AS rsi_{w}" for w in (6, 14, 28)) + " FROM l", _LATEST)
RSI_SIMPLE = with_nav(
    "SELECT code, d, i, "
    + ", ".join(f"CASE WHEN i >= {w} THEN CASE WHEN l{w} = 0 THEN CASE WHEN g{w} > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g{w} / l{w}) END END AS rsi_{w}" for w in (6, 14, 28))
    + " FROM g",
    f"c AS (SELECT code, d, i, nav - lag(nav) {OVER} AS c FROM nav)",
    "g AS (SELECT code, d, i, " + ", ".join(f"sum(greatest(c, 0)) {rows(w)} AS g{w}, sum(greatest(-c, 0)) {rows(w)} AS l{w}" for w in (6, 14, 28)) + " FROM c)",
)
#: Exponential means by recursion over the rows of a series (key k, position j).
MACD_STATES = """m AS (
  SELECT k, j, nav AS f, nav AS s, 0::DOUBLE AS dea FROM src WHERE j = 0
  UNION ALL
  SELECT n.k, n.j, n.nav * 2 / 13 + m.f * 11 / 13, n.nav * 2 / 27 + m.s * 25 / 27,
    ((n.nav * 2 / 13 + m.f * 11 / 13) - (n.nav * 2 / 27 + m.s * 25 / 27)) * 2 / 10 + m.dea * 8 / 10
  FROM m JOIN src n ON n.k = m.k AND n.j = m.j + 1)"""
MACD_A = (
    f"WITH RECURSIVE {NAV_SQL.strip()}, src AS (SELECT code AS k, i AS j, nav FROM nav), {MACD_STATES},"
    + """ q AS (SELECT k AS code, j, f - s AS dif, dea, f - s - dea AS hist, max(j) OVER (PARTITION BY k) AS mx FROM m),
    w AS (SELECT code, max(dif) FILTER (j = mx) AS d0, max(dea) FILTER (j = mx) AS e0, max(dif) FILTER (j = mx - 2) AS d2, max(dea) FILTER (j = mx - 2) AS e2,
      max(hist) FILTER (j = mx) AS h0, max(hist) FILTER (j = mx - 1) AS h1, max(mx) AS mx FROM q GROUP BY code)
    SELECT code, d0 AS macd_line, e0 AS signal_line, h0 AS histogram, h1 AS histogram_prev,
      CASE WHEN d2 < e2 AND d0 > e0 THEN 'golden' WHEN d2 > e2 AND d0 < e0 THEN 'dead' ELSE 'none' END AS crossover,
      CASE WHEN h0 > h1 THEN 'rising' WHEN h0 < h1 THEN 'falling' ELSE 'flat' END AS direction FROM w WHERE mx >= 36"""
)
#: One fold over each row's history keeps the three newest states.
MACD_B_STATES = """mb AS (SELECT code, d, i, list_reduce(
    list_prepend({'f': h[1], 's': h[1], 'dea': 0::DOUBLE, 'd1': 0::DOUBLE, 'e1': 0::DOUBLE, 'd2': 0::DOUBLE, 'e2': 0::DOUBLE},
      list_transform(h[2:], lambda v: {'f': v, 's': 0::DOUBLE, 'dea': 0::DOUBLE, 'd1': 0::DOUBLE, 'e1': 0::DOUBLE, 'd2': 0::DOUBLE, 'e2': 0::DOUBLE})),
    lambda a, v: {'f': v.f * 2 / 13 + a.f * 11 / 13, 's': v.f * 2 / 27 + a.s * 25 / 27,
      'dea': ((v.f * 2 / 13 + a.f * 11 / 13) - (v.f * 2 / 27 + a.s * 25 / 27)) * 2 / 10 + a.dea * 8 / 10,
      'd1': a.f - a.s, 'e1': a.dea, 'd2': a.d1, 'e2': a.e1}) AS m FROM hist)"""
HIST = "hist AS (SELECT * FROM (SELECT code, d, i, list(nav) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS h FROM nav) WHERE i >= 89)"
MACD_B_COLUMNS = """(m.f - m.s - m.dea) * 2 AS histogram,
    CASE WHEN m.d1 <= m.e1 AND m.f - m.s > m.dea THEN 'golden' WHEN m.d1 >= m.e1 AND m.f - m.s < m.dea THEN 'dead' ELSE 'none' END AS crossover,
    CASE WHEN m.f - m.s - m.dea > m.d1 - m.e1 AND m.d1 - m.e1 > m.d2 - m.e2 THEN 'rising' WHEN m.f - m.s - m.dea < m.d1 - m.e1 AND m.d1 - m.e1 < m.d2 - m.e2 THEN 'falling' ELSE 'flat' END AS direction"""
MACD_B = with_nav(f"SELECT code, d, i, {MACD_B_COLUMNS} FROM mb", HIST, MACD_B_STATES)


def _place(s: str) -> str:
    return f"CASE WHEN {s} = 0 THEN 50 ELSE (nav - (mean - 2 * {s})) / (4 * {s}) * 100 END"


BOLLINGER = with_nav(
    f"""SELECT code, d, i, CASE WHEN i >= 19 THEN {_place('s1')} END AS pos_a, CASE WHEN i >= 19 THEN 4 * s1 / mean * 100 END AS width_a,
    CASE WHEN i >= 19 THEN mean + 2 * s1 END AS upper, CASE WHEN i >= 19 THEN mean - 2 * s1 END AS lower,
    CASE WHEN i >= 19 THEN greatest(0, least(100, {_place('s1')})) ELSE 50 END AS pos_b, CASE WHEN i >= 19 THEN 4 * s1 / mean * 100 ELSE 10 END AS width_b,
    CASE WHEN i >= 19 THEN {_place('s0')} END AS pos_c FROM b""",
    f"b AS (SELECT code, d, i, nav, avg(nav) {rows(20)} AS mean, stddev_samp(nav) {rows(20)} AS s1, stddev_pop(nav) {rows(20)} AS s0 FROM nav)",
)
SKEWS = with_nav(
    """SELECT code, d, i, CASE WHEN len(a) >= 30 THEN list_skewness(a) END AS skew_a,
    CASE WHEN len(b) >= 3 THEN list_sum(list_transform(b, lambda x: pow(x - list_avg(b), 3))) / (len(b) * pow(list_stddev_samp(b), 3)) ELSE 0 END AS skew_b FROM h""",
    f"h AS (SELECT code, d, i, list(r) FILTER (r IS NOT NULL) {rows(60)} AS a, list(r) FILTER (r IS NOT NULL) {rows(40)} AS b FROM nav)",
)
SHORT = with_nav(
    "SELECT code, d, i, "
    + ", ".join(f"CASE WHEN i >= {k} THEN (nav / {_lag(k)} - 1) * 100 END AS ret_{k}" for k in (1, 3, 5, 10))
    + ", "
    + ", ".join(f"CASE WHEN i >= {k - 1} THEN avg(nav) {rows(k)} END AS ma_{k}" for k in (3, 5, 10, 20))
    + f", min(nav) {rows(30)} AS support, max(nav) {rows(30)} AS resistance, CASE WHEN i >= 10 THEN stddev_pop(r) {rows(10)} * 100 END AS vol_10"
    + f", CASE WHEN i >= 19 THEN (nav / {_lag(4)} - 1) * 100 END AS llm_ret_7d, CASE WHEN i >= 19 THEN (nav / {_lag(19)} - 1) * 100 END AS llm_ret_30d"
    + f", CASE WHEN i >= 20 THEN stddev_pop(r) {rows(20)} * sqrt(252) * 100 END AS llm_vol FROM nav"
)
