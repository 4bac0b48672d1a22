import math
import random

import pytest
from pyspark.sql import functions as F

from fundlattice.functions.numeric import ema, macd_states, max_drawdown, safe_double, wilder
from fundlattice.operators import indicators as ind
from fundlattice.operators import walkforward as wf
from fundlattice.sources.panel import index_panel


def series(n, seed=42, vol=0.02):
    rng, nav, out = random.Random(seed), 1.0, []
    for _ in range(n):
        out.append(round(nav, 4))
        nav *= 1 + rng.gauss(0, vol)
    return out


def panel(spark, navs, code="f"):
    rows = [(code, i, float(v)) for i, v in enumerate(navs)]
    return index_panel(spark.createDataFrame(rows, "code string, k int, nav double").select("code", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")).alias("d"), "nav"))


def last(df, i):
    return df.where(F.col("i") == i).first()


def test_folds(spark):
    v = [1.0, 1.2, 0.9, 1.1, 1.3, 1.04]
    df = spark.createDataFrame([(v,)], "v array<double>")
    row = df.select(max_drawdown(F.col("v")).alias("dd"), ema(F.col("v"), 3).alias("e"), wilder(F.col("v"), 4).alias("w"), macd_states(F.col("v")).alias("m")).first()
    assert row["dd"] == pytest.approx(0.25)
    e = w = v[0]
    f, s, dea, states = v[0], v[0], 0.0, [(0.0, 0.0)]
    for x in v[1:]:
        e, w = 0.5 * x + 0.5 * e, 0.25 * x + 0.75 * w
        f, s = x * 2 / 13 + f * 11 / 13, x * 2 / 27 + s * 25 / 27
        dea = (f - s) * 0.2 + dea * 0.8
        states.append((f - s, dea))
    assert row["e"] == pytest.approx(e) and row["w"] == pytest.approx(w)
    for got, want in zip(row["m"], states[::-1]):
        assert (got["dif"], got["dea"]) == pytest.approx(want)


def test_families_differ_as_documented(spark):
    navs = [1.0, 1.1, 1.0, 1.2, 1.1, 1.3, 1.2]
    p = panel(spark, navs)
    r = last(ind.returns_trading(p), 6)
    assert r["ret_1_a"] == pytest.approx((1.2 / 1.3 - 1) * 100)
    assert r["ret_10_a"] == pytest.approx(20) and r["ret_10_b"] == 0
    d = last(ind.drawdown_trading(p), 6)
    assert d["dd_5_a"] < 0 < d["dd_5_b"]
    assert last(ind.rsi_simple(panel(spark, [1.0 + i / 10 for i in range(8)])), 7)["rsi_6"] == 100
    assert last(ind.rsi_simple(panel(spark, [1.0] * 8)), 7)["rsi_6"] == 50


def test_streak_skips_small_moves_at_the_end(spark):
    row = last(ind.streaks(panel(spark, [1.0, 1.1, 1.2, 1.3, 1.30001])), 4)
    assert (row["dir_a"], row["days_a"]) == ("上涨", 3)
    assert (row["dir_b"], row["days_b"]) == ("上涨", 4)


def test_calendar_return_uses_the_last_row_at_or_before(spark):
    row = last(ind.returns_calendar(panel(spark, series(50))), 40)
    navs = series(50)
    assert row["ret_30"] == pytest.approx((navs[40] - navs[10]) / navs[10] * 100)
    assert row["ret_60"] is None


def test_no_leakage(spark):
    navs = series(200)
    changed = navs[:150] + [x * 1.5 for x in navs[150:]]
    cols = ["code", "horizon", "i", "score", "probability", "prediction", "threshold"]
    known = lambda v: sorted(wf.samples(panel(spark, v)).where("i <= 150").select(*cols).collect())
    assert known(navs) == known(changed)


def test_samples_hold_their_invariants(spark):
    s = wf.samples(panel(spark, series(200)))
    row = s.agg(F.min("probability").alias("lo"), F.max("probability").alias("hi"), F.min("threshold").alias("t"), F.max("threshold").alias("tt"), F.min("i").alias("first")).first()
    assert 0.1 <= row["lo"] <= row["hi"] <= 0.9 and 0.5 <= row["t"] <= row["tt"] <= 20 and row["first"] == 90
    n = {r["horizon"]: r["count"] for r in s.groupBy("horizon").count().collect()}
    assert n == {h: 200 - 90 - h for h in (1, 3, 7, 30)}
    one = s.where("horizon = 7 and i = 100").first()
    navs = series(200)
    assert one["ret"] == pytest.approx((navs[107] - navs[99]) / navs[99] * 100)  # a label spans horizon + 1 steps


def test_dynamic_threshold_grows_with_volatility(spark):
    mean = lambda vol: wf.samples(panel(spark, series(200, 1, vol))).where("horizon = 7").agg(F.avg("threshold")).first()[0]
    assert mean(0.005) < mean(0.04)


def test_safe_double(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("Infinity",)], "s string")
    assert [r[0] for r in df.select(safe_double("s", 7.0)).collect()] == [1.5, 7.0, 7.0, 7.0, 7.0]
    assert math.isclose(1.5, 1.5)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 400])
def test_rank_so_far(spark, n):
    import random

    from fundlattice.operators.indicators import rank_so_far

    rng = random.Random(n)
    values = {c: [rng.choice((rng.random(), 0.5)) for _ in range(n)] for c in "ab"}
    df = spark.createDataFrame([(c, i * 3, x) for c, v in values.items() for i, x in enumerate(v)], "code string, i int, x double")
    got = {(r["code"], r["i"] // 3): (r["place"], r["below"]) for r in rank_so_far(df, "x").collect()}
    assert got == {(c, i): (i + 1, sum(y <= x for y in v[: i + 1])) for c, v in values.items() for i, x in enumerate(v)}
