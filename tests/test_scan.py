"""Scans over ordered rows against pandas and against folds over arrays; the calendar family and what rests on it."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fundlattice.functions.numeric import max_drawdown
from fundlattice.operators import calendar, decisions, scan
from fundlattice.operators import indicators as ind
from fundlattice.sources.panel import index_panel


def panel(spark, sizes, gap=3, seed=1, jump=0.02):
    """Random walks with gaps of up to so many days; some days stand still."""
    r, rows = random.Random(seed), []
    for k, n in enumerate(sizes):
        nav, day = 1.0, datetime.date(2020, 1, 1)
        for _ in range(n):
            rows.append((f"c{k}", day, nav))
            day += datetime.timedelta(days=r.randint(1, gap))
            nav *= 1 + r.choice([0.0, 1.0]) * r.uniform(-jump, jump)
    return index_panel(spark.createDataFrame(rows, "code string, d date, nav double"))


@pytest.mark.parametrize("gap", [1, 3, 40])
def test_falls_are_those_of_a_fold(spark, gap):
    p = panel(spark, [1, 2, 5, 130], gap)
    frames = {f"r{n}": (F.col("i"), n, ind.rows(n)) for n in (1, 2, 7, 50)} | {f"d{n}": (F.unix_date("d"), n + 1, ind.days(n)) for n in (1, 7, 90)}
    out = scan.largest_falls(p, frames)
    for name, (_, _, frame) in frames.items():
        out = out.withColumn(f"{name}_fold", max_drawdown(F.collect_list("nav").over(frame)))
    found = out.toPandas()
    for name in frames:
        assert np.allclose(found[name], found[f"{name}_fold"], atol=1e-12), name


def test_exponential_means_are_those_of_pandas(spark):
    p = panel(spark, [1, 3, 1024, 1025, 5000])
    found = scan.exponential_means(p, {"slow": ("nav", 0, 1 / 28), "fast": ("nav", 0, 0.2), "later": ("r", 1, 2 / 27)}).toPandas().sort_values(["code", "i"])
    for _, x in found.groupby("code"):
        assert np.allclose(x["slow"], x["nav"].ewm(alpha=1 / 28, adjust=False).mean(), rtol=1e-12)
        assert np.allclose(x["fast"], x["nav"].ewm(alpha=0.2, adjust=False).mean(), rtol=1e-12)
        assert np.allclose(x["later"].iloc[1:], x["r"].iloc[1:].ewm(alpha=2 / 27, adjust=False).mean(), rtol=1e-9, atol=1e-15)
        assert pd.isna(x["later"].iloc[0])


def test_no_row_carries_its_history(spark):
    plan = calendar.macd(calendar.wilder_rsi(panel(spark, [50])))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_metrics_begin_with_the_fifth_row(spark):
    found = calendar.metrics(panel(spark, [3, 4, 5, 12, 45], gap=2)).toPandas()
    assert found.groupby("code").size().to_dict() == {"c2": 1, "c3": 8, "c4": 41}
    early = calendar.neutral(calendar.metrics(panel(spark, [5]))).first()
    assert (early["vol_90"] is not None, early["rsi_14"], early["macd_cross"], early["regime"], early["trend"]) == (True, 50.0, "none", "未知", "数据不足，无法判断趋势")


def test_the_two_families_lead_to_different_risks(spark):
    """A fall 25 days ago lies within 30 days, but not within the 20 rows that the trading family takes for them."""
    day, navs = datetime.date(2024, 1, 1), [1.0] * 100 + [0.85] + [0.85 * 1.001**k for k in range(24)]
    p = index_panel(spark.createDataFrame([("x", day + datetime.timedelta(days=k), v) for k, v in enumerate(navs)], "code string, d date, nav double"))
    from fundlattice.operators import walkforward

    context = spark.createDataFrame([("x", "混合型", None, None, None, None, None)], "code string, fund_type string, macro_ok boolean, risk_appetite string, overseas string, forex_pressure string, commodity_disturbance string")
    context = context.withColumns({c: F.lit(None).cast("double") for c in ("cost_nav", "holding_amount", "holding_units", "max_loss_percent")}).withColumn("preference", F.lit("平衡"))
    risks = [decisions.with_risk(decisions.with_kinds(df.join(context, "code"))).first() for df in (calendar.neutral(calendar.newest(calendar.metrics(p))), walkforward.features(p, present=True))]
    assert (risks[0]["dd_30"] > 10, risks[1]["dd_30"] < 1) == (True, True)
    assert risks[0]["drawdown_risk"] >= 70 > risks[1]["drawdown_risk"]
    assert risks[0]["risk_score"] > risks[1]["risk_score"]
