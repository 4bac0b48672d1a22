"""Codes of 50 to 400 rows: lookbacks, neutral values, present rows and gates, against SQL and plain Python."""

import numpy as np
import pandas as pd
import pytest

from fundlattice.operators import walkforward as wf
from fundlattice.plans.catalog import QUERIES
from fundlattice.sources.panel import nav_panel
from tests.compare import assert_same, connect

ROWS = {"a50": 50, "b60": 60, "c81": 81, "d100": 100, "e119": 119, "f123": 123, "g400": 400}
BY_NAME = {q.name: q for q in QUERIES}


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    rng = np.random.default_rng(11)
    frames = []
    for code, n in ROWS.items():
        days = pd.bdate_range("2020-01-01", periods=n + 59)
        price = np.round(150_000 * np.exp(np.cumsum(rng.normal(0.001, 0.15, len(days)))), 2)
        frames.append(pd.DataFrame({"o_orderpriority": code, "o_orderdate": days.date, "o_totalprice": price}))
    folder = tmp_path_factory.mktemp("short")
    pd.concat(frames).to_parquet(folder / "orders.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("name", ["walkforward_features", "walkforward_labels", "up_probability", "kernel_calibration", "threshold_sweep", "predictions", "prediction_quality", "rule_search"])
def test_matches_sql(spark, orders, name):
    assert_same(BY_NAME[name].run(spark, orders), connect(orders), BY_NAME[name].oracle())


def test_samples_of_each_code(spark, orders):
    """As many as rows past the lookback whose outcome is known; a code of 50 rows has none, nor a present row."""
    got = {(r["code"], r["horizon"]): r["count"] for r in wf.samples(nav_panel(spark, orders)).groupBy("code", "horizon").count().collect()}
    want = {}
    for code, n in ROWS.items():
        look = min(90, max(40, n // 2))
        for h in (1, 3, 7, 30):
            if n >= 60 and n - h > look:
                want[code, h] = n - h - look
    assert got == want
    now = wf.present(nav_panel(spark, orders)).select("code", "horizon", "i").collect()
    assert sorted((r["code"], r["horizon"], r["i"]) for r in now) == sorted((c, h, n - 1) for c, n in ROWS.items() if n >= 60 for h in (1, 3, 7, 30))


def test_present_row_knows_all_rows(spark, orders):
    """Share of lower volatilities and MACD over the whole history, in numpy."""
    navs = {c: g["nav"].to_numpy() for c, g in nav_panel(spark, orders).toPandas().sort_values(["code", "i"]).groupby("code")}
    for r in wf.features(nav_panel(spark, orders), present=True).collect():
        v = navs[r["code"]]
        ret = np.diff(v) / v[:-1]
        vols = [np.std(ret[i - 20 : i], ddof=1) for i in range(20, len(ret) + 1)]
        assert r["pct"] == pytest.approx(np.mean(np.array(vols) < vols[-1]) * 100, abs=0.051) and r["vol_pop"] == pytest.approx(np.std(ret))
        fast = slow = v[0]
        dea = 0.0
        for x in v[1:]:
            fast, slow = fast * 11 / 13 + x * 2 / 13, slow * 25 / 27 + x * 2 / 27
            dea = dea * 0.8 + (fast - slow) * 0.2
        assert r["macd_hist"] == pytest.approx(2 * (fast - slow - dea), abs=1e-6)
