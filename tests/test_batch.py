"""A batch of codes with short and long histories: documents, gates and failures as rows."""

import datetime
import random

from pyspark.sql import functions as F

from fundlattice.operators import documents
from fundlattice.sources.panel import index_panel


def test_short_histories_fail_or_say_less_and_take_nothing_from_others(spark):
    r, rows = random.Random(2), []
    for code, n in (("a", 3), ("b", 6), ("c", 12), ("d", 50), ("e", 100)):
        nav = 1.0
        for k in range(n):
            nav *= 1 + r.uniform(-0.02, 0.02)
            rows.append((code, datetime.date(2024, 1, 1) + datetime.timedelta(days=k), nav))
    panel = index_panel(spark.createDataFrame(rows, "code string, d date, nav double"))
    names = "fund_type risk_appetite overseas liquidity forex_pressure commodity_disturbance preference".split()
    numbers = "cost_nav max_loss_percent holding_amount holding_units planned_buy_amount estimate_change".split()
    context = spark.createDataFrame([("e",)], "code string").withColumns({c: F.lit("") for c in names} | {c: F.lit(None).cast("double") for c in numbers} | {"macro_ok": F.lit(False), "estimate_day": F.lit(None).cast("date")})
    said = {c: (t, v) for c, (t, v) in documents.UNTESTED.items()} | {"quality": ("string", "'high'"), "calibrated": ("boolean", "TRUE"), "pred_quality": ("string", "'high'")}
    said |= {f"{n}_{h}": x for h in ("7d", "30d") for n, x in {"dir": ("string", "'up'"), "conf": ("string", "'高'"), "edge": ("boolean", "TRUE"), "edge_value": ("double", "5")}.items()}
    judged_by = spark.createDataFrame([("d",)], "code string").withColumns({c: F.expr(f"CAST({v} AS {t})") for c, (t, v) in said.items()})
    found = {x["code"]: x for x in documents.analyse(panel, context, judged_by).collect()}
    assert {c: (x["data_days"], x["success"]) for c, x in found.items()} == {"a": (3, False), "b": (6, True), "c": (12, True), "d": (50, True), "e": (100, True)}
    assert found["a"]["document"] is None and "仅 3 条" in found["a"]["error"]
    gates = {c: {h: p["gate"] for h, p in x["document"]["forecast"].items()} for c, x in found.items() if x["success"]}
    assert gates["b"] == {"1d": "insufficient", "3d": "insufficient", "7d": "insufficient", "30d": "low_confidence"}
    assert gates["c"] == {"1d": "open", "3d": "open", "7d": "insufficient", "30d": "low_confidence"}
    assert set(gates["e"].values()) == {"open"} and gates["d"]["30d"] == "low_confidence"
    empty = found["b"]["document"]["forecast"]["7d"]
    assert (empty["up"], empty["sideways"], empty["direction"], empty["confidence"], empty["range_low"]) == (33, 34, "不确定", "低", None)
    for x in found.values():
        if x["success"]:
            f = x["document"]["forecast"]["30d"]
            assert f["up"] + f["sideways"] + f["down"] == 100 and (x["data_days"] >= 60 or f["confidence"] == "低")
            assert 0 <= x["document"]["risk"]["risk_score"] <= 100
    assert found["b"]["document"]["forecast"]["7d"]["reasons"] == ["历史数据仅6个交易日，不足以进行7天情景判断"]
    untested, tested = found["e"]["document"], found["d"]["document"]
    assert untested["final"]["why"][0] == "历史验证未显示稳定预测优势，当前方向难以判断。" and "样本不足，不应把该概率当作可靠预测。" in untested["final"]["warning"]
    assert tested["final"]["why"][0] != untested["final"]["why"][0] and "样本不足，不应把该概率当作可靠预测。" not in tested["final"]["warning"]
    assert documents.texts.DISTRUST["advice_reasons"] in untested["advice"]["reasons"] and documents.texts.DISTRUST["advice_reasons"] not in tested["advice"]["reasons"]
    assert len(untested["decision_support"]["invalidation_signals"]) == 3 and 1 <= len(untested["decision_support"]["buy_watch"]) <= 3
