"""The newest row's metrics as one aggregation: the same as the last of all rows' metrics, and one pass over the panel."""

import datetime
import random

import pytest

from fundlattice.operators import calendar, documents
from fundlattice.plans import more_queries as mq
from fundlattice.sources.panel import index_panel

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    r, rows = random.Random(5), []
    for n in (1, 4, 5, 6, 12, 31, 37, 41, 90, 1_100):
        for kind in ("moves", "rises", "flat", "gaps"):
            nav, day = 1.0, datetime.date(2020, 1, 1)
            for _ in range(n):
                nav *= 1 + {"moves": r.uniform(-0.03, 0.03), "rises": 0.01 * r.random(), "flat": 0.0, "gaps": r.choice((0.0, 0.00005, 0.01, -0.01))}[kind]
                day += datetime.timedelta(days=r.randint(1, 40) if kind == "gaps" else 1)
                rows.append((f"{kind}{n}", day, nav))
    return index_panel(spark.createDataFrame(rows, "code string, d date, nav double"))


def test_same_as_the_last_of_all_rows(panel):
    want = {r["code"]: r.asDict() for r in calendar.newest(calendar.metrics(panel)).collect()}
    got = {r["code"]: r.asDict() for r in calendar.newest_metrics(panel).collect()}
    assert got.keys() == want.keys() and len(got) == 32
    for code in want:
        # of values that never move, a mean of means differs from another by less than a double shows
        unsure = ("macd_cross", "macd_dir") if code.startswith("flat") else ()
        for c, x in want[code].items():
            if c not in unsure:
                assert got[code][c] == (pytest.approx(x, abs=1e-9) if isinstance(x, float) else x), (code, c)


def test_documents_read_the_panel_once(spark):
    plan = documents.analyse(mq.customer_panel(spark, SF), mq.customer_context(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_totalprice") and plan.count("/orders.parquet") <= 1 and plan.count("Relation [o_orderkey") == 1
    assert plan.count("Window [") <= 10
