import pytest

from fundlattice.plans.catalog import QUERIES
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.name)
def test_matches_sql(spark, con, query):
    df = query.run(spark, SF)
    if query.sql is None:
        assert df.count() > 0
    else:
        assert_same(df, con, query.oracle())


def test_entry_file_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


def test_panel_windows_share_one_exchange(spark):
    from fundlattice.operators import indicators as ind
    from fundlattice.sources.panel import nav_panel

    plan = ind.rebound_pullback(nav_panel(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(code") <= 2  # the daily sums, then the series
