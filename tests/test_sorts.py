"""Sorts of one task of the walk-forward samples: each holds a page of memory, so windows share them."""

import pytest

from fundlattice.operators import walkforward as wf
from fundlattice.sources.panel import nav_panel


@pytest.mark.parametrize("present", [False, True])
def test_windows_of_features_share_sorts(spark, present):
    plan = wf.features(nav_panel(spark, "/root/testdata/sf0.001"), present)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") <= 8
