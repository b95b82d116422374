"""Golden values (FIXTURES.md) on the derived sf0.01 portfolio."""

import pytest

from creditspark.functions.economics import EconomicParameters, enrich_portfolio
from creditspark.operators import sweep as sw
from creditspark.sources.portfolio import derive_portfolio

from conftest import SF_CHECK


@pytest.fixture(scope="module")
def base(spark):
    return derive_portfolio(spark, SF_CHECK).cache()


def test_portfolio_shape(base):
    assert base.count() == 15000


@pytest.mark.parametrize("t,count,pnl", [(0.05, 7178, 9012127.03), (0.20, 13226, 14352078.36),
                                         (0.50, 14633, 12803246.93), (1.00, 15000, 10848607.42)])
def test_override_policy_table(base, t, count, pnl):
    e = enrich_portfolio(base, EconomicParameters(), mode="override")
    r = sw.round_policy(sw.policy_sweep(e, [t])).first()
    assert r["approved_count"] == count and r["expected_pnl"] == pytest.approx(pnl, abs=0.01)


def test_optimum_override(base):
    e = enrich_portfolio(base, EconomicParameters(), mode="override")
    r = sw.flatten_optimum(sw.optimize_threshold(e, 500)).first()
    assert r["optimal_threshold"] == pytest.approx(0.2064128257, abs=1e-10)
    assert r["approved_count"] == 13291
    assert r["expected_pnl"] == pytest.approx(14353620.57, abs=0.01)
    assert r["baseline_pnl"] == pytest.approx(12803246.93, abs=0.01)
    assert r["individual_optimal_pnl"] == pytest.approx(14353621.19, abs=0.01)


def test_optimum_default(base):
    e = enrich_portfolio(base, EconomicParameters(), mode="default")
    r = sw.flatten_optimum(sw.optimize_threshold(e, 500)).first()
    assert r["optimal_threshold"] == pytest.approx(0.5150300601, abs=1e-10)
    assert r["approved_count"] == 14662
    assert r["expected_pnl"] == pytest.approx(21267850.74, abs=0.01)
    assert r["baseline_pnl"] == pytest.approx(21252310.11, abs=0.01)
    assert r["individual_optimal_pnl"] == pytest.approx(21726107.29, abs=0.01)
