"""The stress cube against stressed rows evaluated one by one, and its breakpoints against their definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from creditspark.operators import scenarios as sc
from creditspark.operators import sweep as sw
from creditspark.operators.stress_cube import CubeScenario, breakpoint_of, greatest_within, scenario_sweeps


@pytest.fixture(scope="module")
def loans(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        pd = rng.choice([round(rng.random(), rng.choice([1, 3, 6])), 0.0, 1.0, 0.001, 0.999, 0.5])
        rows.append((i, pd, float(rng.randint(1, 500) * 100), round(rng.uniform(0.05, 0.4), 4), round(rng.uniform(0.01, 0.2), 4),
                     12 * rng.randint(1, 5)))
    rows += [(1000, None, 1000.0, 0.2, 0.05, 12), (1001, float("nan"), 2000.0, 0.2, 0.05, 24)]
    return spark.createDataFrame(rows, "application_id long, pd double, loan_amount double, interest_rate double, cost_of_funds double, loan_term_months long")


def row_by_row(loans, scenarios, cutoffs, mode, bounds, term):
    expanded = sc.expand_scenarios(loans, scenarios, mode, bounds, term)
    found = {}
    for t in cutoffs:
        for r in sc.evaluate_grouped(expanded, t, ["scenario"]).collect():
            found[r["scenario"], t] = r
    return found


@pytest.mark.parametrize("mode", ["default", "override"])
@pytest.mark.parametrize("columns", [(), ("interest_rate",), ("loan_term_months", "cost_of_funds")])
def test_cube_equals_stressed_rows(spark, loans, mode, columns):
    loans = loans.drop(*columns)
    bounds = (0.001, 0.999)
    cutoffs = [0.0, 0.001, 0.0015, 0.1, 0.25, 0.3, 0.5, 0.55, 0.999, 1.0]
    scenarios = [sc.Scenario("a"), sc.Scenario("b", 1.1, 0.08, 0.6, 0.2), sc.Scenario("c", 0.7, lgd_add=0.2, cof_add=0.01, lgd_cap=0.5), sc.Scenario("d", 3.0)]
    want = row_by_row(loans, scenarios, cutoffs, mode, bounds, 18)
    cubes = [CubeScenario(i, s.pd_multiplier, s.interest_rate, s.shifted_cof(), s.shifted_lgd(), 18.0, cutoffs, bounds) for i, s in enumerate(scenarios)]
    got = scenario_sweeps(loans, cubes, mode).collect()
    assert len(got) == len(want) == len(cutoffs) * len(scenarios)
    for r in got:
        w = want[scenarios[r["scenario"]].name, r["threshold"]]
        assert (r["total_applications"], r["approved_count"]) == (w["total_applications"], w["approved_count"])
        for c in sw.POLICY_COLUMNS:
            assert float(r[c]) == pytest.approx(float(w[c]), rel=1e-9, abs=1e-5), (c, r, w)


def test_unstressed_scenario_equals_the_plain_sweep(spark, loans):
    from creditspark.functions.economics import EconomicParameters, enrich_portfolio

    cutoffs = sw.linspace(0.0, 1.0, 41)
    want = {r["threshold"]: r for r in sw.policy_sweep(enrich_portfolio(loans, EconomicParameters(), "default"), cutoffs).collect()}
    got = scenario_sweeps(loans, [CubeScenario(-1, 1.0, 0.18, 0.05, 0.45, 12.0, cutoffs)], "default").collect()
    assert len(got) == 41
    for r in got:
        for c in sw.POLICY_COLUMNS:
            assert float(r[c]) == pytest.approx(float(want[r["threshold"]][c]), rel=1e-9, abs=1e-5)


def test_breakpoints_are_the_greatest_approved_doubles():
    rng = random.Random(2)
    for _ in range(2000):
        m, t = rng.choice([1.0, 1.25, 1.3, 1.5, 0.7, rng.uniform(0.1, 4)]), rng.choice([0.0, 0.3, 1.0, rng.random()])
        x = greatest_within(m, t)
        assert x * m <= t < math.nextafter(x, math.inf) * m
    s = CubeScenario(0, 2.0, 0.1, 0.1, 0.1, 12.0, [0.5], (0.01, 0.9))
    assert breakpoint_of(s, 0.9) == math.inf and breakpoint_of(s, 0.005) == -math.inf and breakpoint_of(s, 0.5) == 0.25


def test_bad_scenarios_raise(spark, loans):
    with pytest.raises(ValueError):
        CubeScenario(0, 0.0, 0.1, 0.1, 0.1, 12.0, [0.5], (0.0, 1.0))
    with pytest.raises(ValueError):
        CubeScenario(0, 1.5, 0.1, 0.1, 0.1, 12.0, [0.5])
    one = CubeScenario(0, 1.0, 0.1, 0.1, 0.1, 12.0, [0.5])
    with pytest.raises(ValueError):
        scenario_sweeps(loans, [one, one])


def test_empty_portfolio_gives_zero_rows(spark, loans):
    got = scenario_sweeps(loans.limit(0), [CubeScenario(0, 1.2, 0.18, 0.05, 0.45, 12.0, [0.1, 0.5], (0.0, 1.0))]).collect()
    assert [(r["total_applications"], r["approved_count"], float(r["expected_pnl"])) for r in got] == [(0, 0, 0.0)] * 2


def test_scenarios_do_not_multiply_the_portfolio(spark, loans):
    """Generators stand above the aggregate over the portfolio, never below it; the portfolio is read once."""
    loans = loans.where(~F.isnan("pd"))
    plan = sc.stress_reoptimized(loans)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 1 and plan.count("loan_amount") > 0
    assert plan.index("Generate") < plan.rindex("Aggregate")
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 4  # loans, cutoffs, scenario terms
    fixed = sc.stress_fixed_cutoff(loans).collect()
    assert {r["scenario"] for r in fixed} == {s.name for s in sc.FIXED_CUTOFF_SCENARIOS}


def test_shared_grids_equal_grids_of_stressed_rows(spark, loans):
    import numpy as np

    clean = loans.where(F.col("pd").isNotNull() & ~F.isnan("pd"))
    pds = np.array([r["pd"] for r in clean.select("pd").collect()])
    grids = sc.scenario_candidate_grids(clean, sc.REOPTIMIZED_SCENARIOS, 30, (0.001, 0.999), 50)
    for s in sc.REOPTIMIZED_SCENARIOS:
        stressed = np.clip(pds * s.pd_multiplier, 0.001, 0.999)
        want = np.unique(np.clip([0.0, 0.5, 1.0, stressed.min(), stressed.max(), *np.linspace(0, 1, 30), *np.quantile(stressed, np.linspace(0, 1, 30))], 0, 1))
        assert len(grids[s.name]) == len(want) and np.allclose(grids[s.name], want, atol=1e-15)
    assert len(grids[None]) >= 50
