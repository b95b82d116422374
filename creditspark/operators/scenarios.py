"""Scenario analysis on top of the sweep: stress tests, sensitivity grid, policy comparisons
(P12, P13, O8-O12, O16).

Scenarios are a handful of parameter sets. Instead of re-running the optimiser once per
scenario (the reference builds a new optimiser per scenario), all sweeps come from one small cube
over the unstressed portfolio (``stress_cube``). ``expand_scenarios`` gives the stressed rows themselves
where they are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.functions.economics import (
    DEFAULT_COST_OF_FUNDS,
    DEFAULT_INTEREST_RATE,
    DEFAULT_LGD,
    DEFAULT_TERM_MONTHS,
    EconomicParameters,
    breakeven_pd,
    enrich_columns,
)
from creditspark.operators import sweep as sw
from creditspark.operators.quantiles import interpolate, order_statistics, rank_sketch
from creditspark.operators.stress_cube import CubeScenario, scenario_sweeps


@dataclass(frozen=True)
class Scenario:
    """A stress scenario.

    Absolute terms (``cost_of_funds``, ``lgd``, ``interest_rate``) play the role of economic
    parameters; ``cof_add`` / ``lgd_add`` / ``lgd_cap`` shift a base (cockpit style).
    """

    name: str
    pd_multiplier: float = 1.0
    cost_of_funds: float = DEFAULT_COST_OF_FUNDS
    lgd: float = DEFAULT_LGD
    interest_rate: float = DEFAULT_INTEREST_RATE
    cof_add: float = 0.0
    lgd_add: float = 0.0
    lgd_cap: float | None = None

    def shifted_cof(self) -> float:
        return self.cost_of_funds + self.cof_add

    def shifted_lgd(self) -> float:
        lgd = self.lgd + self.lgd_add
        return min(lgd, self.lgd_cap) if self.lgd_cap is not None else lgd


# Stress scenarios at a fixed cutoff (cost of funds, LGD, PD multiplier; rate .18).
FIXED_CUTOFF_SCENARIOS = [
    Scenario("base", 1.00, 0.05, 0.45),
    Scenario("funding_shock_500bps", 1.00, 0.10, 0.45),
    Scenario("lgd_shock_25pp", 1.00, 0.05, 0.70),
    Scenario("recession_pd_25pct", 1.25, 0.05, 0.45),
    Scenario("combined_storm", 1.30, 0.12, 0.70),
]
# Re-optimised scenarios (PD multiplier, CoF add-on, LGD add-on and cap).
REOPTIMIZED_SCENARIOS = [
    Scenario("base", 1.00),
    Scenario("slowdown", 1.20, cof_add=0.015),
    Scenario("inflation_shock", 1.10, cof_add=0.045, lgd_add=0.10, lgd_cap=0.95),
    Scenario("severe_crisis", 1.50, cof_add=0.060, lgd_add=0.25, lgd_cap=0.99),
]
# Sensitivity axes.
SENSITIVITY_COF = [float(x) for x in np.linspace(0.03, 0.15, 8)]
SENSITIVITY_LGD = [float(x) for x in np.linspace(0.30, 0.80, 8)]


def stressed_pd(pd: Column, multiplier: Column | float, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``clip(pd * m, lo, hi)``; a null PD stays null (least/greatest would turn it into lo)."""
    m = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return F.when(pd.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), pd * m)))


def expand_scenarios(portfolio: DataFrame, scenarios: Sequence[Scenario], mode: str = "default",
                     pd_bounds: tuple[float, float] = (0.0, 1.0),
                     term_months: int = DEFAULT_TERM_MONTHS) -> DataFrame:
    """One row per (application, scenario) with stressed PD, scenario terms and P7 columns.

    ``default``: scenario terms only fill columns the portfolio lacks (the reference's
    parameter semantics); ``override``: rate, shifted CoF, shifted/capped LGD and the term
    replace the row's columns (P13).
    """
    if mode not in ("default", "override"):
        raise ValueError(f"mode must be 'default' or 'override', got {mode!r}")
    lits = F.array(*[
        F.struct(F.lit(s.name).alias("scenario"), F.lit(float(s.pd_multiplier)).alias("_mult"),
                 F.lit(float(s.interest_rate)).alias("_rate"), F.lit(float(s.shifted_cof())).alias("_cof"),
                 F.lit(float(s.shifted_lgd())).alias("_lgd"))
        for s in scenarios])
    expanded = portfolio.select("*", F.inline(lits))
    cols = portfolio.columns

    def pick(name: str, scenario_value: Column) -> Column:
        if mode == "default" and name in cols:
            return F.col(name).cast("double")
        return scenario_value.cast("double")

    lo, hi = pd_bounds
    term = F.lit(float(term_months)) if mode == "override" or "loan_term_months" not in cols \
        else F.col("loan_term_months").cast("double")
    prepared = expanded.withColumns({
        "pd": stressed_pd(F.col("pd").cast("double"), F.col("_mult"), lo, hi),
        "loan_amount": F.col("loan_amount").cast("double"),
        "interest_rate": pick("interest_rate", F.col("_rate")),
        "cost_of_funds": pick("cost_of_funds", F.col("_cof")),
        "lgd": pick("lgd", F.col("_lgd")),
        "loan_term_months": term,
    }).drop("_mult", "_rate", "_cof", "_lgd")
    return prepared.withColumns(enrich_columns())


def evaluate_grouped(enriched: DataFrame, threshold: Column | float, group_cols: Sequence[str]) -> DataFrame:
    """A1 per group at one cutoff (a literal or a scalar-subquery column)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pd = F.col("pd")
    ok = pd <= t
    agg = enriched.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("_total"),
        F.count(F.when(ok, F.lit(1))).alias("_n"),
        sw.money_sum(F.when(ok, F.col("loan_amount"))).alias("_exposure"),
        sw.money_sum(F.when(ok, (F.lit(1.0) - pd) * F.col("net_gain_performing"))).alias("_margin"),
        sw.money_sum(F.when(ok, pd * F.col("net_loss_default"))).alias("_loss"),
        sw.money_sum(F.when(ok, F.col("expected_value"))).alias("_pnl"),
        sw.money_sum(F.when(ok, pd)).alias("_pd_sum"),
    )
    return agg.select(*group_cols, *sw.policy_metric_columns(
        t, F.col("_total"), F.col("_n"), F.col("_exposure"), F.col("_margin"), F.col("_loss"),
        F.col("_pnl"), F.col("_pd_sum")))


def _cube_scenario(key: int, s: Scenario, cutoffs: Sequence[float], bounds: tuple[float, float], term_months: int) -> CubeScenario:
    return CubeScenario(key, float(s.pd_multiplier), float(s.interest_rate), s.shifted_cof(), s.shifted_lgd(), float(term_months), cutoffs, bounds)


def _base_scenario(params: EconomicParameters, cutoffs: Sequence[float]) -> CubeScenario:
    """The unstressed portfolio, as key -1."""
    return CubeScenario(-1, 1.0, params.interest_rate, params.cost_of_funds, params.lgd, float(params.loan_term_months), cutoffs)


def _against_base(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per scenario with its name and the base's row (key -1) as ``base``; a handful of rows."""
    record = F.struct("threshold", "approval_rate", "expected_pnl")
    base = F.max(F.when(F.col("scenario") == -1, record)).over(Window.partitionBy())
    rows = rows.withColumn("base", base).where("scenario >= 0")
    return rows.withColumn("scenario", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("scenario") + 1))


def stress_fixed_cutoff(portfolio: DataFrame, scenarios: Sequence[Scenario] = FIXED_CUTOFF_SCENARIOS,
                        base_lgd: float = DEFAULT_LGD, grid_size: int = 500, mode: str = "default") -> DataFrame:
    """Hold the base optimal cutoff fixed and evaluate every scenario at it.

    The base optimum isn't known before the sweep, but it is one of the candidates: one cube holds the
    base and all scenarios at every candidate, and the base's best row then picks the others'.
    """
    params = EconomicParameters(lgd=base_lgd)
    grid = sw.candidate_grid(portfolio, grid_size)
    cubes = [_cube_scenario(i, s, grid, (0.0, 1.0), params.loan_term_months) for i, s in enumerate(scenarios)]
    swept = scenario_sweeps(portfolio, [_base_scenario(params, grid), *cubes], mode)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The base's best row: highest P&L, then lowest cutoff (cutoffs x scenarios rows).
    best = F.max(F.when(F.col("scenario") == -1, F.struct(F.col("expected_pnl"), -F.col("threshold")))).over(whole)
    at_best = swept.withColumn("_best", -best.getField("col2")).where("threshold = _best").drop("_best")
    ev = _against_base(at_best, [s.name for s in scenarios])
    pnl, base_pnl = F.col("expected_pnl").cast("double"), F.col("base.expected_pnl").cast("double")
    return ev.select(
        "scenario", "threshold", "approved_count",
        sw.round_money("expected_pnl").alias("expected_pnl"),
        sw.round_money("expected_loss").alias("expected_loss"),
        F.bround(F.col("expected_default_rate") * 100.0, 4).alias("default_rate_pct"),
        F.bround(F.col("return_on_exposure") * 100.0, 4).alias("return_pct"),
        F.bround((pnl - base_pnl) / base_pnl * 100.0, 4).alias("pnl_change_vs_base_pct"),
    )


def scenario_candidate_grids(portfolio: DataFrame, scenarios: Sequence[Scenario], grid_size: int,
                             pd_bounds: tuple[float, float] = (0.0, 1.0), base_grid: int | None = None) -> dict[str | None, list[float]]:
    """O2 per scenario by name, and for the unstressed PDs as None where ``base_grid`` is given.

    One selection over the unstressed PDs serves all: ``clip(pd * m)`` is monotone, so each scenario's
    order statistics are the base ones mapped one by one; at most ``grid_size + base_grid`` pairs of doubles
    reach the driver.
    """
    sketch = rank_sketch(portfolio, "pd", grid_size + (base_grid or 0))
    n = sketch.count()
    sizes = {None: base_grid} if base_grid else {}
    sizes |= {s.name: grid_size for s in scenarios}
    if n == 0:
        return {name: sw.grid_from(0, 0.0, 0.0, [], size) for name, size in sizes.items()}
    fractions = {size: sw.linspace(0.0, 1.0, min(size, n)) for size in set(sizes.values())}
    found = order_statistics(portfolio, "pd", sorted(set().union(*fractions.values())), sketch=sketch)
    around = {r["fraction"]: (r["lower"], r["upper"], r["weight"]) for r in found.collect()}
    lo, hi = pd_bounds
    stress = {s.name: lambda p, m=s.pd_multiplier: min(hi, max(lo, p * m)) for s in scenarios}
    grids = {}
    for name, size in sizes.items():
        by = stress.get(name, lambda p: p)
        quantiles = [interpolate(by(a), by(b), t) for a, b, t in map(around.get, fractions[size])]
        grids[name] = sw.grid_from(n, quantiles[0], quantiles[-1], quantiles, size)
    return grids


def stress_reoptimized(portfolio: DataFrame, scenarios: Sequence[Scenario] = REOPTIMIZED_SCENARIOS,
                       base_grid: int = 500, scenario_grid: int = 300,
                       pd_bounds: tuple[float, float] = (0.001, 0.999),
                       term_months: int = DEFAULT_TERM_MONTHS) -> DataFrame:
    """Re-optimise the cutoff under every scenario; deltas against the base optimum.

    One selection gives all candidate grids and one cube all sweeps, the base's among them; each
    scenario competes over its own candidates.
    """
    params = EconomicParameters(loan_term_months=term_months)
    grids = scenario_candidate_grids(portfolio, scenarios, scenario_grid, pd_bounds, base_grid)
    cubes = [_cube_scenario(i, s, grids[s.name], pd_bounds, term_months) for i, s in enumerate(scenarios)]
    swept = scenario_sweeps(portfolio, [_base_scenario(params, grids[None]), *cubes], "override")
    best = _against_base(sw.best_policy(swept, "expected_pnl", group_cols=["scenario"]), [s.name for s in scenarios])
    pnl = F.col("expected_pnl").cast("double") - F.col("base.expected_pnl").cast("double")
    return best.select(
        "scenario",
        F.bround("threshold", 10).alias("optimal_threshold"),
        "approved_count",
        F.bround("approval_rate", 6).alias("approval_rate"),
        sw.round_money("expected_pnl").alias("expected_pnl"),
        F.bround((F.col("threshold") - F.col("base.threshold")) * 100.0, 6).alias("delta_threshold_pp"),
        F.bround((F.col("approval_rate") - F.col("base.approval_rate")) * 100.0, 6).alias("delta_approval_pp"),
        F.bround(pnl, 2).alias("delta_pnl"),
    )


def sensitivity_default(portfolio: DataFrame, grid_size: int = 500, cof_values: Sequence[float] = SENSITIVITY_COF,
                        lgd_values: Sequence[float] = SENSITIVITY_LGD) -> DataFrame:
    """O12 as the parameters' default mode gives it: P&L over the grid at the base optimum, where a
    grid value only fills a column that the portfolio lacks (so a portfolio with its own cost of
    funds has the same P&L for every value of that axis)."""
    from creditspark.functions.economics import EconomicParameters, enrich_portfolio

    base = enrich_portfolio(portfolio, EconomicParameters(), mode="default")
    cutoff = sw.optimize_threshold(base, grid_size).select("optimal_threshold").scalar()
    amt, pd, years = F.col("loan_amount"), F.col("pd"), F.col("loan_term_months").cast("double") / F.lit(12.0)
    ok, own = pd <= cutoff, {c: c in portfolio.columns for c in ("cost_of_funds", "lgd")}
    sums = base.agg(
        sw.money_sum(F.when(ok, amt * (F.lit(1.0) - pd) * F.col("interest_rate") * years)).alias("gain"),
        sw.money_sum(F.when(ok, amt * years * F.col("cost_of_funds"))).alias("funds"),
        sw.money_sum(F.when(ok, amt * years)).alias("base_funds"),
        sw.money_sum(F.when(ok, amt * pd * F.col("lgd"))).alias("loss"),
        sw.money_sum(F.when(ok, amt * pd)).alias("base_loss"))
    sums = sums.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums.columns])
    grid = F.array(*[F.struct(F.lit(float(l_)).alias("g_lgd"), F.lit(float(c)).alias("g_cof")) for l_ in lgd_values for c in cof_values])
    funds = F.col("funds") if own["cost_of_funds"] else F.col("g_cof") * F.col("base_funds")
    loss = F.col("loss") if own["lgd"] else F.col("g_lgd") * F.col("base_loss")
    return sums.select(F.inline(grid), *sums.columns).select(
        F.bround("g_lgd", 6).alias("lgd"), F.bround("g_cof", 6).alias("cost_of_funds"),
        F.bround(F.col("gain") - funds - loss, 2).alias("expected_pnl"))


def sensitivity_grid(enriched: DataFrame, threshold: float, cof_values: Sequence[float] = SENSITIVITY_COF,
                     lgd_values: Sequence[float] = SENSITIVITY_LGD) -> DataFrame:
    """P&L over an LGD x CoF grid at a fixed cutoff, from three sufficient sums.

    With CoF and LGD overridden and the row's rate and term kept,
    ``EV = A(1-p) r T/12 - c * A T/12 - l * A p``, so one aggregate (S1, S2, S3 over the
    approved rows) serves every grid point; the grid itself is a 64-row projection.
    """
    (t,) = sw.validate_cutoffs([threshold])
    pd, amt = F.col("pd"), F.col("loan_amount")
    years = F.col("loan_term_months").cast("double") / F.lit(12.0)
    ok = pd <= F.lit(t)
    sums = enriched.agg(
        sw.money_sum(F.when(ok, amt * (F.lit(1.0) - pd) * F.col("interest_rate") * years)).alias("s1"),
        sw.money_sum(F.when(ok, amt * years)).alias("s2"),
        sw.money_sum(F.when(ok, amt * pd)).alias("s3"),
    )
    grid = F.array(*[F.struct(F.lit(float(l_)).alias("lgd"), F.lit(float(c)).alias("cost_of_funds"))
                     for l_ in lgd_values for c in cof_values])
    pnl = (F.coalesce(F.col("s1").cast("double"), F.lit(0.0))
           - F.col("cost_of_funds") * F.coalesce(F.col("s2").cast("double"), F.lit(0.0))
           - F.col("lgd") * F.coalesce(F.col("s3").cast("double"), F.lit(0.0)))
    return sums.select(F.inline(grid), "s1", "s2", "s3").select(
        F.bround("lgd", 6).alias("lgd"), F.bround("cost_of_funds", 6).alias("cost_of_funds"),
        F.bround(pnl, 2).alias("expected_pnl"))


def roi_comparison(enriched: DataFrame, baselines: dict[str, float] | None = None,
                   portfolio_volume: float = 50e6, grid_size: int = 500) -> DataFrame:
    """Optimal vs baseline policies scaled to a target originated volume.

    ``scale = volume / max(optimal exposure, 1)`` applies to both sides; boost is relative to
    ``max(|baseline P&L|, 1)``. One sweep over the candidate grid plus the baseline cutoffs.
    """
    # Baselines of the comparison (naive ML cutoff, conservative, custom).
    baselines = baselines or {"naive_ml_050": 0.50, "conservative_005": 0.05, "custom_008": 0.08}
    grid = sw.candidate_grid(enriched, grid_size)
    swept = sw.policy_sweep(enriched, sorted(set(grid) | set(baselines.values())))
    in_grid = F.col("threshold").isin([float(g) for g in grid])
    whole = Window.partitionBy()
    rank = F.row_number().over(whole.orderBy(
        F.when(in_grid, F.lit(0)).otherwise(F.lit(1)), F.col("expected_pnl").desc(), F.col("threshold").asc()))
    ranked = swept.withColumn("_r", rank)

    def at_best(c: str) -> Column:
        return F.max(F.when(F.col("_r") == 1, F.col(c))).over(whole)

    ranked = ranked.select("*", *[at_best(c).alias(f"opt_{c}") for c in (
        "threshold", "expected_pnl", "expected_loss", "total_exposure", "expected_default_rate",
        "return_on_exposure")])
    names = F.create_map(*[x for k, v in baselines.items() for x in (F.lit(float(v)), F.lit(k))])
    base_rows = ranked.where(F.col("threshold").isin([float(v) for v in baselines.values()]))
    scale = F.lit(float(portfolio_volume)) / F.greatest(F.col("opt_total_exposure").cast("double"), F.lit(1.0))
    pnl_opt = F.col("opt_expected_pnl").cast("double") * scale
    pnl_base = F.col("expected_pnl").cast("double") * scale
    delta = pnl_opt - pnl_base
    return base_rows.select(
        names[F.col("threshold")].alias("baseline"),
        F.bround("threshold", 4).alias("baseline_threshold"),
        F.bround("opt_threshold", 10).alias("optimal_threshold"),
        F.bround(scale, 6).alias("scale_factor"),
        F.bround(pnl_opt, 2).alias("pnl_optimal"),
        F.bround(pnl_base, 2).alias("pnl_baseline"),
        F.bround(delta, 2).alias("delta_pnl"),
        F.bround(delta / F.greatest(F.abs(pnl_base), F.lit(1.0)) * 100.0, 4).alias("pnl_boost_pct"),
        F.bround((F.col("expected_loss").cast("double") - F.col("opt_expected_loss").cast("double")) * scale, 2)
        .alias("loss_reduction"),
        F.bround(F.col("opt_expected_default_rate") * 100.0, 4).alias("optimal_default_rate_pct"),
        F.bround(F.col("expected_default_rate") * 100.0, 4).alias("baseline_default_rate_pct"),
        F.bround(F.col("opt_return_on_exposure") * 100.0, 4).alias("optimal_return_pct"),
        F.bround(F.col("return_on_exposure") * 100.0, 4).alias("baseline_return_pct"),
    )


def policy_comparison(enriched: DataFrame, grid_size: int = 500, naive: float = 0.5) -> DataFrame:
    """Naive (p = 0.5) and optimal policy side by side, with the P&L increment."""
    opt = sw.optimize_threshold(enriched, grid_size, baseline=naive)
    rows = opt.select(F.inline(F.array(
        F.struct(F.lit("naive_050").alias("policy"), F.col("baseline_policy_05").alias("p")),
        F.struct(F.lit("optimal").alias("policy"), F.col("optimal_policy").alias("p")),
    )), F.col("baseline_policy_05.expected_pnl").alias("_naive_pnl"))
    return rows.select(
        "policy",
        F.bround("p.threshold", 10).alias("threshold"),
        F.col("p.approved_count").alias("approved_count"),
        F.bround("p.approval_rate", 6).alias("approval_rate"),
        sw.round_money("p.total_exposure").alias("total_exposure"),
        sw.round_money("p.expected_loss").alias("expected_loss"),
        sw.round_money("p.expected_pnl").alias("expected_pnl"),
        F.bround("p.expected_default_rate", 6).alias("expected_default_rate"),
        F.bround("p.return_on_exposure", 6).alias("return_on_exposure"),
        sw.round_money(F.col("p.expected_pnl") - F.col("_naive_pnl")).alias("increment_vs_naive"),
    )


def breakeven_reference(portfolio: DataFrame, group_col: str = "segment", lgd: float = DEFAULT_LGD,
                        term_months: int = DEFAULT_TERM_MONTHS) -> DataFrame:
    """Portfolio-level breakeven PD per group from its mean rate and cost of funds.

    Means are exact decimal sums over the count, so every engine gets the same double.
    """
    agg = portfolio.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("applications"),
        sw.money_sum("interest_rate").alias("_r"),
        sw.money_sum("cost_of_funds").alias("_c"),
    )
    rate = F.col("_r").cast("double") / F.col("applications")
    cof = F.col("_c").cast("double") / F.col("applications")
    years = F.lit(float(term_months)) / F.lit(12.0)
    return agg.select(
        group_col, F.col("applications").cast("bigint").alias("applications"),
        F.bround(rate, 6).alias("avg_interest_rate"), F.bround(cof, 6).alias("avg_cost_of_funds"),
        F.bround((rate - cof) * years, 6).alias("unit_margin"),
        F.bround(F.lit(float(lgd)) + cof * years, 6).alias("unit_loss"),
        F.bround(breakeven_pd(rate, cof, F.lit(float(lgd)), F.lit(float(term_months))), 6).alias("breakeven_pd"),
    )
