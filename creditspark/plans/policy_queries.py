"""Portfolio, economics and cutoff-policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions.economics import EconomicParameters, enrich_portfolio, override_terms
from creditspark.functions.scorecard import FUNNEL_SCORECARD, scorecard_pd
from creditspark.operators import sweep as sw
from creditspark.operators.profile import portfolio_summary
from creditspark.plans.registry import register
from creditspark.plans.sql_base import (
    PORTFOLIO_CTE,
    dec,
    enriched_cte,
    lit,
    money,
    policy_select,
    rounded_policy,
    values_table,
)
from creditspark.sources.portfolio import PORTFOLIO_SEED, materialized_portfolio, with_application_ref

OVERRIDE = EconomicParameters()  # rate .18, CoF .05, LGD .45, term 12
ENRICH_OUT = ["application_id", "pd", "loan_amount", "interest_rate", "cost_of_funds", "loan_term_months", "lgd",
              "net_gain_performing", "net_loss_default", "expected_value", "breakeven_pd"]
ENRICH_SQL_OUT = """application_id, pd_ AS pd, amt_ AS loan_amount, rate_ AS interest_rate, cof_ AS cost_of_funds,
  term_ AS loan_term_months, lgd_ AS lgd, gain_ AS net_gain_performing, loss_ AS net_loss_default, ev_ AS expected_value,
  be_ AS breakeven_pd"""


def portfolio(spark, sf_dir):
    """The derived portfolio, built once per source snapshot and scanned by every query."""
    return materialized_portfolio(spark, sf_dir)


def enriched(spark, sf_dir, mode="default", params=OVERRIDE):
    return enrich_portfolio(portfolio(spark, sf_dir), params, mode=mode)


# ------------------------------------------------------------------------------ S7 / A2

BUILD_COLS = ["application_id", "application_ref", "segment", "monthly_income", "debt_to_income",
              "historical_delinquencies", "revolving_utilization", "loan_amount", "loan_term_months",
              "interest_rate", "cost_of_funds", "pd", "default_flag"]


@register("portfolio_build", oracle=f"""WITH {PORTFOLIO_CTE}
SELECT application_id, printf('APP_{PORTFOLIO_SEED}_%06d', application_id) AS application_ref, segment, monthly_income,
  debt_to_income, historical_delinquencies, revolving_utilization, loan_amount, loan_term_months, interest_rate,
  cost_of_funds, pd, default_flag FROM portfolio""")
def q_portfolio_build(spark, sf_dir):
    return with_application_ref(portfolio(spark, sf_dir), PORTFOLIO_SEED).select(*BUILD_COLS)


@register("portfolio_summary", oracle=f"""WITH {PORTFOLIO_CTE}
SELECT CAST(COUNT(*) AS BIGINT) AS total_applications, ROUND_EVEN(SUM(loan_amount), 2) AS total_exposure,
  CAST(SUM(default_flag) AS BIGINT) AS default_count, ROUND_EVEN(SUM(default_flag) / CAST(COUNT(*) AS DOUBLE), 5) AS default_rate,
  ROUND_EVEN(AVG(pd), 5) AS avg_pd, ROUND_EVEN(AVG(loan_amount), 2) AS avg_loan_amount,
  ROUND_EVEN(AVG(monthly_income), 2) AS avg_monthly_income, ROUND_EVEN(AVG(interest_rate), 5) AS avg_interest_rate,
  ROUND_EVEN(AVG(cost_of_funds), 5) AS avg_cost_of_funds, CAST({PORTFOLIO_SEED} AS BIGINT) AS seed FROM portfolio""")
def q_portfolio_summary(spark, sf_dir):
    return portfolio_summary(portfolio(spark, sf_dir), seed=PORTFOLIO_SEED)


# ------------------------------------------------------------------------------ P1-P10

@register("enrich_portfolio", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('default')}
SELECT {ENRICH_SQL_OUT} FROM e""")
def q_enrich_portfolio(spark, sf_dir):
    return enriched(spark, sf_dir, "default").select(*ENRICH_OUT)


@register("override_terms", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')}
SELECT {ENRICH_SQL_OUT} FROM e""")
def q_override_terms(spark, sf_dir):
    return override_terms(portfolio(spark, sf_dir), OVERRIDE).select(*ENRICH_OUT)


@register("scorecard_recalibrated", oracle=f"""WITH {PORTFOLIO_CTE}
SELECT application_id, pd AS base_pd,
  ROUND(1e0/(1e0+EXP(-(-28e-1+18e-1*debt_to_income+15e-1*revolving_utilization+55e-2*historical_delinquencies-5e-1*LN(monthly_income/1e3)+12e-2*(loan_amount/monthly_income)))),5) AS funnel_pd
FROM portfolio""")
def q_scorecard_recalibrated(spark, sf_dir):
    p = portfolio(spark, sf_dir)
    funnel = scorecard_pd(F.col("monthly_income"), F.col("debt_to_income"), F.col("revolving_utilization"),
                          F.col("historical_delinquencies"), F.col("loan_amount"), FUNNEL_SCORECARD)
    return p.select("application_id", F.col("pd").alias("base_pd"), funnel.alias("funnel_pd"))


# ------------------------------------------------------------------------------ A1 / O1 / O2

@register("evaluate_policy", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')},
{values_table('c', 'threshold', [0.2])},
pol AS ({policy_select()})
{rounded_policy('pol', threshold_dp=6, rate_dp=6)}""")
def q_evaluate_policy(spark, sf_dir):
    return sw.round_policy(sw.evaluate_policy(enriched(spark, sf_dir, "override"), 0.20), rate=6, threshold=6)


@register("policy_sweep", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('default')},
{values_table('c', 'threshold', sw.DEFAULT_SIMULATION_CUTOFFS)},
pol AS ({policy_select()})
{rounded_policy('pol')}""")
def q_policy_sweep(spark, sf_dir):
    return sw.round_policy(sw.policy_sweep(enriched(spark, sf_dir, "default"), sw.DEFAULT_SIMULATION_CUTOFFS))


def _grid_sql(grid_size: int = 500, extremes: bool = True, src: str = "portfolio", pd: str = "pd") -> str:
    """O2 in SQL: bounds, uniform grid and exact quantiles of ``pd`` (n >= grid_size assumed)."""
    fr = ", ".join(lit(f) for f in sw.linspace(0.0, 1.0, grid_size))
    fixed = ", ".join(f"({lit(x)})" for x in [0.0, 0.5, 1.0] + sw.linspace(0.0, 1.0, grid_size))
    parts = [f"SELECT t FROM (VALUES {fixed}) AS v(t)",
             f"SELECT UNNEST(quantile_cont({pd}, [{fr}])) AS t FROM {src}"]
    if extremes:
        parts += [f"SELECT MIN({pd}) FROM {src}", f"SELECT MAX({pd}) FROM {src}"]
    return ("SELECT DISTINCT LEAST(1e0, GREATEST(0e0, t)) AS threshold FROM ("
            + " UNION ALL ".join(parts) + ") AS g(t)")


@register("candidate_grid", oracle=f"""WITH {PORTFOLIO_CTE}
SELECT ROUND_EVEN(threshold, 10) AS threshold FROM ({_grid_sql()}) x""")
def q_candidate_grid(spark, sf_dir):
    grid = sw.candidate_grid(enriched(spark, sf_dir, "override"), 500)
    df = spark.createDataFrame([(t,) for t in grid], "threshold double")
    return df.select(F.bround("threshold", 10).alias("threshold")).distinct()


# ------------------------------------------------------------------------------ O3 / O4

def _optimum_sql(mode: str, metric: str = "expected_pnl", grid_size: int = 500) -> str:
    order = metric
    return f"""WITH {PORTFOLIO_CTE},
{enriched_cte(mode)},
c AS ({_grid_sql(grid_size)}),
pol AS ({policy_select()}),
best AS (SELECT * FROM pol ORDER BY {order} DESC, threshold ASC LIMIT 1),
base AS (SELECT * FROM pol WHERE threshold = 5e-1),
ind AS (SELECT SUM(CASE WHEN ev_ > 0 THEN {dec('ev_')} ELSE 0 END) AS v FROM e)
SELECT '{metric}' AS objective_metric, ROUND_EVEN(best.threshold, 10) AS optimal_threshold,
  best.total_applications, best.approved_count, ROUND_EVEN(best.approval_rate, 6) AS approval_rate,
  {money('best.total_exposure')} AS total_exposure, {money('best.gross_margin')} AS gross_margin,
  {money('best.expected_loss')} AS expected_loss, {money('best.expected_pnl')} AS expected_pnl,
  ROUND_EVEN(best.expected_default_rate, 6) AS expected_default_rate,
  ROUND_EVEN(best.return_on_exposure, 6) AS return_on_exposure,
  base.approved_count AS baseline_approved_count, {money('base.expected_pnl')} AS baseline_pnl,
  {money('ind.v')} AS individual_optimal_pnl,
  {money('best.expected_pnl - base.expected_pnl')} AS incremental_pnl_vs_baseline
FROM best, base, ind"""


@register("optimize_threshold", oracle=_optimum_sql("override"))
def q_optimize_threshold(spark, sf_dir):
    return sw.flatten_optimum(sw.optimize_threshold(enriched(spark, sf_dir, "override"), 500))


@register("optimize_return", oracle=_optimum_sql("default", "return_on_exposure"))
def q_optimize_return(spark, sf_dir):
    return sw.flatten_optimum(sw.optimize_threshold(enriched(spark, sf_dir, "default"), 500,
                                                    metric="return_on_exposure"))


def _constrained_sql(where: str) -> str:
    return f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')},
c AS ({_grid_sql(500, extremes=False)}),
pol AS ({policy_select()}),
feas AS (SELECT * FROM pol WHERE {where}),
pick AS (SELECT * FROM feas ORDER BY expected_pnl DESC, threshold ASC LIMIT 1),
fallback AS (SELECT * FROM pol WHERE threshold = 0e0 AND NOT EXISTS (SELECT 1 FROM feas)),
res AS (SELECT * FROM pick UNION ALL SELECT * FROM fallback)
{rounded_policy('res', threshold_dp=10, rate_dp=6)}"""


@register("constrained_policy", oracle=_constrained_sql(
    "(approved_count = 0 OR expected_default_rate <= 8e-2) AND approval_rate >= 5e-1 AND expected_loss <= 2e6"))
def q_constrained_policy(spark, sf_dir):
    best = sw.optimize_constrained(enriched(spark, sf_dir, "override"), 500, max_default_rate=0.08,
                                   min_approval_rate=0.5, max_expected_loss=2e6)
    return sw.round_policy(best, rate=6, threshold=10)


@register("constrained_infeasible", oracle=_constrained_sql(
    "(approved_count = 0 OR expected_default_rate <= 1e-4) AND approval_rate >= 95e-2"))
def q_constrained_infeasible(spark, sf_dir):
    best = sw.optimize_constrained(enriched(spark, sf_dir, "override"), 500, max_default_rate=0.0001,
                                   min_approval_rate=0.95)
    return sw.round_policy(best, rate=6, threshold=10)


# ------------------------------------------------------------------------------ O5 / O7

@register("tradeoff_curve", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('default')},
{values_table('c', 'threshold', sw.linspace(0.0, 1.0, 100))},
pol AS ({policy_select()})
SELECT ROUND_EVEN(threshold, 4) AS threshold, ROUND_EVEN(approval_rate, 4) AS approval_rate, approved_count,
  {money('total_exposure')} AS total_exposure, {money('expected_loss')} AS expected_loss,
  ROUND_EVEN(CASE WHEN total_exposure > 0 THEN CAST(expected_loss AS DOUBLE) / CAST(total_exposure AS DOUBLE) ELSE 0e0 END, 4) AS expected_loss_rate,
  {money('gross_margin')} AS gross_margin, {money('expected_pnl')} AS net_financial_margin,
  ROUND_EVEN(return_on_exposure, 4) AS return_on_exposure, ROUND_EVEN(expected_default_rate, 4) AS expected_default_rate
FROM pol""")
def q_tradeoff_curve(spark, sf_dir):
    return sw.tradeoff_curve(enriched(spark, sf_dir, "default"), 100)


WHATIF_CUTOFFS = sw.linspace(0.01, 0.60, 60)


@register("whatif_curve", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')},
{values_table('c', 'threshold', WHATIF_CUTOFFS)},
pol AS ({policy_select()})
{rounded_policy('pol', rate_dp=6)}""")
def q_whatif_curve(spark, sf_dir):
    return sw.round_policy(sw.policy_sweep(enriched(spark, sf_dir, "override"), WHATIF_CUTOFFS), rate=6)
