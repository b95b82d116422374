"""Sizing and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators import scenarios as sc
from creditspark.operators import sweep as sw
from creditspark.operators.sizing import amount_policy
from creditspark.plans.policy_queries import _grid_sql, _optimum_sql, enriched, portfolio
from creditspark.plans.registry import register
from creditspark.plans.sql_base import PORTFOLIO_CTE, dec, enriched_cte, lit, money, policy_select

# ------------------------------------------------------------------------------ O6


@register("amount_policy", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('default')},
z AS (SELECT *, amt_ * POW(LEAST(1e0, GREATEST(0e0, 1e0 - pd_ / CASE WHEN be_ > 0 THEN be_ ELSE 1e0 END)), 15e-1) AS sized_ FROM e),
sz AS (SELECT *, CASE WHEN ev_ > 0 AND sized_ >= 500e0 THEN sized_ ELSE 0e0 END AS app_ FROM z),
a AS (SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN app_ > 0 THEN 1 ELSE 0 END) AS BIGINT) AS k,
   SUM({dec('amt_')}) AS req, SUM(CASE WHEN app_ > 0 THEN {dec('app_')} ELSE 0 END) AS alloc,
   SUM(CASE WHEN app_ > 0 THEN {dec("(1e0-pd_)*(app_*((rate_-cof_)*(term_/12e0))) - pd_*(app_*(lgd_+cof_*(term_/12e0)))")} ELSE 0 END) AS pnl,
   SUM(CASE WHEN app_ > 0 THEN {dec("pd_*(app_*(lgd_+cof_*(term_/12e0)))")} ELSE 0 END) AS loss FROM sz)
SELECT n AS total_applications, CASE WHEN k > 0 AND alloc <> 0 THEN k ELSE 0 END AS approved_count,
  ROUND_EVEN(CASE WHEN k > 0 AND alloc <> 0 THEN k / CAST(n AS DOUBLE) ELSE 0e0 END, 6) AS approval_rate,
  {money('req')} AS requested_exposure, {money('CASE WHEN k > 0 AND alloc <> 0 THEN alloc ELSE 0 END')} AS allocated_exposure,
  {money('CASE WHEN k > 0 AND alloc <> 0 THEN pnl ELSE 0 END')} AS expected_pnl,
  {money('CASE WHEN k > 0 AND alloc <> 0 THEN loss ELSE 0 END')} AS expected_loss,
  ROUND_EVEN(CASE WHEN k > 0 AND alloc <> 0 THEN CAST(pnl AS DOUBLE) / CAST(alloc AS DOUBLE) ELSE 0e0 END, 6) AS return_on_exposure
FROM a""")
def q_amount_policy(spark, sf_dir):
    a = amount_policy(enriched(spark, sf_dir, "default"), 1.5, 500.0)
    return a.select(
        "total_applications", "approved_count", F.bround("approval_rate", 6).alias("approval_rate"),
        *[sw.round_money(c).alias(c) for c in ("requested_exposure", "allocated_exposure", "expected_pnl",
                                                "expected_loss")],
        F.bround("return_on_exposure", 6).alias("return_on_exposure"))


# ------------------------------------------------------------------------------ O8 / O9

ROI_BASELINES = {"naive_ml_050": 0.50, "conservative_005": 0.05, "custom_008": 0.08}


def _roi_sql() -> str:
    base_vals = ", ".join(f"('{k}', {lit(v)})" for k, v in ROI_BASELINES.items())
    return f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')},
g AS ({_grid_sql(500)}),
c AS (SELECT threshold FROM g UNION SELECT t FROM (VALUES {base_vals}) AS bb(nm, t)),
pol AS ({policy_select()}),
best AS (SELECT * FROM pol WHERE threshold IN (SELECT threshold FROM g) ORDER BY expected_pnl DESC, threshold ASC LIMIT 1),
bl AS (SELECT nm, t FROM (VALUES {base_vals}) AS bb(nm, t)),
j AS (SELECT bl.nm, p.*, best.threshold AS o_t, CAST(best.expected_pnl AS DOUBLE) AS o_pnl,
        CAST(best.expected_loss AS DOUBLE) AS o_loss, best.expected_default_rate AS o_dr, best.return_on_exposure AS o_roe,
        5e7 / GREATEST(CAST(best.total_exposure AS DOUBLE), 1e0) AS sc
      FROM bl JOIN pol p ON p.threshold = bl.t, best)
SELECT nm AS baseline, ROUND_EVEN(threshold, 4) AS baseline_threshold, ROUND_EVEN(o_t, 10) AS optimal_threshold,
  ROUND_EVEN(sc, 6) AS scale_factor, ROUND_EVEN(o_pnl * sc, 2) AS pnl_optimal,
  ROUND_EVEN(CAST(expected_pnl AS DOUBLE) * sc, 2) AS pnl_baseline,
  ROUND_EVEN(o_pnl * sc - CAST(expected_pnl AS DOUBLE) * sc, 2) AS delta_pnl,
  ROUND_EVEN((o_pnl * sc - CAST(expected_pnl AS DOUBLE) * sc) / GREATEST(ABS(CAST(expected_pnl AS DOUBLE) * sc), 1e0) * 100e0, 4) AS pnl_boost_pct,
  ROUND_EVEN((CAST(expected_loss AS DOUBLE) - o_loss) * sc, 2) AS loss_reduction,
  ROUND_EVEN(o_dr * 100e0, 4) AS optimal_default_rate_pct, ROUND_EVEN(expected_default_rate * 100e0, 4) AS baseline_default_rate_pct,
  ROUND_EVEN(o_roe * 100e0, 4) AS optimal_return_pct, ROUND_EVEN(return_on_exposure * 100e0, 4) AS baseline_return_pct
FROM j"""


@register("roi_comparison", oracle=_roi_sql)
def q_roi_comparison(spark, sf_dir):
    return sc.roi_comparison(enriched(spark, sf_dir, "override"), ROI_BASELINES, 50e6, 500)


@register("policy_comparison", oracle=lambda: f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')},
c AS ({_grid_sql(500)}),
pol AS ({policy_select()}),
best AS (SELECT 'optimal' AS policy, * FROM pol ORDER BY expected_pnl DESC, threshold ASC LIMIT 1),
base AS (SELECT 'naive_050' AS policy, * FROM pol WHERE threshold = 5e-1),
u AS (SELECT * FROM best UNION ALL SELECT * FROM base)
SELECT policy, ROUND_EVEN(threshold, 10) AS threshold, approved_count, ROUND_EVEN(approval_rate, 6) AS approval_rate,
  {money('total_exposure')} AS total_exposure, {money('expected_loss')} AS expected_loss, {money('expected_pnl')} AS expected_pnl,
  ROUND_EVEN(expected_default_rate, 6) AS expected_default_rate, ROUND_EVEN(return_on_exposure, 6) AS return_on_exposure,
  {money('expected_pnl - (SELECT expected_pnl FROM base)')} AS increment_vs_naive
FROM u""")
def q_policy_comparison(spark, sf_dir):
    return sc.policy_comparison(enriched(spark, sf_dir, "override"), 500)


# ------------------------------------------------------------------------------ O10 / O11 / O12


def _fixed_stress_sql() -> str:
    scen = ", ".join(f"('{s.name}', {lit(s.pd_multiplier)}, {lit(s.lgd)})" for s in sc.FIXED_CUTOFF_SCENARIOS)
    return f"""WITH {PORTFOLIO_CTE},
{enriched_cte('default')},
c AS ({_grid_sql(500)}),
pol AS ({policy_select()}),
best AS (SELECT * FROM pol ORDER BY expected_pnl DESC, threshold ASC LIMIT 1),
sc AS (SELECT * FROM (VALUES {scen}) AS v(scenario, mult, lgd_s)),
x0 AS (SELECT sc.scenario, LEAST(1e0, GREATEST(0e0, p.pd * sc.mult)) AS pd_, p.loan_amount AS amt_,
          p.interest_rate AS rate_, p.cost_of_funds AS cof_, CAST(p.loan_term_months AS DOUBLE) AS term_, sc.lgd_s AS lgd_
       FROM portfolio p, sc),
x AS (SELECT *, amt_*(rate_-cof_)*(term_/12e0) AS gain_, amt_*(lgd_+cof_*(term_/12e0)) AS loss_,
        (1e0-pd_)*(amt_*(rate_-cof_)*(term_/12e0)) - pd_*(amt_*(lgd_+cof_*(term_/12e0))) AS ev_ FROM x0),
ev AS (SELECT x.scenario, CAST(SUM(CASE WHEN x.pd_ <= best.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n,
         SUM(CASE WHEN x.pd_ <= best.threshold THEN {dec('x.ev_')} ELSE 0 END) AS pnl,
         SUM(CASE WHEN x.pd_ <= best.threshold THEN {dec('x.pd_*x.loss_')} ELSE 0 END) AS loss,
         SUM(CASE WHEN x.pd_ <= best.threshold THEN {dec('x.amt_')} ELSE 0 END) AS expo,
         CAST(SUM(CASE WHEN x.pd_ <= best.threshold THEN {dec('x.pd_')} ELSE 0 END) AS DOUBLE) AS pds,
         ANY_VALUE(best.threshold) AS t, ANY_VALUE(CAST(best.expected_pnl AS DOUBLE)) AS bp
       FROM x, best GROUP BY x.scenario)
SELECT scenario, t AS threshold, n AS approved_count,
  {money('CASE WHEN n > 0 THEN pnl ELSE 0 END')} AS expected_pnl, {money('CASE WHEN n > 0 THEN loss ELSE 0 END')} AS expected_loss,
  ROUND_EVEN(CASE WHEN n > 0 THEN pds / n ELSE 0e0 END * 100e0, 4) AS default_rate_pct,
  ROUND_EVEN(CASE WHEN n > 0 AND expo > 0 THEN CAST(pnl AS DOUBLE) / CAST(expo AS DOUBLE) ELSE 0e0 END * 100e0, 4) AS return_pct,
  ROUND_EVEN((CAST(CASE WHEN n > 0 THEN pnl ELSE 0 END AS DOUBLE) - bp) / bp * 100e0, 4) AS pnl_change_vs_base_pct
FROM ev"""


@register("stress_fixed_cutoff", oracle=_fixed_stress_sql)
def q_stress_fixed_cutoff(spark, sf_dir):
    return sc.stress_fixed_cutoff(portfolio(spark, sf_dir), sc.FIXED_CUTOFF_SCENARIOS, grid_size=500)


def _reopt_sql() -> str:
    scen = ", ".join(f"('{s.name}', {lit(s.pd_multiplier)}, {lit(s.shifted_cof())}, {lit(s.shifted_lgd())})"
                     for s in sc.REOPTIMIZED_SCENARIOS)
    fr = ", ".join(lit(f) for f in sw.linspace(0.0, 1.0, 300))
    fixed = ", ".join(f"({lit(x)})" for x in [0.0, 0.5, 1.0] + sw.linspace(0.0, 1.0, 300))
    return f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')},
cb AS ({_grid_sql(500)}),
polb AS ({policy_select(cut='cb')}),
bbest AS (SELECT * FROM polb ORDER BY expected_pnl DESC, threshold ASC LIMIT 1),
sc AS (SELECT * FROM (VALUES {scen}) AS v(scenario, mult, cof_s, lgd_s)),
x0 AS (SELECT sc.scenario, LEAST(999e-3, GREATEST(1e-3, p.pd * sc.mult)) AS pd_, p.loan_amount AS amt_,
          18e-2 AS rate_, sc.cof_s AS cof_, 12e0 AS term_, sc.lgd_s AS lgd_ FROM portfolio p, sc),
x AS (SELECT *, amt_*(rate_-cof_)*(term_/12e0) AS gain_, amt_*(lgd_+cof_*(term_/12e0)) AS loss_,
        (1e0-pd_)*(amt_*(rate_-cof_)*(term_/12e0)) - pd_*(amt_*(lgd_+cof_*(term_/12e0))) AS ev_ FROM x0),
cand AS (SELECT DISTINCT scenario, LEAST(1e0, GREATEST(0e0, t)) AS threshold FROM (
    SELECT sc.scenario, v.t FROM sc, (VALUES {fixed}) AS v(t)
    UNION ALL SELECT scenario, UNNEST(quantile_cont(pd_, [{fr}])) FROM x GROUP BY scenario
    UNION ALL SELECT scenario, MIN(pd_) FROM x GROUP BY scenario
    UNION ALL SELECT scenario, MAX(pd_) FROM x GROUP BY scenario) AS u(scenario, t)),
pol AS (SELECT cand.scenario, cand.threshold,
          CAST(SUM(CASE WHEN x.pd_ <= cand.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(COUNT(*) AS BIGINT) AS tot,
          SUM(CASE WHEN x.pd_ <= cand.threshold THEN {dec('x.ev_')} ELSE 0 END) AS pnl
        FROM cand JOIN x ON cand.scenario = x.scenario GROUP BY cand.scenario, cand.threshold),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scenario ORDER BY CASE WHEN n > 0 THEN pnl ELSE 0 END DESC, threshold ASC) AS rk FROM pol)
SELECT scenario, ROUND_EVEN(r.threshold, 10) AS optimal_threshold, n AS approved_count,
  ROUND_EVEN(n / CAST(tot AS DOUBLE), 6) AS approval_rate, {money('CASE WHEN n > 0 THEN pnl ELSE 0 END')} AS expected_pnl,
  ROUND_EVEN((r.threshold - bbest.threshold) * 100e0, 6) AS delta_threshold_pp,
  ROUND_EVEN((n / CAST(tot AS DOUBLE) - bbest.approval_rate) * 100e0, 6) AS delta_approval_pp,
  ROUND_EVEN(CAST(CASE WHEN n > 0 THEN pnl ELSE 0 END AS DOUBLE) - CAST(bbest.expected_pnl AS DOUBLE), 2) AS delta_pnl
FROM r, bbest WHERE rk = 1"""


@register("stress_reoptimized", oracle=_reopt_sql)
def q_stress_reoptimized(spark, sf_dir):
    return sc.stress_reoptimized(portfolio(spark, sf_dir), sc.REOPTIMIZED_SCENARIOS, 500, 300)


SENSITIVITY_CUTOFF = 0.20


def _sensitivity_sql() -> str:
    grid = ", ".join(f"({lit(l_)}, {lit(c)})" for l_ in sc.SENSITIVITY_LGD for c in sc.SENSITIVITY_COF)
    return f"""WITH {PORTFOLIO_CTE},
g AS (SELECT * FROM (VALUES {grid}) AS v(lgd, cof)),
a AS (SELECT * FROM portfolio WHERE pd <= {lit(SENSITIVITY_CUTOFF)})
SELECT ROUND_EVEN(g.lgd, 6) AS lgd, ROUND_EVEN(g.cof, 6) AS cost_of_funds,
  {money("SUM(" + dec("(1e0-a.pd)*(a.loan_amount*(a.interest_rate-g.cof)*(a.loan_term_months/12e0)) - a.pd*(a.loan_amount*(g.lgd+g.cof*(a.loan_term_months/12e0)))") + ")")} AS expected_pnl
FROM g CROSS JOIN a GROUP BY g.lgd, g.cof"""


@register("sensitivity_grid", oracle=_sensitivity_sql)
def q_sensitivity_grid(spark, sf_dir):
    return sc.sensitivity_grid(enriched(spark, sf_dir, "default"), SENSITIVITY_CUTOFF)


def _sensitivity_default_sql() -> str:
    grid = ", ".join(f"({lit(l_)}, {lit(c)})" for l_ in sc.SENSITIVITY_LGD for c in sc.SENSITIVITY_COF)
    return f"""WITH {PORTFOLIO_CTE},
opt AS (SELECT optimal_threshold AS t FROM ({_optimum_sql('default')})),
g AS (SELECT * FROM (VALUES {grid}) AS v(lgd, cof)),
a AS (SELECT * FROM portfolio, opt WHERE pd <= opt.t)
SELECT ROUND_EVEN(g.lgd, 6) AS lgd, ROUND_EVEN(g.cof, 6) AS cost_of_funds,
  {money("SUM(" + dec("(1e0-a.pd)*(a.loan_amount*(a.interest_rate-a.cost_of_funds)*(a.loan_term_months/12e0)) - a.pd*(a.loan_amount*(g.lgd+a.cost_of_funds*(a.loan_term_months/12e0)))") + ")")} AS expected_pnl
FROM g CROSS JOIN a GROUP BY g.lgd, g.cof"""


@register("sensitivity_default", oracle=_sensitivity_default_sql)
def q_sensitivity_default(spark, sf_dir):
    return sc.sensitivity_default(portfolio(spark, sf_dir))


@register("breakeven_reference", oracle=f"""WITH {PORTFOLIO_CTE},
a AS (SELECT segment, CAST(COUNT(*) AS BIGINT) AS applications,
        CAST(SUM({dec('interest_rate')}) AS DOUBLE) / COUNT(*) AS r, CAST(SUM({dec('cost_of_funds')}) AS DOUBLE) / COUNT(*) AS c
      FROM portfolio GROUP BY segment)
SELECT segment, applications, ROUND_EVEN(r, 6) AS avg_interest_rate, ROUND_EVEN(c, 6) AS avg_cost_of_funds,
  ROUND_EVEN((r - c) * (12e0/12e0), 6) AS unit_margin, ROUND_EVEN(45e-2 + c * (12e0/12e0), 6) AS unit_loss,
  ROUND_EVEN(CASE WHEN (r - c) * (12e0/12e0) <= 0 THEN 0e0
       WHEN (r - c) * (12e0/12e0) + (45e-2 + c * (12e0/12e0)) <= 0 THEN 0e0
       ELSE LEAST(1e0, GREATEST(0e0, ((r - c) * (12e0/12e0)) / (((r - c) * (12e0/12e0)) + (45e-2 + c * (12e0/12e0))))) END, 6) AS breakeven_pd
FROM a""")
def q_breakeven_reference(spark, sf_dir):
    return sc.breakeven_reference(portfolio(spark, sf_dir), "segment")


