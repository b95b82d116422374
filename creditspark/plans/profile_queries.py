"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators import profile as pf
from creditspark.operators import woe as wo
from creditspark.operators.sweep import linspace
from creditspark.plans.policy_queries import portfolio
from creditspark.plans.registry import register
from creditspark.plans.sql_base import PORTFOLIO_CTE, lit

# Columns of the profiling reports.
DESCRIBE_COLUMNS = ["monthly_income", "debt_to_income", "revolving_utilization", "historical_delinquencies",
                    "loan_amount", "loan_term_months", "interest_rate", "cost_of_funds", "pd"]
CORR_COLUMNS = ["monthly_income", "debt_to_income", "revolving_utilization", "historical_delinquencies",
                "loan_amount", "interest_rate", "default_flag"]
IV_FEATURES = ["debt_to_income", "revolving_utilization", "historical_delinquencies", "monthly_income",
               "loan_amount", "interest_rate"]
HIST_CONTINUOUS = ["monthly_income", "debt_to_income", "revolving_utilization"]
HIST_DISCRETE = ["historical_delinquencies"]


def _long_sql(cols, src="portfolio", extra="") -> str:
    e = f", {extra}" if extra else ""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value{e} FROM {src}" for c in cols)


@register("default_counts", oracle=f"""WITH {PORTFOLIO_CTE},
c AS (SELECT default_flag, CAST(COUNT(*) AS BIGINT) AS count FROM portfolio GROUP BY default_flag)
SELECT default_flag, count, ROUND_EVEN(count / CAST(SUM(count) OVER () AS DOUBLE), 6) AS share,
  ROUND_EVEN(CAST(SUM(default_flag * count) OVER () AS DOUBLE) / SUM(count) OVER (), 6) AS bad_rate FROM c""")
def q_default_counts(spark, sf_dir):
    return pf.default_counts(portfolio(spark, sf_dir), "default_flag")


# Quartiles are nearest-rank: the value at 0-based rank round((n-1) q) among non-null values,
# found here by numbering every row (brute force), not by the Spark plan's rank-interval join.
@register("describe_portfolio", oracle=lambda: f"""WITH {PORTFOLIO_CTE},
l AS ({_long_sql(DESCRIBE_COLUMNS)}),
r AS (SELECT column_name, value, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY value) - 1 AS rk,
        COUNT(*) OVER (PARTITION BY column_name) AS n FROM l WHERE value IS NOT NULL),
qt AS (SELECT column_name,
        MAX(CASE WHEN rk = ROUND((n - 1) * 25e-2) THEN value END) AS q25,
        MAX(CASE WHEN rk = ROUND((n - 1) * 5e-1) THEN value END) AS q50,
        MAX(CASE WHEN rk = ROUND((n - 1) * 75e-2) THEN value END) AS q75 FROM r GROUP BY column_name),
m AS (SELECT column_name, CAST(COUNT(value) AS BIGINT) AS count,
  CAST(SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count,
  CAST(ROUND(CAST(CAST(SUM(CAST(value AS DECIMAL(38,9))) AS DOUBLE) / COUNT(value) AS DECIMAL(38,9)), 6) AS DOUBLE) AS mean,
  ROUND_EVEN(STDDEV_SAMP(value), 6) AS std, ROUND_EVEN(MIN(value), 6) AS min, ROUND_EVEN(MAX(value), 6) AS max
  FROM l GROUP BY column_name)
SELECT m.column_name, count, null_count, mean, std, min,
  ROUND_EVEN(q25, 8) AS q25, ROUND_EVEN(q50, 8) AS q50, ROUND_EVEN(q75, 8) AS q75, max
FROM m LEFT JOIN qt ON m.column_name = qt.column_name""")
def q_describe_portfolio(spark, sf_dir):
    return pf.describe(portfolio(spark, sf_dir), DESCRIBE_COLUMNS)


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLUMNS:
        for b in CORR_COLUMNS:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND_EVEN(CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM portfolio")
    return f"WITH {PORTFOLIO_CTE}\n" + "\nUNION ALL ".join(parts)


@register("correlation_matrix", oracle=_corr_sql)
def q_correlation_matrix(spark, sf_dir):
    return pf.correlation_matrix(portfolio(spark, sf_dir), CORR_COLUMNS)


def _woe_sql() -> str:
    fr = ", ".join(lit(f) for f in linspace(0.0, 1.0, 11))
    return f"""WITH {PORTFOLIO_CTE},
l AS ({_long_sql(IV_FEATURES, extra='CAST(default_flag AS DOUBLE) AS y').replace("column_name", "feature")}),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [{fr}]))) AS edges FROM l WHERE value IS NOT NULL GROUP BY feature),
bn AS (SELECT l.feature, y, len(list_filter(edges[2:len(edges)-1], lambda e: e < value)) AS bin
       FROM l JOIN ed ON l.feature = ed.feature WHERE value IS NOT NULL),
c AS (SELECT feature, CAST(bin AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS total, CAST(SUM(y) AS BIGINT) AS bads
      FROM bn GROUP BY feature, bin),
sh AS (SELECT *, total - bads AS goods,
        (total - bads) / CAST(SUM(total - bads) OVER (PARTITION BY feature) AS DOUBLE) AS dg,
        bads / CAST(SUM(bads) OVER (PARTITION BY feature) AS DOUBLE) AS db FROM c),
w AS (SELECT feature, bin, total, bads, goods, CASE WHEN dg = 0 THEN 1e-4 ELSE dg END AS dist_goods,
        CASE WHEN db = 0 THEN 1e-4 ELSE db END AS dist_bads FROM sh)"""


WOE_COLUMNS = ["feature", "bin", "total", "bads", "goods", "dist_goods", "dist_bads", "woe", "iv_component"]


@register("woe_bins", oracle=lambda: _woe_sql() + """
SELECT feature, bin, total, bads, goods, ROUND_EVEN(dist_goods, 6) AS dist_goods, ROUND_EVEN(dist_bads, 6) AS dist_bads,
  ROUND_EVEN(LN(dist_goods / dist_bads), 6) AS woe, ROUND_EVEN((dist_goods - dist_bads) * LN(dist_goods / dist_bads), 6) AS iv_component
FROM w""")
def q_woe_bins(spark, sf_dir):
    w = wo.woe_bins(portfolio(spark, sf_dir), IV_FEATURES, "default_flag", 10)
    return w.select(*[F.bround(c, 6).alias(c) if c in ("dist_goods", "dist_bads", "woe", "iv_component") else c
                      for c in WOE_COLUMNS])


@register("iv_ranking", oracle=lambda: _woe_sql() + """
SELECT feature, ROUND_EVEN(SUM((dist_goods - dist_bads) * LN(dist_goods / dist_bads)), 4) AS information_value,
  CAST(COUNT(*) AS BIGINT) AS n_bins,
  CASE WHEN SUM((dist_goods - dist_bads) * LN(dist_goods / dist_bads)) < 2e-2 THEN 'not_predictive'
       WHEN SUM((dist_goods - dist_bads) * LN(dist_goods / dist_bads)) < 1e-1 THEN 'weak'
       WHEN SUM((dist_goods - dist_bads) * LN(dist_goods / dist_bads)) < 3e-1 THEN 'medium'
       WHEN SUM((dist_goods - dist_bads) * LN(dist_goods / dist_bads)) < 5e-1 THEN 'strong' ELSE 'suspicious' END AS strength
FROM w GROUP BY feature""")
def q_iv_ranking(spark, sf_dir):
    return wo.iv_ranking(wo.woe_bins(portfolio(spark, sf_dir), IV_FEATURES, "default_flag", 10))


def _hist_sql() -> str:
    return f"""WITH {PORTFOLIO_CTE},
l AS ({_long_sql(HIST_CONTINUOUS)}),
r AS (SELECT column_name, MIN(value) AS lo, MAX(value) AS hi FROM l WHERE value IS NOT NULL GROUP BY column_name),
hb AS (SELECT l.column_name, lo, hi, CAST(CASE WHEN hi - lo <= 0 THEN 0 ELSE LEAST(FLOOR((value - lo) / (hi - lo) * 40e0), 39) END AS BIGINT) AS bin
      FROM l JOIN r ON l.column_name = r.column_name WHERE value IS NOT NULL)
SELECT column_name AS feature, bin, ROUND_EVEN(lo + (hi - lo) / 40e0 * bin, 6) AS bin_lo,
  ROUND_EVEN(lo + (hi - lo) / 40e0 * (bin + 1), 6) AS bin_hi, CAST(COUNT(*) AS BIGINT) AS count
FROM hb GROUP BY column_name, bin, lo, hi
UNION ALL
SELECT 'historical_delinquencies', CAST(historical_delinquencies AS BIGINT), CAST(historical_delinquencies AS DOUBLE),
  CAST(historical_delinquencies AS DOUBLE), CAST(COUNT(*) AS BIGINT) FROM portfolio GROUP BY historical_delinquencies"""


@register("histogram", oracle=_hist_sql)
def q_histogram(spark, sf_dir):
    return pf.histogram(portfolio(spark, sf_dir), HIST_CONTINUOUS, HIST_DISCRETE, bins=40)
