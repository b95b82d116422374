"""Audit, split and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions.features import DERIVED_FEATURES, NUMERIC_FEATURES, model_frame
from creditspark.ml.preprocess import most_frequent, robust_stats
from creditspark.operators import audit as au
from creditspark.plans.policy_queries import portfolio
from creditspark.plans.registry import register
from creditspark.plans.sql_base import PORTFOLIO_CTE, dec

INCOME_SQL = "CASE WHEN monthly_income < 2500e0 THEN 'Bajo Ingreso' ELSE 'Medio/Alto Ingreso' END"


@register("segment_audit", oracle=f"""WITH {PORTFOLIO_CTE}
SELECT {INCOME_SQL} AS "group", CAST(COUNT(*) AS BIGINT) AS applications,
  ROUND_EVEN(SUM(CASE WHEN pd <= 18e-2 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE), 6) AS approval_rate,
  ROUND_EVEN(SUM(default_flag) / CAST(COUNT(*) AS DOUBLE), 6) AS default_rate,
  ROUND_EVEN(CAST(SUM({dec('pd')}) AS DOUBLE) / COUNT(*), 6) AS avg_score
FROM portfolio GROUP BY 1""")
def q_segment_audit(spark, sf_dir):
    return au.segment_audit(portfolio(spark, sf_dir), "pd", 0.18)


@register("disparate_impact", oracle=f"""WITH {PORTFOLIO_CTE},
r AS (SELECT {INCOME_SQL} AS g, SUM(CASE WHEN pd <= 18e-2 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) AS rate
      FROM portfolio GROUP BY 1),
o AS (SELECT MAX(CASE WHEN g = 'Bajo Ingreso' THEN rate END) AS p, MAX(CASE WHEN g = 'Medio/Alto Ingreso' THEN rate END) AS r FROM r)
SELECT 'Bajo Ingreso' AS protected_group, 'Medio/Alto Ingreso' AS reference_group,
  ROUND_EVEN(p, 6) AS protected_approval_rate, ROUND_EVEN(r, 6) AS reference_approval_rate,
  ROUND_EVEN(CASE WHEN r = 0 THEN NULL ELSE p / r END, 6) AS disparate_impact_ratio,
  COALESCE(CASE WHEN r = 0 THEN NULL ELSE p / r END >= 8e-1, FALSE) AS passes_four_fifths FROM o""")
def q_disparate_impact(spark, sf_dir):
    return au.disparate_impact(portfolio(spark, sf_dir), "pd", 0.18)


@register("historical_split", oracle=f"""WITH {PORTFOLIO_CTE},
t AS (SELECT CASE WHEN debt_to_income < 35e-2 AND historical_delinquencies = 0 THEN 'approved' ELSE 'rejected' END AS population,
        CAST(COUNT(*) AS BIGINT) AS n, SUM(default_flag) AS d FROM portfolio GROUP BY 1)
SELECT population, n AS applications, ROUND_EVEN(n / CAST(SUM(n) OVER () AS DOUBLE), 6) AS share,
  ROUND_EVEN(d / CAST(n AS DOUBLE), 6) AS default_rate FROM t""")
def q_historical_split(spark, sf_dir):
    return au.historical_split(portfolio(spark, sf_dir))


@register("stratified_split", oracle=f"""WITH {PORTFOLIO_CTE},
rk AS (SELECT application_id, default_flag,
         ROW_NUMBER() OVER (PARTITION BY default_flag ORDER BY ((application_id % 1000003) * 92821) % 1000003, application_id) AS rn,
         COUNT(*) OVER (PARTITION BY default_flag) AS n FROM portfolio),
sp AS (SELECT *, CASE WHEN rn <= FLOOR(n * 6e-1) THEN 'train' WHEN rn <= FLOOR(n * 8e-1) THEN 'validation' ELSE 'test' END AS split FROM rk)
SELECT split, CAST(COUNT(*) AS BIGINT) AS applications, CAST(SUM(default_flag) AS BIGINT) AS defaults,
  ROUND_EVEN(SUM(default_flag) / CAST(COUNT(*) AS DOUBLE), 6) AS default_rate FROM sp GROUP BY split""")
def q_stratified_split(spark, sf_dir):
    return au.split_report(au.stratified_split(portfolio(spark, sf_dir)))


FEATURE_OUT = ["application_id", *NUMERIC_FEATURES, "loan_term_months", *DERIVED_FEATURES]


@register("feature_engineering", oracle=f"""WITH {PORTFOLIO_CTE}
SELECT application_id, monthly_income, debt_to_income, CAST(historical_delinquencies AS DOUBLE) AS historical_delinquencies,
  revolving_utilization, loan_amount, interest_rate, cost_of_funds, loan_term_months,
  CASE WHEN monthly_income > 0 THEN loan_amount / monthly_income END AS loan_to_income,
  interest_rate - cost_of_funds AS net_interest_spread,
  CASE WHEN loan_term_months > 0 AND monthly_income > 0 THEN (loan_amount / loan_term_months) / monthly_income END AS installment_to_income
FROM portfolio""")
def q_feature_engineering(spark, sf_dir):
    return model_frame(portfolio(spark, sf_dir)).select(*FEATURE_OUT)


def _preprocess_sql() -> str:
    feats = NUMERIC_FEATURES + DERIVED_FEATURES
    exprs = {
        "loan_to_income": "CASE WHEN monthly_income > 0 THEN loan_amount / monthly_income END",
        "net_interest_spread": "interest_rate - cost_of_funds",
        "installment_to_income": "CASE WHEN loan_term_months > 0 AND monthly_income > 0 THEN (loan_amount / loan_term_months) / monthly_income END",
    }
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({exprs.get(c, c)} AS DOUBLE) AS value FROM portfolio" for c in feats)
    return f"""WITH {PORTFOLIO_CTE},
l AS ({long}),
m AS (SELECT feature, QUANTILE_CONT(value, 5e-1) AS median FROM l GROUP BY feature),
i AS (SELECT l.feature, COALESCE(value, median) AS value FROM l JOIN m ON l.feature = m.feature),
q AS (SELECT feature, QUANTILE_CONT(value, 25e-2) AS q25, QUANTILE_CONT(value, 75e-2) AS q75 FROM i GROUP BY feature),
md AS (SELECT CAST(loan_term_months AS DOUBLE) AS v, COUNT(*) AS c FROM portfolio GROUP BY 1 ORDER BY c DESC, v ASC LIMIT 1)
SELECT m.feature, 'median' AS statistic, ROUND_EVEN(median, 8) AS center, ROUND_EVEN(q25, 8) AS q25,
  ROUND_EVEN(q75, 8) AS q75, ROUND_EVEN(CASE WHEN q75 - q25 = 0 THEN 1e0 ELSE q75 - q25 END, 8) AS scale
FROM m JOIN q ON m.feature = q.feature
UNION ALL SELECT 'loan_term_months', 'mode', v, NULL, NULL, NULL FROM md"""


@register("preprocess_stats", oracle=_preprocess_sql)
def q_preprocess_stats(spark, sf_dir):
    frame = model_frame(portfolio(spark, sf_dir))
    num = robust_stats(frame, NUMERIC_FEATURES + DERIVED_FEATURES).select(
        "feature", F.lit("median").alias("statistic"), F.bround("median", 8).alias("center"),
        F.bround("q25", 8).alias("q25"), F.bround("q75", 8).alias("q75"), F.bround("scale", 8).alias("scale"))
    cat = most_frequent(frame, ["loan_term_months"]).select(
        "feature", F.lit("mode").alias("statistic"), F.col("mode").alias("center"),
        *[F.lit(None).cast("double").alias(c) for c in ("q25", "q75", "scale")])
    return num.unionByName(cat)
