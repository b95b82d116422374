"""Validation and decisioning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions import decision as dz
from creditspark.functions import validation as vl
from creditspark.functions.economics import EconomicParameters, enrich_portfolio
from creditspark.operators.decisioning import DECISION_COLUMNS, decision_frame, exploded_factors
from creditspark.operators.sweep import money_sum
from creditspark.plans.policy_queries import enriched, portfolio
from creditspark.plans.registry import register
from creditspark.plans.sql_base import PORTFOLIO_CTE, dec, enriched_cte, money, policy_select
from creditspark.sources.portfolio import raw_applications

# ------------------------------------------------------------------------------ V1-V3

RAW_CTE = """raw AS (SELECT o_orderkey AS application_id, ROUND(c_acctbal, 2) AS monthly_income,
   ROUND(3e-2*COALESCE(qty,0e0) - 1e-1, 4) AS debt_to_income,
   CAST(COALESCE(n_r, 0) - 1 AS BIGINT) AS historical_delinquencies,
   ROUND(COALESCE(disc,0e0)*25e0, 4) AS revolving_utilization,
   ROUND(o_totalprice/20e0/1e2, 0)*1e2 AS loan_amount, CAST(12*(o_orderkey % 6) AS BIGINT) AS loan_term_months,
   ROUND(1e-1*(o_custkey % 13) - 1e-1, 4) AS interest_rate, ROUND(45e-3 + 2e-3*(o_custkey % 11), 4) AS cost_of_funds
 FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN li ON l_orderkey=o_orderkey)"""

_V1_SQL = [
    ("monthly_income_gt_0", "monthly_income > 0"),
    ("debt_to_income_0_2", "debt_to_income >= 0 AND debt_to_income <= 2"),
    ("historical_delinquencies_ge_0", "historical_delinquencies >= 0"),
    ("revolving_utilization_0_2", "revolving_utilization >= 0 AND revolving_utilization <= 2"),
    ("loan_amount_gt_0", "loan_amount > 0"),
    ("loan_term_months_gt_0", "loan_term_months > 0"),
    ("interest_rate_0_1", "interest_rate > 0 AND interest_rate <= 1"),
]
_V1_ONLY = [("cost_of_funds_0_1", "cost_of_funds > 0 AND cost_of_funds <= 1")]
_V3_ONLY = [("cost_of_funds_ge_0_le_1", "cost_of_funds >= 0 AND cost_of_funds <= 1"),
            ("lgd_0_1", "lgd >= 0 AND lgd <= 1"),
            ("policy_threshold_0_1", "policy_threshold IS NULL OR (policy_threshold >= 0 AND policy_threshold <= 1)")]


def _viol_sql(rules) -> tuple[str, str]:
    names = ", ".join(f"CASE WHEN NOT COALESCE({c}, FALSE) THEN '{n}' END" for n, c in rules)
    count = " + ".join(f"CASE WHEN NOT COALESCE({c}, FALSE) THEN 1 ELSE 0 END" for n, c in rules)
    return f"concat_ws(',', {names})", f"CAST({count} AS BIGINT)"


def _validate_sql() -> str:
    v1_names, v1_n = _viol_sql(_V1_SQL + _V1_ONLY)
    v3_names, v3_n = _viol_sql(_V1_SQL + _V3_ONLY)
    return f"""WITH {PORTFOLIO_CTE}, {RAW_CTE},
r AS (SELECT *, 45e-2 AS lgd, CAST(NULL AS DOUBLE) AS policy_threshold FROM raw)
SELECT application_id, {v1_names} AS application_violations, {v1_n} AS n_application_violations,
  {v1_n} = 0 AS is_valid_application, {v3_names} AS applicant_violations, {v3_n} AS n_applicant_violations
FROM r"""


@register("validate_applications", oracle=_validate_sql)
def q_validate_applications(spark, sf_dir):
    raw = vl.with_applicant_defaults(raw_applications(spark, sf_dir))
    v1 = vl.violations(vl.application_rules())
    v3 = vl.violations(vl.applicant_rules())
    return raw.select(
        "application_id",
        F.array_join(v1, ",").alias("application_violations"),
        F.size(v1).cast("bigint").alias("n_application_violations"),
        (F.size(v1) == 0).alias("is_valid_application"),
        F.array_join(v3, ",").alias("applicant_violations"),
        F.size(v3).cast("bigint").alias("n_applicant_violations"),
    )


_V2_ONLY = [("pd_0_1", "pd >= 0 AND pd <= 1"), ("default_flag_0_1", "default_flag IN (0, 1)")]


def _validate_scored_sql() -> str:
    names, n = _viol_sql(_V1_SQL + _V1_ONLY + _V2_ONLY)
    return f"""WITH {PORTFOLIO_CTE}, {RAW_CTE},
r AS (SELECT *, (application_id % 23) / 20e0 AS pd, CASE WHEN application_id % 4 < 3 THEN application_id % 4 END AS default_flag FROM raw)
SELECT application_id, {names} AS violations, {n} AS n_violations FROM r"""


@register("validate_scored_applications", oracle=_validate_scored_sql)
def q_validate_scored_applications(spark, sf_dir):
    """V2: raw records with a score and an outcome, both out of range for some."""
    raw = raw_applications(spark, sf_dir).withColumns({
        "pd": F.col("application_id") % 23 / F.lit(20.0),
        "default_flag": F.when(F.col("application_id") % 4 < 3, F.col("application_id") % 4)})
    broken = vl.violations(vl.scored_application_rules())
    return raw.select("application_id", F.array_join(broken, ",").alias("violations"), F.size(broken).cast("bigint").alias("n_violations"))


# ------------------------------------------------------------------------------ O14 / P16

# Per-segment cutoff overrides of the decision policy (other segments use breakeven).
SEGMENT_CUTOFFS = {"AUTOMOBILE": 0.12}


def applicants(spark, sf_dir):
    p = portfolio(spark, sf_dir)
    lookup = F.create_map(*[x for k, v in SEGMENT_CUTOFFS.items() for x in (F.lit(k), F.lit(float(v)))])
    return p.withColumn("policy_threshold", lookup[F.col("segment")])


DECISION_SQL_BASE = f"""WITH {PORTFOLIO_CTE},
d AS (SELECT application_id, pd, loan_amount AS amt, interest_rate AS r, cost_of_funds AS c,
         CAST(loan_term_months AS DOUBLE) AS t, 45e-2 AS l, debt_to_income, historical_delinquencies,
         revolving_utilization, monthly_income,
         CASE WHEN segment = 'AUTOMOBILE' THEN 12e-2 END AS thr FROM portfolio),
x AS (SELECT *, amt*(r-c)*(t/12e0) AS g, amt*(l+c*(t/12e0)) AS lo,
        (1e0-pd)*(amt*(r-c)*(t/12e0)) - pd*(amt*(l+c*(t/12e0))) AS ev,
        CASE WHEN (r-c)*(t/12e0) <= 0 THEN 0e0 WHEN (r-c)*(t/12e0) + (l+c*(t/12e0)) <= 0 THEN 0e0
             ELSE LEAST(1e0, GREATEST(0e0, ((r-c)*(t/12e0)) / (((r-c)*(t/12e0)) + (l+c*(t/12e0))))) END AS be FROM d)"""


_BATCH_DECISIONS_SQL = f"""{DECISION_SQL_BASE}
SELECT application_id,
  CASE WHEN COALESCE(CASE WHEN thr IS NOT NULL THEN pd <= thr ELSE ev > 0 AND pd <= be END, FALSE)
       THEN 'APROBADO' ELSE 'RECHAZADO' END AS decision,
  ROUND_EVEN(pd, 6) AS calibrated_pd, {money('ev')} AS expected_value, ROUND_EVEN(be, 6) AS breakeven_pd,
  ROUND_EVEN(COALESCE(thr, be), 6) AS decision_threshold, {money('g')} AS net_gain_performing,
  {money('lo')} AS net_loss_default
FROM x"""


@register("batch_decisions", oracle=_BATCH_DECISIONS_SQL)
def q_batch_decisions(spark, sf_dir):
    return decision_frame(applicants(spark, sf_dir), with_factors=False).select(*DECISION_COLUMNS)


@register("lgd_decisions", oracle=_BATCH_DECISIONS_SQL.replace("45e-2 AS l", "30e-2 + 5e-2*(application_id % 9) AS l"))
def q_lgd_decisions(spark, sf_dir):
    """O14 with a loss given default per request."""
    rows = applicants(spark, sf_dir).withColumn("lgd", F.lit(0.30) + F.lit(0.05) * (F.col("application_id") % 9))
    return decision_frame(rows, with_factors=False).select(*DECISION_COLUMNS)


@register("decision_factors", oracle=f"""{DECISION_SQL_BASE}
SELECT application_id, 'Debt to Income (DTI)' AS factor, ROUND_EVEN(debt_to_income, 4) AS value,
  CASE WHEN debt_to_income <= 30e-2 THEN 'FAVORABLE' WHEN debt_to_income > 45e-2 THEN 'DESFAVORABLE' ELSE 'NEUTRO' END AS impact FROM x
UNION ALL SELECT application_id, 'Historial de Morosidades', CAST(historical_delinquencies AS DOUBLE),
  CASE WHEN historical_delinquencies = 0 THEN 'FAVORABLE' ELSE 'DESFAVORABLE' END FROM x
UNION ALL SELECT application_id, 'Uso de Líneas Rotativas', ROUND_EVEN(revolving_utilization, 4),
  CASE WHEN revolving_utilization <= 30e-2 THEN 'FAVORABLE' WHEN revolving_utilization > 60e-2 THEN 'DESFAVORABLE' ELSE 'NEUTRO' END FROM x
UNION ALL SELECT application_id, 'Relación Monto / Ingreso Mensual', {money('amt / monthly_income')},
  CASE WHEN amt / monthly_income <= 3e0 THEN 'FAVORABLE' WHEN amt / monthly_income > 6e0 THEN 'DESFAVORABLE' ELSE 'NEUTRO' END FROM x
UNION ALL SELECT application_id, 'Spread Financiero Neto', ROUND_EVEN(r - c, 4),
  CASE WHEN r - c >= 8e-2 THEN 'FAVORABLE' WHEN r - c <= 0e0 THEN 'DESFAVORABLE' ELSE 'NEUTRO' END FROM x
UNION ALL SELECT application_id, 'Valor Esperado (EV)', {money('ev')},
  CASE WHEN ev > 0 THEN 'FAVORABLE' ELSE 'DESFAVORABLE' END FROM x""")
def q_decision_factors(spark, sf_dir):
    return exploded_factors(decision_frame(applicants(spark, sf_dir), factor_text=False)).drop("description")


@register("decision_factors_simple", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('override')},
f AS (SELECT application_id, ev_ > 0 AS approved_ev, debt_to_income, revolving_utilization, historical_delinquencies,
        loan_amount / monthly_income AS lti FROM e)
SELECT application_id, approved_ev, 'Debt-to-Income (DTI)' AS factor, debt_to_income AS value,
  CASE WHEN debt_to_income < 35e-2 THEN 'FAVORABLE' ELSE 'DESFAVORABLE' END AS impact,
  CASE WHEN debt_to_income < 35e-2 THEN 'Endeudamiento saludable (<35%)' ELSE 'Sobreendeudamiento elevado (>35%)' END AS description FROM f
UNION ALL SELECT application_id, approved_ev, 'Utilización Rotativa', revolving_utilization,
  CASE WHEN revolving_utilization < 30e-2 THEN 'FAVORABLE' WHEN revolving_utilization < 60e-2 THEN 'NEUTRO' ELSE 'DESFAVORABLE' END,
  CASE WHEN revolving_utilization < 30e-2 THEN 'Uso conservador de tarjetas' ELSE 'Líneas de crédito saturadas' END FROM f
UNION ALL SELECT application_id, approved_ev, 'Moras Históricas', CAST(historical_delinquencies AS DOUBLE),
  CASE WHEN historical_delinquencies = 0 THEN 'FAVORABLE' ELSE 'DESFAVORABLE' END,
  CASE WHEN historical_delinquencies = 0 THEN 'Historial crediticio limpio' ELSE 'Antecedentes de morosidad 30+ días' END FROM f
UNION ALL SELECT application_id, approved_ev, 'Capacidad de Pago (Monto / Ingreso)', lti,
  CASE WHEN lti < 35e-1 THEN 'FAVORABLE' ELSE 'DESFAVORABLE' END,
  CASE WHEN lti < 35e-1 THEN 'Monto acorde a capacidad de ingresos' ELSE 'Apalancamiento alto respecto a ingreso mensual' END FROM f""")
def q_decision_factors_simple(spark, sf_dir):
    e = enrich_portfolio(portfolio(spark, sf_dir), EconomicParameters(), mode="override")
    factors = dz.simple_factors(F.col("debt_to_income"), F.col("revolving_utilization"),
                                F.col("historical_delinquencies"), F.col("loan_amount"), F.col("monthly_income"))
    return e.select("application_id", dz.approve_positive_ev(F.col("expected_value")).alias("approved_ev"),
                    F.inline(factors)).select(
        "application_id", "approved_ev", F.col("name").alias("factor"), "value", "impact", "description")


# ------------------------------------------------------------------------------ P18 / P19

@register("risk_bands", oracle=f"""WITH {PORTFOLIO_CTE},
bands AS (SELECT *, CASE WHEN pd*100e0 < 5e0 THEN 'low' WHEN pd*100e0 < 15e0 THEN 'moderate' WHEN pd*100e0 < 30e0 THEN 'high'
                     WHEN pd*100e0 <= 60e0 THEN 'very_high' WHEN pd*100e0 > 60e0 THEN 'beyond_gauge' END AS band FROM portfolio)
SELECT band, CAST(COUNT(*) AS BIGINT) AS applications,
  ROUND_EVEN(CAST(SUM({dec('pd')}) AS DOUBLE) / COUNT(*), 6) AS avg_pd,
  ROUND_EVEN(SUM(default_flag) / CAST(COUNT(*) AS DOUBLE), 6) AS default_rate
FROM bands GROUP BY band""")
def q_risk_bands(spark, sf_dir):
    p = portfolio(spark, sf_dir).withColumn("band", dz.risk_band(F.col("pd")))
    return p.groupBy("band").agg(
        F.count(F.lit(1)).cast("bigint").alias("applications"),
        (money_sum("pd").cast("double") / F.count(F.lit(1))).alias("_avg"),
        (F.sum("default_flag") / F.count(F.lit(1))).alias("_dr"),
    ).select("band", "applications", F.bround("_avg", 6).alias("avg_pd"), F.bround("_dr", 6).alias("default_rate"))


@register("ev_decomposition", oracle=f"""WITH {PORTFOLIO_CTE},
{enriched_cte('default')}
SELECT application_id, (1e0-pd_)*gain_ AS expected_gain_component, -(pd_*loss_) AS expected_loss_component,
  ev_ AS expected_value FROM e""")
def q_ev_decomposition(spark, sf_dir):
    e = enriched(spark, sf_dir, "default")
    return e.select("application_id", *dz.ev_decomposition(
        F.col("pd"), F.col("net_gain_performing"), F.col("net_loss_default")))


# ------------------------------------------------------------------------------ O14 on a stream

@register("stream_decisions", oracle=lambda: _BATCH_DECISIONS_SQL)
def q_stream_decisions(spark, sf_dir):
    """S7 writes the applicant table, then the decision stream drains it into a parquet sink."""
    import uuid

    from creditspark.session import ensure_checkpoint_dir
    from creditspark.sources.portfolio import write_portfolio
    from creditspark.streaming.decisions import APPLICANT_SCHEMA, run_decision_stream

    base = f"{ensure_checkpoint_dir(spark)}/creditspark-stream/{uuid.uuid4().hex}"
    apps = vl.with_applicant_defaults(applicants(spark, sf_dir)).select(*[f.name for f in APPLICANT_SCHEMA.fields])
    write_portfolio(apps, f"{base}/source")
    return run_decision_stream(spark, f"{base}/source", f"{base}/sink", f"{base}/checkpoint")


# ------------------------------------------------------------------------------ S3 / V5 in bulk, V8

_PLANTED = ("CASE application_id % 10 WHEN 0 THEN 'unknown:nickname' WHEN 1 THEN 'type:loan_amount' WHEN 2 THEN 'type:historical_delinquencies' "
            "WHEN 3 THEN 'missing:monthly_income' WHEN 4 THEN 'malformed' ELSE '' END")


@register("record_ingestion", oracle=f"""WITH {PORTFOLIO_CTE}
SELECT {_PLANTED} AS violations, CAST(COUNT(*) AS BIGINT) AS records,
  ROUND_EVEN(CAST(SUM(CASE WHEN application_id % 10 >= 5 THEN loan_amount END) AS DOUBLE), 2) AS total_amount FROM portfolio GROUP BY 1""")
def q_record_ingestion(spark, sf_dir):
    """Applications as JSON lines, half of them with a planted fault, parsed strictly; totals by fault."""
    from creditspark.sources.requests import parse_records
    from creditspark.streaming.decisions import REQUEST_SCHEMA

    p, i = portfolio(spark, sf_dir), F.col("application_id") % 10
    fields = ["application_id", "monthly_income", "debt_to_income", "historical_delinquencies", "revolving_utilization", "loan_amount"]
    plain = {c: F.col(c).cast("string") for c in fields}
    plain["loan_amount"] = F.when(i == 1, F.concat(F.lit('"'), plain["loan_amount"], F.lit('"'))).otherwise(plain["loan_amount"])
    plain["historical_delinquencies"] = F.when(i == 2, F.lit("1.5")).otherwise(plain["historical_delinquencies"])
    parts = [F.when((i != 3) | F.lit(c != "monthly_income"), F.concat(F.lit(f'"{c}": '), v)) for c, v in plain.items()]
    body = F.concat_ws(", ", *parts, F.when(i == 0, F.lit('"nickname": "x"')))
    lines = p.select(F.concat(F.lit("{"), body, F.when(i == 4, F.lit("")).otherwise(F.lit("}"))).alias("value"))
    found = parse_records(lines, REQUEST_SCHEMA, fields)
    return found.groupBy(F.array_join("violations", ",").alias("violations")).agg(
        F.count(F.lit(1)).alias("records"), F.bround(F.sum(F.when(F.size("violations") == 0, F.col("loan_amount"))), 2).alias("total_amount"))


@register("output_invariants", oracle=lambda: f"""WITH {PORTFOLIO_CTE},
{enriched_cte('default')},
c AS (SELECT UNNEST([{', '.join(f'{k / 20!r}e0' for k in range(21))}]) AS threshold),
pol AS ({policy_select()}),
r AS (SELECT 'approved_count_ge_0' AS invariant, approved_count >= 0 AS ok FROM pol
  UNION ALL SELECT 'total_applications_ge_0', total_applications >= 0 FROM pol UNION ALL SELECT 'total_exposure_ge_0', total_exposure >= 0 FROM pol
  UNION ALL SELECT 'expected_loss_ge_0', expected_loss >= 0 FROM pol UNION ALL SELECT 'threshold_0_1', threshold BETWEEN 0 AND 1 FROM pol
  UNION ALL SELECT 'approval_rate_0_1', approval_rate BETWEEN 0 AND 1 FROM pol UNION ALL SELECT 'expected_default_rate_0_1', expected_default_rate BETWEEN 0 AND 1 FROM pol
  UNION ALL SELECT 'approved_count_le_total_applications', approved_count <= total_applications FROM pol)
SELECT invariant, CAST(COUNT(*) AS BIGINT) AS checked, CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM r GROUP BY invariant""")
def q_output_invariants(spark, sf_dir):
    """V8: how many rows of a policy sweep break each output invariant."""
    from creditspark.functions.invariants import PREFIX, invariant_counts
    from creditspark.operators.sweep import policy_sweep

    swept = policy_sweep(enriched(spark, sf_dir, "default"), [k / 20 for k in range(21)])
    counts = swept.agg(*invariant_counts(swept.columns))
    rules = [c for c in counts.columns if c.startswith(PREFIX)]
    return counts.select("checked", F.inline(F.array(*[F.struct(F.lit(c.removeprefix(PREFIX)).alias("invariant"), F.col(c).alias("broken")) for c in rules]))
                         ).select("invariant", "checked", "broken")
