"""Decisioning, factors and validation rules (the decision-service tests, without a server)."""

import pytest
from pyspark.sql import functions as F

from creditspark.functions import validation as vl
from creditspark.functions.scorecard import scorecard_pd
from creditspark.operators.decisioning import decision_frame, exploded_factors
from creditspark.sources.portfolio import ingest_rows

FIELDS = ["application_id", "monthly_income", "debt_to_income", "historical_delinquencies",
          "revolving_utilization", "loan_amount", "loan_term_months", "interest_rate", "cost_of_funds", "lgd"]


def _apps(spark, rows, threshold=None):
    recs = [dict(zip(FIELDS, r)) for r in rows]
    df = ingest_rows(spark, recs)
    df = df.withColumn("pd", scorecard_pd(F.col("monthly_income"), F.col("debt_to_income"),
                                          F.col("revolving_utilization"), F.col("historical_delinquencies"),
                                          F.col("loan_amount")))
    return df.withColumn("policy_threshold", F.lit(threshold).cast("double"))


PRIME = ("prime", 8500.0, 0.20, 0, 0.15, 10000.0, 24, 0.18, 0.05, 0.45)
DISTRESSED = ("bad", 1200.0, 0.85, 4, 0.95, 25000.0, 12, 0.09, 0.06, 0.50)


def test_prime_approved_distressed_rejected(spark):
    out = {r["application_id"]: r for r in decision_frame(_apps(spark, [PRIME, DISTRESSED])).collect()}
    assert out["prime"]["decision"] == "APROBADO"
    assert sum(f["impact"] == "FAVORABLE" for f in out["prime"]["key_factors"]) >= 3
    assert out["bad"]["decision"] == "RECHAZADO"
    assert sum(f["impact"] == "DESFAVORABLE" for f in out["bad"]["key_factors"]) >= 3
    assert all(f["description"] for f in out["prime"]["key_factors"])


def test_threshold_override(spark):
    row = ("ovr", 5000.0, 0.35, 0, 0.40, 12000.0, 12, 0.18, 0.05, 0.45)
    assert decision_frame(_apps(spark, [row], 1e-5)).first()["decision"] == "RECHAZADO"
    r = decision_frame(_apps(spark, [row], 0.99999)).first()
    assert r["decision"] == "APROBADO" and r["decision_threshold"] == pytest.approx(0.99999)


def test_exploded_factors_six_per_application(spark):
    f = exploded_factors(decision_frame(_apps(spark, [PRIME, DISTRESSED])))
    assert f.count() == 12


@pytest.mark.parametrize("field,value,rule", [
    ("monthly_income", -100.0, "monthly_income_gt_0"), ("monthly_income", 0.0, "monthly_income_gt_0"),
    ("debt_to_income", -0.1, "debt_to_income_0_2"), ("debt_to_income", 2.5, "debt_to_income_0_2"),
    ("historical_delinquencies", -1, "historical_delinquencies_ge_0"),
    ("revolving_utilization", -0.05, "revolving_utilization_0_2"),
    ("revolving_utilization", 2.1, "revolving_utilization_0_2"), ("loan_amount", 0.0, "loan_amount_gt_0"),
    ("interest_rate", 1.5, "interest_rate_0_1"), ("cost_of_funds", -0.01, "cost_of_funds_ge_0_le_1"),
    ("policy_threshold", 1.5, "policy_threshold_0_1"),
])
def test_each_invalid_field_is_rejected(spark, field, value, rule):
    rec = dict(zip(FIELDS, PRIME))
    rec["policy_threshold"] = None
    rec[field] = value
    schema = "application_id string, monthly_income double, debt_to_income double, historical_delinquencies bigint, " \
             "revolving_utilization double, loan_amount double, loan_term_months bigint, interest_rate double, " \
             "cost_of_funds double, lgd double, policy_threshold double"
    df = spark.createDataFrame([tuple(rec[c] for c in FIELDS + ["policy_threshold"])], schema)
    valid, rejected = vl.split_valid(df, vl.applicant_rules())
    assert valid.count() == 0
    assert rule in rejected.first()["violations"]


def test_defaults_and_closed_schema(spark):
    df = ingest_rows(spark, [{"application_id": 1, "monthly_income": 1.0, "loan_amount": 1.0}])
    d = vl.with_applicant_defaults(df).first()
    assert (d["loan_term_months"], d["interest_rate"], d["cost_of_funds"], d["lgd"]) == (12, 0.18, 0.05, 0.45)
    with pytest.raises(ValueError):
        vl.check_closed_schema(df.withColumn("extra", F.lit(1)), FIELDS)


def test_scored_rules(spark):
    df = spark.createDataFrame([(1.5, 2)], "pd double, default_flag bigint")
    names = [n for n, _ in vl.scored_application_rules()]
    assert "pd_0_1" in names and "default_flag_0_1" in names
    bad = df.select(vl.violations([r for r in vl.scored_application_rules() if r[0] in ("pd_0_1", "default_flag_0_1")]).alias("v")).first()
    assert set(bad["v"]) == {"pd_0_1", "default_flag_0_1"}


def test_decision_stream_is_incremental_and_exactly_once(spark, tmp_path):
    """O14 on Structured Streaming: a restart with the same checkpoint only decides new files."""
    from conftest import SF_SMALL

    from creditspark.operators.decisioning import DECISION_COLUMNS
    from creditspark.plans.decision_queries import applicants
    from creditspark.streaming.decisions import APPLICANT_SCHEMA, run_decision_stream

    apps = vl.with_applicant_defaults(applicants(spark, SF_SMALL)).select(*[f.name for f in APPLICANT_SCHEMA.fields])
    first, second = apps.where(F.col("application_id") % 2 == 0), apps.where(F.col("application_id") % 2 == 1)
    src, sink, ckpt = (str(tmp_path / d) for d in ("source", "sink", "checkpoint"))
    first.write.mode("append").parquet(src)
    out1 = run_decision_stream(spark, src, sink, ckpt)
    n1 = out1.count()
    assert n1 == first.count()
    second.write.mode("append").parquet(src)
    out2 = run_decision_stream(spark, src, sink, ckpt)
    assert out2.count() == apps.count()
    assert out2.select("application_id").distinct().count() == apps.count()
    batch = decision_frame(apps, with_factors=False).select(*DECISION_COLUMNS)
    assert out2.select(*DECISION_COLUMNS).exceptAll(batch).count() == 0
    assert batch.exceptAll(out2.select(*DECISION_COLUMNS)).count() == 0


def test_broken_requests_are_rejected_and_the_rest_decided(spark):
    from creditspark.operators.decisioning import decide

    good = {"application_id": 1, "monthly_income": 3000.0, "debt_to_income": 0.2, "historical_delinquencies": 0,
            "revolving_utilization": 0.2, "loan_amount": 9000.0, "loan_term_months": 12, "interest_rate": 0.2,
            "cost_of_funds": 0.05, "pd": 0.03, "lgd": None}
    rows = [good, dict(good, application_id=2, monthly_income=0.0), dict(good, application_id=3, lgd=1.5)]
    decided, rejected = decide(ingest_rows(spark, rows))
    assert [r["application_id"] for r in decided.collect()] == [1]
    assert {r["application_id"]: r["violations"] for r in rejected.collect()} == {2: ["monthly_income_gt_0"], 3: ["lgd_0_1"]}
    # without validation a zero income still ends no job
    assert decision_frame(ingest_rows(spark, rows[1:2])).count() == 1


def test_lgd_of_a_request_reaches_the_stream(spark, tmp_path):
    from creditspark.streaming.decisions import APPLICANT_SCHEMA, run_decision_stream

    row = (1, 3000.0, 0.2, 0, 0.2, 9000.0, 12, 0.2, 0.05, 0.03, 0.9, None)
    spark.createDataFrame([row, (2, *row[1:10], None, None), (3, 0.0, *row[2:])], APPLICANT_SCHEMA).write.parquet(str(tmp_path / "src"))
    out = {r["application_id"]: r for r in run_decision_stream(spark, *(str(tmp_path / d) for d in ("src", "out", "ck"))).collect()}
    assert set(out) == {1, 2}
    assert float(out[1]["net_loss_default"]) == pytest.approx(9000 * 0.95) and float(out[2]["net_loss_default"]) == pytest.approx(9000 * 0.5)


def test_closed_schema_checks_types(spark):
    df = spark.createDataFrame([("1", 2.0)], "application_id string, pd double")
    with pytest.raises(TypeError):
        vl.check_closed_schema(df, ["application_id", "pd"], types={"application_id": "bigint"})
    vl.check_closed_schema(df, ["application_id", "pd"], types={"pd": "double"})
    with pytest.raises(ValueError):
        vl.check_closed_schema(df, ["pd"])


def test_factor_texts_follow_their_templates(spark):
    from creditspark.functions import decision as dz

    row = {"application_id": 1, "monthly_income": 2000.0, "debt_to_income": 0.5, "historical_delinquencies": 2,
           "revolving_utilization": 0.45, "loan_amount": 9000.0, "loan_term_months": 12, "interest_rate": 0.2, "cost_of_funds": 0.05, "pd": 0.03}
    texts = {f["factor"]: f["description"] for f in exploded_factors(decision_frame(ingest_rows(spark, [row]))).collect()}
    assert texts["Debt to Income (DTI)"] == "DTI elevado (50.0%), alto compromiso sobre ingresos disponibles."
    assert texts["Historial de Morosidades"] == "2 eventos de morosidad previa registrados."
    assert texts["Uso de Líneas Rotativas"] == "Uso moderado de líneas rotativas (45.0%)."
    assert texts["Relación Monto / Ingreso Mensual"] == "Monto equivalente a 4.5 meses de ingreso bruto."
    assert texts["Spread Financiero Neto"] == "Spread financiero positivo y atractivo (15.0%)."
    assert texts["Valor Esperado (EV)"].startswith("Retorno esperado positivo (+$") and "PD calibrada (3.00%)" in texts["Valor Esperado (EV)"]
    simple = ingest_rows(spark, [row]).select(F.inline(dz.simple_factors(*(F.col(c) for c in (
        "debt_to_income", "revolving_utilization", "historical_delinquencies", "loan_amount", "monthly_income"))))).collect()
    assert [(r["shown"], r["impact"], r["description"]) for r in simple] == [
        ("50.0%", "DESFAVORABLE", "Sobreendeudamiento elevado (>35%)"), ("45.0%", "NEUTRO", "Líneas de crédito saturadas"),
        ("2 eventos", "DESFAVORABLE", "Antecedentes de morosidad 30+ días"), ("4.5x ingresos", "DESFAVORABLE", "Apalancamiento alto respecto a ingreso mensual")]
