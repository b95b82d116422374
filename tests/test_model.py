"""Model pipeline: outputs, missing input, outliers, persistence, calibration errors."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from creditspark.ml.calibrate import fit_calibrator
from creditspark.ml.pipeline import BoostingConfig, ModelSpec, feature_importance, fit_pipeline, prepare, score
from creditspark.ml.train import split_portfolio
from creditspark.sources.artifacts import load_pipeline, load_pipeline_artifact, save_pipeline_artifact
from creditspark.sources.portfolio import derive_portfolio, ingest_rows

from conftest import SF_SMALL

SMALL = ModelSpec(boosting=BoostingConfig(max_iter=8))


@pytest.fixture(scope="module")
def fitted(spark):
    split = split_portfolio(derive_portfolio(spark, SF_SMALL)).cache()
    model = fit_pipeline(prepare(split.where("split = 'train'")), SMALL)
    return model, split


def test_probabilities_valid(spark, fitted):
    model, split = fitted
    s = score(model, split.where("split = 'test'"))
    r = s.agg(F.min("model_score_pd"), F.max("model_score_pd"),
              F.sum(F.isnan("model_score_pd").cast("int"))).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] == 0
    raw = model.transform(prepare(split.limit(5)))
    for row in raw.select("probability").collect():
        assert sum(row[0]) == pytest.approx(1.0)


def test_missing_values_and_absent_columns(spark, fitted):
    model, _ = fitted
    rows = ingest_rows(spark, [{"monthly_income": 4000.0, "loan_amount": 9000.0}, {"debt_to_income": 0.3}])
    out = score(model, rows, keep=()).collect()
    assert all(math.isfinite(r["model_score_pd"]) for r in out)


def test_outliers_and_unseen_term(spark, fitted):
    model, _ = fitted
    rows = [
        {"monthly_income": 1e9, "debt_to_income": 0.01, "historical_delinquencies": 0, "revolving_utilization": 0.01,
         "loan_amount": 1000.0, "loan_term_months": 120, "interest_rate": 0.2, "cost_of_funds": 0.05},
        {"monthly_income": 0.0, "debt_to_income": -1.0, "historical_delinquencies": 9, "revolving_utilization": 5.0,
         "loan_amount": 50000.0, "loan_term_months": 12, "interest_rate": 0.3, "cost_of_funds": 0.05},
    ]
    out = score(model, ingest_rows(spark, rows), keep=()).collect()
    assert all(math.isfinite(r["model_score_pd"]) for r in out)


def test_distressed_scores_above_wealthy(spark, fitted):
    model, _ = fitted
    base = {"historical_delinquencies": 0, "loan_term_months": 12, "interest_rate": 0.18, "cost_of_funds": 0.05}
    wealthy = dict(base, monthly_income=30000.0, debt_to_income=0.05, revolving_utilization=0.02, loan_amount=2000.0)
    distressed = dict(base, monthly_income=1000.0, debt_to_income=0.7, revolving_utilization=0.99,
                      loan_amount=50000.0, historical_delinquencies=4)
    w, d = [r["model_score_pd"] for r in score(model, ingest_rows(spark, [wealthy, distressed]), keep=()).collect()]
    assert d > w


def test_persistence_round_trip(spark, fitted, tmp_path):
    model, split = fitted
    path = str(tmp_path / "artifact")
    save_pipeline_artifact(spark, model, path, {"note": "test", "model_class": "custom"})
    loaded, meta = load_pipeline_artifact(spark, path)
    assert meta["note"] == "test" and meta["model_class"] == "custom" and "saved_at" in meta
    a = score(model, split).orderBy("application_id").select("model_score_pd").collect()
    b = score(loaded, split).orderBy("application_id").select("model_score_pd").collect()
    assert a == b
    model.write().overwrite().save(str(tmp_path / "bare"))
    assert load_pipeline_artifact(spark, str(tmp_path / "bare"))[1] == {}
    assert load_pipeline(spark, path) is not None
    with pytest.raises(FileNotFoundError):
        load_pipeline_artifact(spark, str(tmp_path / "missing"))


def test_calibration_methods(spark, fitted):
    model, split = fitted
    val = score(model, split.where("split = 'validation'"))
    for method in ("isotonic", "sigmoid"):
        out = fit_calibrator(val, method).transform(val).agg(F.min("calibrated_pd"), F.max("calibrated_pd")).first()
        assert 0.0 <= out[0] <= out[1] <= 1.0
    with pytest.raises(ValueError):
        fit_calibrator(val, "beta")


def test_feature_importance(spark, fitted):
    model, _ = fitted
    rows = feature_importance(model, spark).collect()
    assert len(rows) >= 10 and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    counts = [r["split_count"] for r in rows]
    inner = sum((tree.numNodes - 1) // 2 for tree in model.stages[-1].trees)
    assert counts == sorted(counts, reverse=True) and sum(counts) == inner


def test_training_job_and_reload_give_the_same_calibrated_pds(spark, tmp_path):
    from creditspark.ml.train import CalibratedModel, load_or_train, score_and_decide, simulate_portfolio, training_job
    from creditspark.sources.artifacts import artifact_exists

    portfolio = derive_portfolio(spark, SF_SMALL)
    path = str(tmp_path / "trained")
    result = training_job(spark, portfolio, path, SMALL)
    loaded = CalibratedModel.load(spark, path)
    pds = lambda m: m.score(portfolio).orderBy("application_id").select("calibrated_pd").collect()
    assert pds(result.model) == pds(loaded) == pds(load_or_train(spark, portfolio, path, SMALL))
    assert loaded.metadata["splits"].keys() == {"train", "validation", "test"} and loaded.metadata["test_metrics"]
    assert "application_id" not in loaded.metadata["features"] and "default_flag" not in loaded.metadata["features"]
    assert not artifact_exists(spark, str(tmp_path / "none"))

    simulated = simulate_portfolio(loaded, portfolio, cutoffs=[0.1, 1.0]).collect()
    assert len(simulated) == 2
    worse = simulate_portfolio(loaded, portfolio.withColumn("lgd", F.lit(0.95)), cutoffs=[0.1, 1.0]).collect()
    assert worse[1]["expected_pnl"] < simulated[1]["expected_pnl"]

    broken = portfolio.limit(20).withColumn("monthly_income", F.when(F.col("application_id") % 2 == 0, 0.0).otherwise(F.col("monthly_income")))
    decided, rejected = score_and_decide(loaded, broken)
    assert decided.count() + rejected.count() == 20 and rejected.count() == broken.where("monthly_income = 0").count()


def test_ingestion_keeps_every_field_and_value(spark):
    import numpy as np
    import pandas as pd

    got = ingest_rows(spark, [{"income": 10, "amount": 5.0}, {"dti": 0.3, "historical_delinquencies": 2.7, "loan_term_months": 12.9}])
    rows = [r.asDict() for r in got.collect()]
    assert rows[0] == {"income": 10, "amount": 5.0, "dti": None, "historical_delinquencies": None, "loan_term_months": None}
    assert rows[1]["dti"] == 0.3 and rows[1]["historical_delinquencies"] == 2.7 and rows[1]["loan_term_months"] == 12.9
    matrix = ingest_rows(spark, np.array([[0.1, 1000.0], [0.2, 2000.0]]), columns=["pd", "loan_amount"])
    assert [tuple(r) for r in matrix.collect()] == [(0.1, 1000.0), (0.2, 2000.0)]
    assert ingest_rows(spark, pd.DataFrame({"pd": [0.1], "name": ["a"]})).first().asDict() == {"pd": 0.1, "name": "a"}
    with pytest.raises(ValueError):
        ingest_rows(spark, [[1, 2, 3]], columns=["a", "b"])


def test_a_cluster_needs_a_shared_folder():
    from creditspark.session import scratch_root

    assert scratch_root("hdfs:///shared", "yarn") == "hdfs:///shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            scratch_root(None, master)
    assert scratch_root(None, "local[8]")


def test_split_is_exact_and_keeps_copies_together(spark):
    rows = [(i % 50 if i < 200 else i, float(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "application_id long, default_flag double").withColumn("wide", F.lit("x"))
    split = split_portfolio(df)
    assert split.columns == [*df.columns, "split"] and split.count() == 1000
    assert split.groupBy("application_id", "default_flag").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {(r[0], r[1]): r[2] for r in split.groupBy("default_flag", "split").count().collect()}
    for y in (0.0, 1.0):
        n = sum(1 for _, v in rows if v == y)
        assert abs(sizes[y, "train"] - int(0.6 * n)) <= 4 and abs(sizes[y, "validation"] - int(0.2 * n)) <= 5


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_benchmark_fits_read_a_written_split_with_statistics_taken_once(spark, monkeypatch):
    from creditspark.plans import model_queries as mq

    seen = []

    class Stop(Exception):
        pass

    def fit(train, spec=None, pre=None):
        seen.append((_plan(train), pre))
        raise Stop

    monkeypatch.setattr(mq, "fit_pipeline", fit)
    monkeypatch.setattr(mq, "_model", lambda *a: SimpleNamespace(pipeline=None))
    with pytest.raises(Stop):
        mq.q_benchmark_models(spark, SF_SMALL)
    assert seen and all("Join" not in plan and "Window" not in plan and pre is not None for plan, pre in seen)


def test_selection_bias_scores_each_row_once(spark, monkeypatch):
    from creditspark.ml import train as tr
    from creditspark.operators.audit import historical_rule

    seen = []
    bundle = tr.mt.metrics_bundle
    monkeypatch.setattr(tr.mt, "metrics_bundle", lambda long: seen.append(_plan(long)) or bundle(long))
    portfolio = derive_portfolio(spark, SF_SMALL)
    rows = tr.selection_bias(portfolio, historical_rule(portfolio), ModelSpec(kind="logistic")).collect()
    assert sorted(r["score_name"] for r in rows) == ["approved_only", "full_population"] and all(0 <= r["roc_auc"] <= 1 for r in rows)
    assert "UDF" not in seen[0] and "Join" not in seen[0]
