"""Training job, load-or-train and portfolio simulation."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditspark.functions.economics import EconomicParameters, enrich_portfolio
from creditspark.functions.validation import applicant_rules, split_valid, with_applicant_defaults
from creditspark.ml.calibrate import Calibrator, fit_calibrator, load_calibrator, save_calibrator
from creditspark.ml.pipeline import LABEL, ModelSpec, fit_pipeline, prepare, score
from creditspark.operators import metrics as mt
from creditspark.operators import sweep as sw
from creditspark.operators.audit import split_report, stratified_split
from creditspark.operators.decisioning import decision_frame
from creditspark.session import ensure_checkpoint_dir
from creditspark.sources.artifacts import artifact_exists, load_pipeline_artifact, save_pipeline_artifact
from creditspark.sources.portfolio import DERIVATION_VERSION, source_signature
from creditspark.sources.storage import remove_path


@dataclass
class CalibratedModel:
    """A fitted pipeline, the calibrator of its scores, and their metadata."""

    pipeline: PipelineModel
    calibrator: Calibrator
    metadata: dict

    def score(self, df: DataFrame, keep=("application_id", LABEL), carry=(), out_col: str = "calibrated_pd") -> DataFrame:
        """M8 then M9: raw score and calibrated PD per row."""
        return self.calibrator.transform(score(self.pipeline, df, keep=keep, carry=carry), out_col)

    def save(self, spark: SparkSession, path: str) -> str:
        """Calibrator first, metadata (the mark of a complete artifact) last."""
        kept = save_calibrator(self.calibrator, f"{path}/calibrator")
        return save_pipeline_artifact(spark, self.pipeline, path, {**self.metadata, **kept})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CalibratedModel":
        pipeline, metadata = load_pipeline_artifact(spark, path)
        return cls(pipeline, load_calibrator(spark, f"{path}/calibrator", metadata), metadata)


@dataclass
class TrainingResult:
    model: CalibratedModel
    split_report: DataFrame
    comparison: DataFrame
    path: str


def split_portfolio(portfolio: DataFrame) -> DataFrame:
    """M1: 60/20/20 stratified split column ``split`` (train / validation / test)."""
    return stratified_split(portfolio, LABEL, "application_id", (0.6, 0.2, 0.2), ("train", "validation", "test"))


def written(df: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """``df`` as a table under ``folder`` of the shared folder, so that its readers don't compute it again, and the table's path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def at_once(spark: SparkSession, *tasks: Callable[[], Any]) -> list:
    """Results of independent jobs run side by side: one's tasks fill the cores that another's leave idle."""
    with ThreadPool(len(tasks)) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(t) for t in tasks])


def training_job(spark: SparkSession, portfolio: DataFrame, out_path: str | None = None,
                 spec: ModelSpec | None = None, method: str = "isotonic",
                 model: PipelineModel | None = None) -> TrainingResult:
    """Split -> fit on train -> calibrate on validation -> compare on test -> save.

    The split frame is written once as a parquet table (lineage cut, survives executor loss), so
    the three splits and every fitting pass read the same rows; so are the scores of validation and
    test rows, which calibration and reports read several times. All are removed at the end. The
    artifact holds the pipeline, the calibrator, both reports, and metadata with the split
    sizes and test metrics. Without ``out_path`` it goes to the checkpoint folder.
    """
    out_path = out_path or f"{ensure_checkpoint_dir(spark)}/creditspark-models/{uuid.uuid4().hex}"
    split, split_path = written(split_portfolio(portfolio), "creditspark-splits")
    train = prepare(split.where("split = 'train'"))
    if model is None:
        model = fit_pipeline(train, spec)
    val, val_path = written(score(model, split.where("split = 'validation'")), "creditspark-scores")
    cal = fit_calibrator(val, method)
    test, test_path = written(cal.transform(score(model, split.where("split = 'test'"))), "creditspark-scores")
    long = mt.stack_scores(test, {"raw": "model_score_pd", "calibrated": "calibrated_pd"}, LABEL)
    mt.calibration_comparison(long, before="raw", after="calibrated").write.mode("overwrite").parquet(f"{out_path}/comparison")
    split_report(split).write.mode("overwrite").parquet(f"{out_path}/splits")
    comparison, report = spark.read.parquet(f"{out_path}/comparison"), spark.read.parquet(f"{out_path}/splits")
    metadata = {
        "features": [c for c in train.columns if c not in ("application_id", LABEL)],
        "spec": repr(spec or ModelSpec()), "splits": {r["split"]: r["applications"] for r in report.collect()},
        "test_metrics": {k: float(v) for k, v in comparison.first().asDict().items() if isinstance(v, (int, float))},
    }
    trained = CalibratedModel(model, cal, metadata)
    trained.save(spark, out_path)
    for path in (split_path, val_path, test_path):
        remove_path(spark, path)
    return TrainingResult(trained, report, comparison, out_path)


def model_path(spark: SparkSession, sf_dir: str, name: str = "gbt", spec: ModelSpec | None = None, method: str = "isotonic") -> str:
    """Artifact folder, keyed by the source tables' identity, model settings and calibration."""
    text = f"{source_signature(spark, sf_dir)}|{spec or ModelSpec()!r}|{method}|{LABEL}|{DERIVATION_VERSION}"
    return f"{ensure_checkpoint_dir(spark)}/creditspark-models/{hashlib.sha1(text.encode()).hexdigest()[:16]}-{name}"


def load_or_train(spark: SparkSession, portfolio: DataFrame, path: str,
                  spec: ModelSpec | None = None, method: str = "isotonic") -> CalibratedModel:
    """The complete artifact when present, else the training job's.

    (The reference cold-starts on a small generated sample; here the cold start trains on the
    supplied portfolio's training split, so no rows are dropped.)
    """
    if artifact_exists(spark, path):
        return CalibratedModel.load(spark, path)
    return training_job(spark, portfolio, path, spec, method).model


def score_and_decide(model: CalibratedModel, applicants: DataFrame, with_factors: bool = True) -> tuple[DataFrame, DataFrame]:
    """M8 -> M9 -> O14: decisions on calibrated PDs for valid requests (V3), and the rejected rows."""
    valid, rejected = split_valid(with_applicant_defaults(applicants), applicant_rules())
    scored = model.score(valid, keep=("application_id",), carry=tuple(c for c in valid.columns if c != "application_id"))
    return decision_frame(scored, "calibrated_pd", with_factors), rejected


def simulate_portfolio(model: CalibratedModel, applications: DataFrame,
                       cutoffs=sw.DEFAULT_SIMULATION_CUTOFFS, grid_size: int = 500) -> DataFrame:
    """Calibrated score -> enrich (row terms and LGD, defaults where absent) -> evaluations at
    the cutoffs + optimum.

    One row per evaluated cutoff (rounded as the simulation endpoint does) with the optimum: the
    portfolio is scored once, and one sweep serves the cutoffs and the candidates.
    """
    portfolio = model.score(applications, keep=("application_id",), out_col="pd",
                            carry=("loan_amount", "interest_rate", "cost_of_funds", "loan_term_months", "lgd"))
    portfolio, _ = written(portfolio.drop("predicted_label"), "creditspark-scores")  # scored once, for the grid's two scans and the sweep
    enriched = enrich_portfolio(portfolio, EconomicParameters(), mode="default")
    grid = sorted({*sw.candidate_grid(enriched, grid_size), 0.5})
    asked = sw.validate_cutoffs(cutoffs)
    swept = sw.policy_sweep(enriched, sorted({*grid, *asked}))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # cutoffs: a bounded table
    candidate, pnl = F.col("threshold").isin(grid), F.col("expected_pnl")
    best = F.max(F.when(candidate, F.struct(pnl.alias("p"), (-F.col("threshold")).alias("t")))).over(whole)
    naive = F.max(F.when(F.col("threshold") == 0.5, pnl)).over(whole)
    swept = swept.withColumn("_best", best).withColumn("_naive", naive).where(F.col("threshold").isin(asked))
    return sw.round_policy(swept).select(
        *sw.POLICY_COLUMNS,
        F.bround(-F.col("_best.t"), 4).alias("optimal_threshold"),
        sw.round_money("_best.p").alias("max_expected_pnl"),
        sw.round_money("_naive").alias("baseline_05_pnl"),
        sw.round_money(F.col("_best.p") - F.col("_naive")).alias("incremental_pnl_vs_baseline"),
    )


def selection_bias(portfolio: DataFrame, approved_rule, spec: ModelSpec | None = None) -> DataFrame:
    """A model fitted on the historically approved rows only vs one fitted on all rows,
    both scored on the whole population; AUC and ECE per model."""
    biased, full = at_once(portfolio.sparkSession, lambda: fit_pipeline(prepare(portfolio.where(approved_rule)), spec),
                           lambda: fit_pipeline(prepare(portfolio), spec))
    # Each model's scores are stacked long and unioned: no join of the two scorings on an id.
    long = mt.stack_scores(score(biased, portfolio, "biased_pd"), {"approved_only": "biased_pd"}, LABEL).unionByName(
        mt.stack_scores(score(full, portfolio, "population_pd"), {"full_population": "population_pd"}, LABEL))
    long, _ = written(long, "creditspark-scores")
    return mt.metrics_bundle(long).select("score_name", "roc_auc", "expected_calibration_error")
