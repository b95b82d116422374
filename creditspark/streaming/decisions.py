"""O14 on Structured Streaming: the batch decision projection over a file stream.

Decisioning is stateless (one select per application), so the streaming plan needs no
watermark or state store; exactly-once output comes from the file sink plus the query
checkpoint. Requests without a PD are scored on arrival (``start_scored_stream``): one pass over
each micro-batch validates, scores, calibrates and decides, and writes accepted and broken requests
together under the batch's number, so a batch that is run again replaces its own output. ``availableNow`` drains whatever the source holds and stops, which is how tests
and scheduled jobs run it; a long-running deployment uses a processing-time trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from creditspark.functions.invariants import observed, write_checked
from creditspark.functions.validation import applicant_rules, validate, with_applicant_defaults
from creditspark.ml.train import CalibratedModel
from creditspark.operators.decisioning import DECISION_COLUMNS, decide, decision_frame

APPLICANT_SCHEMA = T.StructType([
    T.StructField("application_id", T.LongType()),
    T.StructField("monthly_income", T.DoubleType()),
    T.StructField("debt_to_income", T.DoubleType()),
    T.StructField("historical_delinquencies", T.LongType()),
    T.StructField("revolving_utilization", T.DoubleType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("loan_term_months", T.LongType()),
    T.StructField("interest_rate", T.DoubleType()),
    T.StructField("cost_of_funds", T.DoubleType()),
    T.StructField("pd", T.DoubleType()),
    T.StructField("lgd", T.DoubleType()),
    T.StructField("policy_threshold", T.DoubleType()),
])


def decision_stream(spark: SparkSession, source_dir: str, schema: T.StructType = APPLICANT_SCHEMA,
                    max_files_per_trigger: int | None = None, with_factors: bool = False) -> DataFrame:
    """Streaming decision records of the valid requests (V3) under ``source_dir``; the rest are
    ``rejected_stream``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    decisions, _ = decide(reader.parquet(source_dir), with_factors=with_factors)
    return decisions if with_factors else decisions.select(*DECISION_COLUMNS)


def rejected_stream(spark: SparkSession, source_dir: str, schema: T.StructType = APPLICANT_SCHEMA) -> DataFrame:
    """Streaming rows that break a V3 rule, with their ``violations``."""
    return decide(spark.readStream.schema(schema).parquet(source_dir), with_factors=False)[1]


def start_decision_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                          available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the stream into a parquet sink (append mode, checkpointed)."""
    writer = (observed(decision_stream(spark, source_dir)).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "30 seconds")
    return writer.start(sink_dir)


def run_decision_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str) -> DataFrame:
    """Drain the source once (``availableNow``) and return the sink as a batch DataFrame."""
    query = start_decision_stream(spark, source_dir, sink_dir, checkpoint_dir, available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(sink_dir)


#: Decision requests as they arrive: no PD.
REQUEST_SCHEMA = T.StructType([f for f in APPLICANT_SCHEMA.fields if f.name != "pd"])


def scored_decisions(model: CalibratedModel, requests: DataFrame) -> DataFrame:
    """``(outcome, decision columns, violations)``: every request once, in one projection.

    Valid ones (V3) are ``decided`` on their calibrated PD; the others are ``rejected`` with the rules they
    break and no decision.
    """
    checked = validate(with_applicant_defaults(requests), applicant_rules())
    own = tuple(c for c in checked.columns if c != "application_id")
    decided = decision_frame(model.score(checked, keep=("application_id",), carry=own), "calibrated_pd", with_factors=False,
                             carry=("violations", "is_valid"))
    valid = F.col("is_valid")
    return decided.select(
        F.when(valid, "decided").otherwise("rejected").alias("outcome"), "application_id",
        *[F.when(valid, F.col(c)).alias(c) for c in DECISION_COLUMNS if c != "application_id"], "violations")


def write_scored_batch(model: CalibratedModel, batch: DataFrame, batch_id: int, sink_dir: str) -> None:
    """The batch's rows under ``batch=<id>/outcome=...``; a repeated batch replaces what it wrote before.

    A batch that breaks an output invariant (V8) leaves nothing and fails the stream."""
    write_checked(scored_decisions(model, batch), f"{sink_dir.rstrip('/')}/batch={batch_id}", ("outcome",))


def start_scored_stream(spark: SparkSession, model: CalibratedModel, source_dir: str, sink_dir: str, checkpoint_dir: str,
                        available_now: bool = True, processing_time: str | None = None,
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start scoring and deciding the requests that arrive under ``source_dir``."""
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    writer = (reader.parquet(source_dir).writeStream.option("checkpointLocation", checkpoint_dir)
              .foreachBatch(lambda batch, batch_id: write_scored_batch(model, batch, batch_id, sink_dir)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "30 seconds")
    return writer.start()


def read_scored(spark: SparkSession, sink_dir: str, outcome: str | None = None) -> DataFrame:
    """What the scored stream has written; ``outcome`` (decided or rejected) prunes folders."""
    fields = [T.StructField("application_id", T.LongType()), T.StructField("decision", T.StringType()),
              *[T.StructField(c, T.DoubleType()) for c in DECISION_COLUMNS[2:]], T.StructField("violations", T.ArrayType(T.StringType())),
              T.StructField("batch", T.LongType()), T.StructField("outcome", T.StringType())]
    rows = spark.read.schema(T.StructType(fields)).option("basePath", sink_dir).parquet(sink_dir)
    return rows.where(F.col("outcome") == outcome) if outcome else rows


def run_scored_stream(spark: SparkSession, model: CalibratedModel, source_dir: str, sink_dir: str, checkpoint_dir: str) -> DataFrame:
    """Drain the source once (``availableNow``) and return all that the sink holds."""
    query = start_scored_stream(spark, model, source_dir, sink_dir, checkpoint_dir)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return read_scored(spark, sink_dir)
