"""Requests scored on arrival: equal to the batch path, each once, also after a restart or a repeated batch."""

import pytest
from pyspark.sql import functions as F

from creditspark.ml.pipeline import BoostingConfig, ModelSpec
from creditspark.ml.train import score_and_decide, training_job
from creditspark.sources.portfolio import derive_portfolio, raw_applications
from creditspark.streaming.decisions import (
    DECISION_COLUMNS,
    REQUEST_SCHEMA,
    read_scored,
    run_scored_stream,
    scored_decisions,
    write_scored_batch,
)

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def model(spark):
    return training_job(spark, derive_portfolio(spark, SF_SMALL), spec=ModelSpec(kind="logistic", boosting=BoostingConfig(max_iter=2))).model


@pytest.fixture(scope="module")
def requests(spark):
    raw = raw_applications(spark, SF_SMALL)
    names = {f.name: f.dataType for f in REQUEST_SCHEMA.fields}
    rows = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
    bad = rows.limit(3).withColumn("application_id", -F.col("application_id") - 1).withColumn("monthly_income", F.lit(-5.0))
    return rows.unionByName(bad).cache()


def records(df):
    return sorted(tuple(r) for r in df.select(*DECISION_COLUMNS).collect())


def test_stream_equals_batch_and_survives_a_restart(spark, model, requests, tmp_path):
    src, sink, ckpt = (str(tmp_path / d) for d in ("src", "sink", "ckpt"))
    first, second = requests.where("application_id % 3 = 0"), requests.where("application_id % 3 <> 0")
    first.write.parquet(f"{src}/a")
    first = spark.read.parquet(f"{src}/a")
    files = [p for p in (tmp_path / "src" / "a").iterdir() if p.suffix == ".parquet"]
    for p in files:  # the stream reads files directly under the source
        (tmp_path / "src" / f"a-{p.name}").write_bytes(p.read_bytes())
    one = run_scored_stream(spark, model, f"{src}", sink, ckpt).count()
    assert one == first.count()
    second.write.parquet(f"{src}/b")
    for p in [p for p in (tmp_path / "src" / "b").iterdir() if p.suffix == ".parquet"]:
        (tmp_path / "src" / f"b-{p.name}").write_bytes(p.read_bytes())
    both = run_scored_stream(spark, model, f"{src}", sink, ckpt)
    assert both.count() == requests.count()
    assert run_scored_stream(spark, model, f"{src}", sink, ckpt).count() == requests.count()  # nothing new arrived

    decided, rejected = score_and_decide(model, requests, with_factors=False)
    assert records(read_scored(spark, sink, "decided")) == records(decided)
    broken = {r["application_id"]: r["violations"] for r in read_scored(spark, sink, "rejected").collect()}
    assert broken == {r["application_id"]: r["violations"] for r in rejected.collect()} and len(broken) >= 3
    assert read_scored(spark, sink, "rejected").where("decision is not null").count() == 0


def test_a_repeated_batch_replaces_its_output(spark, model, requests, tmp_path):
    sink = str(tmp_path / "sink")
    for _ in range(2):
        write_scored_batch(model, requests.limit(50), 0, sink)
    write_scored_batch(model, requests.limit(0), 1, sink)
    assert read_scored(spark, sink).count() == 50


def test_requests_are_read_once(spark, model, requests):
    plan = scored_decisions(model, requests)._jdf.queryExecution().optimizedPlan().toString()
    above, *below = plan.split("InMemoryRelation")
    assert len(below) == 1 and "Join" not in above and "Union" not in above


def test_the_written_check_scores_no_row_again(spark, model, requests):
    from creditspark.functions.invariants import guarded

    decided = scored_decisions(model, requests)
    calls = [df._jdf.queryExecution().optimizedPlan().toString().count("UDF(") for df in (decided, guarded(decided))]
    assert calls[0] == calls[1] > 0
