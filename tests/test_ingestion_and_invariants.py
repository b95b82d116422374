"""Strict record files, and output invariants that raise in batch and on streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.invariants import InvariantError, InvariantListener, broken, invariant_counts, observed, write_checked
from creditspark.sources.requests import parse_records, read_records, split_records
from creditspark.sources.storage import path_exists

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("income", T.DoubleType()), T.StructField("name", T.StringType()),
                       T.StructField("known", T.BooleanType())])


@pytest.mark.parametrize("line, values, violations", [
    ('{"id": 1, "income": 2.5, "name": "a"}', (1, 2.5, "a", None), []),
    ('{"id": 2, "income": 3}', (2, 3.0, None, None), []),
    ('{"id": 2, "income": 1e3, "known": true}', (2, 1000.0, None, True), []),
    ('{"id": "3", "income": 1}', (None, 1.0, None, None), ["type:id"]),
    ('{"id": 4, "income": true}', (4, None, None, None), ["type:income"]),
    ('{"id": 5.5, "income": "x", "name": 7}', (None, None, None, None), ["type:id", "type:income", "type:name"]),
    ('{"id": 6}', (6, None, None, None), ["missing:income"]),
    ('{"id": 6, "income": null}', (6, None, None, None), ["missing:income"]),
    ('{"id": 7, "income": 1, "zeta": 1, "Extra": {"a": [1]}}', (7, 1.0, None, None), ["unknown:Extra", "unknown:zeta"]),
    ('{"id": 8, "income": 1, "ID": 8}', (8, 1.0, None, None), ["unknown:ID"]),
    ('{"id": 9, "income": 1', (None, None, None, None), ["malformed"]),
    ('{"id": 9, "id": 10, "income": 1}', (None, None, None, None), ["malformed"]),
    ("[1, 2]", (None, None, None, None), ["not_an_object"]),
    ("17", (None, None, None, None), ["not_an_object"]),
    ('{"id": 99999999999999999999, "income": 1}', (None, 1.0, None, None), ["type:id"]),
])
def test_each_record_is_taken_strictly(spark, line, values, violations):
    (row,) = parse_records(spark.createDataFrame([(line,)], "value string"), SCHEMA, ["id", "income"]).collect()
    assert (list(row[:4]), row[4], row["record"]) == (list(values), violations, line)


def test_files_of_mixed_records(spark, tmp_path):
    rows = [{"id": i, "income": i * 1.5} if i % 5 else {"id": i, "income": str(i)} for i in range(20_000)]
    for part in range(4):
        (tmp_path / f"p{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part::4]) + "\n\n  \n")
    good, bad = split_records(read_records(spark, str(tmp_path), SCHEMA, ["id"]))
    assert good.columns == ["id", "income", "name", "known"] and good.count() == 16_000
    assert bad.count() == 4_000 and bad.select(F.explode("violations")).distinct().collect()[0][0] == "type:income"
    with pytest.raises(ValueError):
        parse_records(spark.createDataFrame([("{}",)], "value string"), SCHEMA, ["other"])
    assert parse_records(spark.createDataFrame([], "value string"), SCHEMA).collect() == []


def results(spark, rate):
    return spark.createDataFrame([(0.1, 10, 4, 0.4, 100.0), (0.2, 10, 5, rate, 120.0)], "threshold double, total_applications long, approved_count long, approval_rate double, total_exposure double")


def test_a_broken_result_raises_and_leaves_nothing(spark, tmp_path):
    write_checked(results(spark, 0.5), str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    for rate in (1.5, -0.1, float("nan")):
        with pytest.raises(InvariantError, match="approval_rate_0_1"):
            write_checked(results(spark, rate), str(tmp_path / "bad"))
        assert not path_exists(spark, str(tmp_path / "bad"))
    frame = results(spark, None)
    assert broken(frame.agg(*invariant_counts(frame.columns)).first().asDict()) == {}
    wrong = frame.withColumn("approved_count", F.lit(11)).withColumn("total_exposure", F.lit(float("nan")))
    assert broken(wrong.agg(*invariant_counts(wrong.columns)).first().asDict()) == {"approved_count_le_total_applications": 2, "total_exposure_ge_0": 2}


@pytest.mark.parametrize("rate, fails", [(0.5, False), (2.0, True)])
def test_the_listener_sees_broken_streams(spark, tmp_path, rate, fails):
    src = str(tmp_path / "src")
    results(spark, rate).write.parquet(src)
    listener = InvariantListener(spark)
    spark.streams.addListener(listener)
    try:
        stream = observed(spark.readStream.schema(results(spark, 0.1).schema).parquet(src))
        query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")))
        query.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.rows == 2 and bool(listener.found) == fails
    if fails:
        with pytest.raises(InvariantError):
            listener.check()
