"""S3/V5 in bulk: record files parsed on the executors, with strict types and a closed set of fields per record.

Each line is one JSON object. Nothing is inferred and nothing coerced: a text or a boolean isn't a number, a
fraction isn't a whole number, a field that isn't declared rejects its record, a required one that is absent or
null does too. Records that don't fit keep their text and the rules they break; no record goes through the
driver and none is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which JSON types hold a value of a declared type; whole numbers are also fractions.
_ACCEPTED = {"bigint": "BIGINT", "double": "BIGINT|DOUBLE|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN"}


def parse_records(lines: DataFrame, schema: T.StructType, required: Sequence[str] = (), line_col: str = "value") -> DataFrame:
    """``(fields of schema, violations array<string>, record)``: a row per line of ``lines``.

    ``violations`` holds ``malformed`` (no JSON, a repeated field, a null line), ``not_an_object``, ``unknown:<field>``,
    ``type:<field>`` and ``missing:<field>``, in that order; a field of the wrong type is null. Blank lines are no records.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    if unsupported := {k for k in kinds.values() if k not in _ACCEPTED}:
        raise ValueError(f"record fields can't be {sorted(unsupported)}")
    if clash := {"violations", "record"} & {k.lower() for k in kinds}:
        raise ValueError(f"record fields can't be named {sorted(clash)}")
    if absent := [c for c in required if c not in kinds]:
        raise ValueError(f"required fields aren't declared: {absent}")
    text = F.col(line_col).cast("string")
    rows = lines.where(F.coalesce(F.trim(text) != "", F.lit(True))).select(text.alias("record"))
    rows = rows.withColumn("_json", F.try_parse_json("record"))
    rows = rows.withColumn("_keys", F.when(F.schema_of_variant("_json").startswith("OBJECT"), F.json_object_keys("record")))
    values: dict[str, Column] = {}
    checks: list[Column] = []
    for name, kind in kinds.items():
        found = F.schema_of_variant(F.variant_get("_json", f"$['{name}']", "variant"))
        given = F.coalesce(F.array_contains("_keys", name), F.lit(False)) & (F.coalesce(found, F.lit("VOID")) != "VOID")
        fits = found.rlike(f"^({_ACCEPTED[kind]})$")
        values[name] = F.when(given & fits, F.try_variant_get("_json", f"$['{name}']", kind))
        checks.append(F.when(given & (~fits | values[name].isNull()), F.lit(f"type:{name}")))
        if name in required:
            checks.append(F.when(F.col("_keys").isNotNull() & ~given, F.lit(f"missing:{name}")))
    unknown = F.transform(F.array_sort(F.array_except(F.coalesce("_keys", F.array().cast("array<string>")), F.lit(list(kinds)))),
                          lambda k: F.concat(F.lit("unknown:"), k))
    shape = F.array(F.when(F.col("_json").isNull(), F.lit("malformed")).when(F.col("_keys").isNull(), F.lit("not_an_object")))
    return rows.select(*[v.alias(n) for n, v in values.items()], F.array_compact(F.concat(shape, unknown, F.array(*checks))).alias("violations"), "record")


def read_records(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """``parse_records`` of the files under ``path``."""
    return parse_records(spark.read.text(path), schema, required)


def split_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The typed records, and those that break a rule as ``(record, violations)``."""
    fits = F.size("violations") == 0
    return parsed.where(fits).drop("violations", "record"), parsed.where(~fits).select("record", "violations")
