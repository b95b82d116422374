"""Intermediate tables in the shared folder that the session names (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from creditspark.session import ensure_checkpoint_dir


class Scratch:
    """A folder of written tables: lineage ends there, so a lost executor costs one re-read.

    ``table`` writes a DataFrame and reads it back; ``drop`` removes tables that no later plan
    reads. The folder lies on the shared path, never on a machine's own disk.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        df.write.parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished queries: it does once the driver's JVM has collected
        what refers to them, which by itself it may not do for long."""
        self.spark._jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it (Spark's names don't tell letter case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if that path exists there."""
    from pathlib import Path

    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
