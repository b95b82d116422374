"""Paths on whatever file system Spark's configuration names (Hadoop API; no local file calls)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _resolve(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _resolve(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, built: str, path: str) -> bool:
    """Rename a finished build to its final name; False if that name is taken by a complete one."""
    fs, source = _resolve(spark, built)
    _, target = _resolve(spark, path)
    if path_exists(spark, f"{path}/_SUCCESS"):
        return False
    fs.mkdirs(target.getParent())
    return bool(fs.rename(source, target)) or not path_exists(spark, built)
