"""SparkSession construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry; a cluster deployment sets the rest
# (executor sizing, shuffle partitions, checkpoint dir) in its own conf.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "creditspark", extra: dict | None = None) -> SparkSession:
    """Session for tests and local benchmarks (single JVM, ``local[cpus]``)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.driver.memory"] = os.environ.get("CREDITSPARK_DRIVER_MEMORY", "16g")
    conf["spark.sql.shuffle.partitions"] = str(
        shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    )
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scratch_root(conf_dir: str | None, master: str) -> str:
    """The folder for intermediate tables: the configured one, else a new one on a local master.

    Executors of a cluster don't share the driver's disk, so there a folder must be configured.
    """
    if conf_dir:
        return conf_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="creditspark-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, creating a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is (without one
    this raises); a local scratch folder is only made for tests and local runs.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or scratch_root(sc.getConf().get("spark.checkpoint.dir", None), sc.master)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current

