"""Sessions and the settings this engine expects of a cluster."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Adaptive execution deals with skew and partition counts; statistics drive join order where tables are analysed.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.timeType.enabled": "true",
}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (clusters without that path: ``--py-files``)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; in local mode a temporary one does."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return _local[0]


def session(app: str = "larkspur", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return importable(builder.getOrCreate())


def current_setting(spark: SparkSession, name: str, missing_ok: bool = False) -> str | None:
    found = spark.conf.get(name, None)
    if found is None and not missing_ok:
        raise KeyError(f"unrecognized configuration parameter {name!r}")
    return found


def set_config(spark: SparkSession, name: str, value: str) -> str:
    spark.conf.set(name, value)
    return value


def reset(spark: SparkSession, name: str) -> None:
    spark.conf.unset(name)
