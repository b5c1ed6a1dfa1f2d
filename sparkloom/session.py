"""Session settings and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.orc.filterPushdown": "true",
}


def session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_session_properties(spark: SparkSession, properties: dict[str, str], time_zone: str | None = None, legacy_timestamp: bool = True) -> None:
    """Query-level settings: Spark properties, the zone, and what a bare timestamp means.

    With ``legacy_timestamp`` a timestamp is an instant shown in the session
    zone; without it, a local date and time.
    """
    for key, value in properties.items():
        spark.conf.set(key, value)
    if time_zone:
        spark.conf.set("spark.sql.session.timeZone", time_zone)
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_LTZ" if legacy_timestamp else "TIMESTAMP_NTZ")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name where all executors can read and write: under
    ``spark.checkpoint.dir``, on the session's default file system where that
    names none. A session on one machine may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    if "://" not in root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root}/sparkloom-{label}-{uuid.uuid4().hex}"
