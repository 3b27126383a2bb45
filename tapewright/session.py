"""Session defaults that the engine's semantics rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC everywhere; skewed joins split; the state store that arbitrary state needs.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tapewright", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """A fresh folder name where driver and executors can share tables: below ``spark.checkpoint.dir``.

    Only a session with a local master may do without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or tempfile.mkdtemp(prefix='tapewright-')).rstrip('/')}/{uuid.uuid4().hex}"
