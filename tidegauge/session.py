"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tidegauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and the state store the streaming operators need."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call sites of every column call cost more than planning the query
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_STATE,
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
        # methods above this size are never compiled by the JVM; smaller ones are generated then
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Epoch arithmetic on zone-less columns needs a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is configured a temporary one serves, but only if driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame as a table in a shared folder: computed once, read by everything after it."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"  # jobs on one store stay apart
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
