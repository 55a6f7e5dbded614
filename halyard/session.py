"""Session options and the shared scratch location."""

from __future__ import annotations

import datetime as dt
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The fixed clock of the fixtures: the last o_orderdate is 2001-08-01.
AS_OF = dt.datetime(2001, 8, 1, 12, 0, 0)

SESSION_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    # The state of the change fold has a row for each id: off the heap, on disk.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "halyard", extra: dict | None = None) -> SparkSession:
    """A session with the options every operator assumes (UTC, NTZ, AQE).

    On a cluster pass ``master=None`` and size ``shuffle_partitions`` to the
    data: about 128-256 MB of shuffle per partition at the largest stage
    (100 TB of input shuffles through tens of thousands of partitions). AQE
    coalesces the partitions of smaller stages and splits skewed ones; pass
    ``extra={"spark.sql.adaptive.coalescePartitions.initialPartitionNum": ...}``
    to start high and let it coalesce.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        # A local driver must bind to loopback, or large collects stall on
        # block fetch retries.
        builder = builder.config("spark.driver.host", "127.0.0.1")
        builder = builder.config("spark.driver.memory", "8g")
    for key, value in {**SESSION_OPTIONS,
                       "spark.sql.shuffle.partitions": str(shuffle_partitions),
                       **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local-mode
    session (tests, bench) without one gets a fresh folder under /tmp; a
    cluster session without one is an error, since a machine-local folder
    would not survive the loss of that machine.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster is a cluster
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        conf_dir = tempfile.mkdtemp(prefix="halyard-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for written intermediate tables, under the checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tables", f"{name}-{dt.datetime.now():%Y%m%d%H%M%S}-"
                                       f"{uuid.uuid4().hex[:12]}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Removes, at its end, the scratch tables written inside it (by any
    operator): use their results, or write them elsewhere, before it ends.
    Scopes may be nested; without one, scratch tables stay until the folder
    that ``spark.checkpoint.dir`` names is cleaned."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the scratch folder and read back, for frames
    that a plan reads several times. Frames with a column of no type, which
    parquet cannot hold, stay as they are."""
    if "void" in df.schema.simpleString():
        return df
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
