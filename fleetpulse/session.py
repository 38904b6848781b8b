"""Session factory and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app_name: str = "fleetpulse", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; on a cluster pass no master and let spark-submit decide the sizing."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # frames multiply the bytes of a shuffled row, so small shuffle partitions are still real work
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        root = os.path.join(tempfile.gettempdir(), "fleetpulse-scratch")
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` for tables a job writes and reads back.

    A machine-local folder is used only in local mode, where every task sees it.
    """
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Cut lineage through a written table, so a lost executor re-reads instead of recomputing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def learned_dir(spark: SparkSession) -> str:
    """Where tables are kept that are learned once: ``fleetpulse.learned.dir``, else a folder of this application's own, so that
    tables that other versions of the code have learned are not read.
    """
    return spark.conf.get("fleetpulse.learned.dir", None) or f"{_scratch_root(spark)}/learned-{spark.sparkContext.applicationId}"
