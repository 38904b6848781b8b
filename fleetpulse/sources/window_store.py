"""Windows as partitioned tables: write, read, validate, and find what is missing.

A store holds every daily row once and one short key row per window, round and split. The arrays, which repeat each day
``size`` times in every round, are made when a split is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetpulse.fixed_values import LABEL_COLUMNS, WINDOW_DAYS
from fleetpulse.operators.windows import KEYS, row_windows

PARTITIONS = ["model", "round", "split"]


def write_windows(windows: DataFrame, path: str, partitions: list[str] = PARTITIONS) -> None:
    """Rewrites only the partitions present in ``windows``.

    Rows of one partition are spread over as many files as their size asks for, so a large partition does
    not end up in one task and a small one not in many files.
    """
    (windows.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def write_store(daily: DataFrame, keys: DataFrame, path: str) -> None:
    """Daily rows without gaps to ``daily``, window keys (with labels, without arrays) to ``keys``."""
    write_windows(daily, f"{path}/daily", ["model"])
    write_windows(keys, f"{path}/keys")


def read_store(spark: SparkSession, path: str, features: list[str], size: int = WINDOW_DAYS, model: str | None = None,
               round_id: int | None = None, split: str | None = None) -> DataFrame:
    """Windows of a store with their arrays. Keys are pruned by partition and meet the daily rows before any array is made."""
    daily = read_split(spark, f"{path}/daily", model).select(*KEYS, "day", *features)
    keys = read_split(spark, f"{path}/keys", model, round_id, split)
    facts = [c for c in keys.columns if c not in (*KEYS, "end_day")]
    # a window has at most one key per round
    places = keys.groupBy(*KEYS, F.col("end_day").alias("day")).agg(F.collect_list(F.struct(*facts)).alias("_w"))
    windows = row_windows(daily.join(places, [*KEYS, "day"], "left"), features, size).filter(F.col("_w").isNotNull())
    return windows.select(*[c for c in windows.columns if c != "_w"], F.inline("_w"))


def read_split(spark: SparkSession, path: str, model: str | None = None, round_id: int | None = None,
               split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    for c, v in (("model", model), ("round", round_id), ("split", split)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df


def find_label(df: DataFrame) -> str:
    """First label column present, whatever its case."""
    present = {c.lower(): c for c in df.columns}
    for name in LABEL_COLUMNS:
        if name in present:
            return present[name]
    raise ValueError(f"none of {LABEL_COLUMNS} in {df.columns}")


def summarize_split(windows: DataFrame, features: list[str], by: list[str] = PARTITIONS) -> DataFrame:
    """Window count, days, attributes and class counts per split; ``valid`` when every length agrees."""
    missing = [c for c in [*features, "y", "ttf"] if c not in windows.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    lengths = F.array(*[F.size(c) for c in features])
    return windows.groupBy(*by).agg(
        F.count("*").alias("num_windows"),
        F.max(F.array_max(lengths)).alias("window_days"),
        F.lit(len(features)).alias("num_attributes"),
        F.count_if(F.col("y") == 1).alias("num_failed"),
        F.count_if(F.col("y") == 0).alias("num_healthy"),
        (F.max(F.array_max(lengths)) == F.min(F.array_min(lengths))).cast("int").alias("valid"),
    )


def missing_partitions(requested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys that no stored row has yet: what a rebuild has to produce."""
    return requested.join(existing.select(*keys).distinct(), keys, "left_anti")
