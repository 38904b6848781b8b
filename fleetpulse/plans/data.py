"""Daily logs to stored windows and the evaluation index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetpulse.fixed_values import HEALTHY_PER_FAILED, SAMPLE_SEED, SKIPPED_DAY_FILES, WINDOW_DAYS
from fleetpulse.operators.sampling import class_counts, require_both_classes, sampled_index, sampling_summary
from fleetpulse.operators.windows import SplitRule, build_windows, impute, one_row_per_day
from fleetpulse.sources.daily_logs import project_models, read_daily_logs, with_day
from fleetpulse.sources.window_store import read_split, read_store, write_windows


def store_fleet(spark: SparkSession, log_dirs: list[str], tags: DataFrame, models: list[str], path: str,
                rule: SplitRule = SplitRule(), size: int = WINDOW_DAYS) -> list[str]:
    """Scan, project, impute, window, label, split and store all listed device models, with one scan of the logs.

    Returns the attributes that the logs have. Daily rows hold the attributes of all listed models; a model's windows are read with its own.
    """
    daily = with_day(project_models(read_daily_logs(spark, log_dirs, skipped=SKIPPED_DAY_FILES), models))
    features = [c for c in daily.columns if c.startswith("r_")]
    daily = one_row_per_day(daily, features)  # windows are known by device and last day
    write_windows(impute(daily, features), f"{path}/daily", ["model"])
    stored = read_split(spark, f"{path}/daily").filter(F.col("model").isin(models))
    write_windows(build_windows(stored, tags, features, rule, size, keep_arrays=False), f"{path}/keys")
    return features


def store_windows(spark: SparkSession, log_dirs: list[str], tags: DataFrame, model: str, path: str,
                  rule: SplitRule = SplitRule(), size: int = WINDOW_DAYS) -> DataFrame:
    """The same for one device model; returns the stored windows with their arrays."""
    return read_store(spark, path, store_fleet(spark, log_dirs, tags, [model], path, rule, size), size, model)


def evaluation_index(windows: DataFrame, ratio: float = HEALTHY_PER_FAILED, seed: int = SAMPLE_SEED) -> tuple[DataFrame, DataFrame]:
    """The sampled test index of every model and round, and its summary."""
    test = windows.filter("split = 'test'").select("model", "round", "disk_id", "end_day", "y")
    require_both_classes(class_counts(test, ["model", "round"]))
    index = sampled_index(test, ["model", "round"], ["disk_id", "end_day"], ratio, seed)
    return index, sampling_summary(test, index, ["model", "round"])
