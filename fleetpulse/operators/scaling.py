"""Scalers learned on train rows and applied to every split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.ml.stat import Summarizer

from fleetpulse.fixed_values import MIN_RANGE, SCALER_EPS, WINDOW_DAYS
from fleetpulse.functions.scalars import finite_or_zero
from fleetpulse.operators.windows import by_device


def train_cover(rows: DataFrame, is_train: Column, size: int = WINDOW_DAYS, out: str = "cover") -> DataFrame:
    """How many train windows contain a daily row; ``is_train`` marks rows where such a window ends."""
    ahead = by_device().rowsBetween(0, size - 1)
    return rows.withColumn(out, F.coalesce(F.sum(F.when(is_train, 1).otherwise(0)).over(ahead), F.lit(0)))


def window_scaler(rows: DataFrame, features: list[str], by: list[str], cover: str = "cover") -> DataFrame:
    """Mean and population std (+ 1e-6) over all days of all train windows: (by, attr, mean, std).

    A day counts once per window that holds it. Instead of exploding the windows the rows are grouped by
    that multiplicity, at most the window length many groups, and the groups' moments are merged.
    """
    from fleetpulse.operators.windows import unpivot_features

    kept = rows.filter(F.col(cover) > 0)
    long = unpivot_features(kept, [*by, cover], features)
    parts = long.groupBy(*by, "attr", cover).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = F.col(cover) * F.col("n")
    means = parts.groupBy(*by, "attr").agg(
        F.sum(w).alias("total"), (F.sum(w * F.col("m")) / F.sum(w)).alias("mean"),
        F.sort_array(F.collect_list(F.struct(F.col(cover), w.alias("w"), "m", "v"))).alias("parts"))
    spread = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["w"] * (
        p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    return means.select(*by, "attr", "mean", (F.sqrt(spread / F.col("total")) + SCALER_EPS).alias("std"))


def scaler_row(scaler: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """The scaler as one row per group: mean_<attr>, std_<attr>."""
    picks = [F.max(F.when(F.col("attr") == c, F.col(s))).alias(f"{s}_{c}") for c in features for s in ("mean", "std")]
    return scaler.groupBy(*by).agg(*picks)


def standardize(rows: DataFrame, scaler: DataFrame, features: list[str], by: list[str], prefix: str = "z_") -> DataFrame:
    """Adds ``z_<attr>``. The scaler holds one row per learned group, so it is broadcast."""
    joined = rows.join(F.broadcast(scaler_row(scaler, features, by)), by)
    made = {f"{prefix}{c}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in features}
    return joined.withColumns(made).drop(*[f"{s}_{c}" for c in features for s in ("mean", "std")])


def standardize_columns(df: DataFrame, columns: list[str], by: list[str], is_train: Column) -> DataFrame:
    """Zero mean and unit population std per column, learned on train rows; constant columns only shift."""
    stats = df.filter(is_train).groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(F.broadcast(stats), by)
    made = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
            for c in columns}
    return joined.withColumns(made).drop(*[f"_{s}_{c}" for c in columns for s in "ms"])


def minmax_ranges(train: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Per dimension minimum and range (1 when below 1e-6) of a vector column, one row per group."""
    from pyspark.ml.functions import vector_to_array

    stats = train.groupBy(*by).agg(Summarizer.metrics("min", "max").summary(F.col(vector)).alias("s"))
    return stats.select(*by, vector_to_array("s.min").alias("mins"), F.zip_with(
        vector_to_array("s.max"), vector_to_array("s.min"),
        lambda hi, lo: F.when(hi - lo < MIN_RANGE, F.lit(1.0)).otherwise(hi - lo)).alias("ranges"))


def minmax_scale(df: DataFrame, ranges: DataFrame, values: str, by: list[str], out: str) -> DataFrame:
    """Array column scaled with the learned ranges; non-finite results become 0."""
    joined = df.join(F.broadcast(ranges), by)
    shifted = F.zip_with(values, "mins", lambda x, lo: x - lo)
    return joined.withColumn(out, F.zip_with(shifted, "ranges", lambda x, r: finite_or_zero(x / r))).drop("mins", "ranges")
