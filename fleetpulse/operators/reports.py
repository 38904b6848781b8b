"""Result tables: rounds summed, wide and long layouts, subtotals, top rows, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetpulse.fixed_values import PATCH_DAYS, SENSITIVITY_PATCHES, SENSITIVITY_WINDOWS, WINDOW_DAYS
from fleetpulse.functions.scalars import normalize_backbone, safe_div

STATUS_METRICS = ["precision", "recall", "f05", "fpr", "fnr"]


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """Every combination of short lists of settings, generated rather than joined."""
    out = spark.range(1).drop("id")
    for name, items in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in items])))
    return out


def on_grid(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Results on the full grid: a missing run is a row of nulls."""
    return wanted.join(results, wanted.columns, "left")


def to_wide(results: DataFrame, keys: list[str], datasets: list[str], metrics: list[str] = STATUS_METRICS) -> DataFrame:
    """One row per key with ``<dataset>_<metric>`` columns."""
    picks = [F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{d.lower()}_{m}") for d in datasets for m in metrics]
    return results.groupBy(*keys).agg(*picks)


def to_long(wide: DataFrame, keys: list[str], datasets: list[str], metrics: list[str] = STATUS_METRICS) -> DataFrame:
    """The inverse: one row per dataset; rows without precision, recall and F0.5 are left out."""
    rows = F.array(*[F.struct(F.lit(d).alias("dataset"), *[F.col(f"{d.lower()}_{m}").alias(m) for m in metrics])
                     for d in datasets])
    long = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return long.dropna(subset=[m for m in ("precision", "recall", "f05") if m in metrics])


def keep(results: DataFrame, methods: list[str] | None = None, backbones: list[str] | None = None) -> DataFrame:
    out = results
    if methods is not None:
        out = out.filter(F.col("method").isin(methods))
    if backbones is not None:
        out = out.filter(normalize_backbone(F.col("backbone")).isin(backbones))
    return out


def coverage(assignments: DataFrame, by: list[str]) -> DataFrame:
    """Matched and out-of-library patches per group, from novelty flags."""
    return with_coverage(assignments.groupBy(*by).agg(
        F.count_if(~F.col("novel")).alias("matched_patches"), F.count("novel").alias("total_patches")))


def with_coverage(counts: DataFrame) -> DataFrame:
    out = counts.withColumn("out_of_library_patches", F.col("total_patches") - F.col("matched_patches"))
    return out.withColumns({"coverage": safe_div(F.col("matched_patches"), F.col("total_patches")),
                            "out_of_library_rate": safe_div(F.col("out_of_library_patches"), F.col("total_patches"))})


def coverage_with_subtotals(assignments: DataFrame) -> DataFrame:
    """Rows per (dataset, kind, round) and an ``aggregate`` row per (dataset, kind), in one pass."""
    sets = [[F.col("dataset"), F.col("kind"), F.col("round")], [F.col("dataset"), F.col("kind")]]
    rows = assignments.groupingSets(sets, "dataset", "kind", "round").agg(
        F.count_if(~F.col("novel")).alias("matched_patches"), F.count("novel").alias("total_patches"),
        F.grouping("round").alias("_all"))
    named = rows.withColumn("round", F.when(F.col("_all") == 1, "aggregate").otherwise(F.col("round").cast("string")))
    return with_coverage(named.drop("_all"))


def supports(summary: DataFrame) -> DataFrame:
    """Failed and healthy totals per dataset with the sorted list of rounds."""
    return summary.groupBy(F.upper(F.trim("dataset")).alias("dataset")).agg(
        F.sort_array(F.collect_set("round")).alias("rounds"), F.sum("selected_failed").alias("positives"),
        F.sum("selected_healthy").alias("negatives"), F.max("healthy_per_failed").alias("healthy_per_failed"))


def label_supports(vocab: DataFrame) -> DataFrame:
    return vocab.filter("num_patches > 0").groupBy("kind", "label").agg(F.sum("num_patches").alias("support"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group; the rank filter lets Spark prune before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def best_row(df: DataFrame, by: list[str], metric: str, ties: list[str]) -> DataFrame:
    """Row with the highest metric; the first in ``ties`` order among equals."""
    names = [F.col(t) for t in ties]
    return top_per_group(df.filter(F.col(metric).isNotNull()), by, [F.desc(metric), *names], 1)


def judge_means(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("exp_score").alias("exp_score"), F.avg("rec_score").alias("rec_score"))


def robustness(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of hits over all runs; null when a group has no trial.

    ``attr_mentioned`` counts on risk-up variants, ``act_dir_correct`` on all variants.
    """
    up = F.col("direction") == "risk_up"
    moved = F.col("direction").isin("risk_up", "risk_down")
    out = rows.groupBy(*by).agg(
        F.sum(F.when(up, F.col("attr_mentioned"))).alias("attr_sens_hits"), F.count_if(up).alias("attr_sens_total"),
        F.sum(F.when(moved, F.col("act_dir_correct"))).alias("act_dir_hits"), F.count_if(moved).alias("act_dir_total"))
    return out.withColumns({
        "attr_sens": F.when(F.col("attr_sens_total") > 0, F.col("attr_sens_hits") / F.col("attr_sens_total")),
        "act_dir_acc": F.when(F.col("act_dir_total") > 0, F.col("act_dir_hits") / F.col("act_dir_total"))})


def settings(spark: SparkSession, study: str, window_values: Sequence[int] = SENSITIVITY_WINDOWS,
             patch_values: Sequence[int] = SENSITIVITY_PATCHES) -> DataFrame:
    """Settings of a study, the baseline value merged in, sorted and distinct."""
    if study == "window":
        pairs = [(n, PATCH_DAYS) for n in sorted({*window_values, WINDOW_DAYS})]
    elif study == "patch":
        pairs = [(WINDOW_DAYS, p) for p in sorted({*patch_values, PATCH_DAYS})]
    else:
        raise ValueError(f"unknown study {study}")
    return spark.createDataFrame([(study, n, p) for n, p in pairs], "study string, window_days int, patch_len int")


def sensitivity_long(tables: DataFrame, datasets: list[str]) -> DataFrame:
    """Wide tables of all settings to sorted long rows with the baseline flag."""
    keys = ["study", "window_days", "patch_len", "method", "backbone"]
    long = to_long(tables, keys, datasets)
    flagged = long.withColumn("is_baseline", (F.col("window_days") == WINDOW_DAYS) & (F.col("patch_len") == PATCH_DAYS))
    return flagged.orderBy("dataset", "method", "backbone", "window_days", "patch_len")


def sensitivity_means(long: DataFrame) -> DataFrame:
    return long.groupBy("study", "dataset", "method", "backbone").agg(*[F.avg(m).alias(m) for m in STATUS_METRICS])
