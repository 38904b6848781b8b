"""Class-ratio and capped samples.

The draw is the md5 order of seed and key, so it is repeatable, does not depend on partitioning and
can be replayed in SQL. Group sizes are counted, ranks are taken inside hash buckets, and no class
is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.fixed_values import HEALTHY_PER_FAILED, SAMPLE_SEED
from fleetpulse.functions.scalars import safe_div
from fleetpulse.operators.ranking import hash_rank
from fleetpulse.session import materialize


def class_counts(df: DataFrame, by: list[str], label: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("n_failed"), F.count_if(F.col(label) == 0).alias("n_healthy"))


def require_both_classes(counts: DataFrame) -> DataFrame:
    """Raises when a group lacks a class; the counts are one row per group."""
    bad = counts.filter("n_failed = 0 or n_healthy = 0").limit(1).collect()
    if bad:
        raise ValueError(f"need at least one failed and one healthy sample: {bad[0]}")
    return counts


def take(df: DataFrame, by: list[str], keys: list[str], seed: int, failed: Column, healthy: Column, label: str = "y") -> DataFrame:
    """Keeps ``failed`` and ``healthy`` rows per group; both may use n_failed and n_healthy."""
    labelled = df.filter(F.col(label).isin(0, 1))
    # one row per group, stored, so that the planner joins it by its size
    limited = labelled.join(materialize(class_counts(labelled, by, label), "class-counts"), by)
    quota = F.when(F.col(label) == 1, failed).otherwise(healthy).cast("long")
    ranked = hash_rank(limited.withColumn("_quota", quota), [*by, label], keys, seed, "_rank", F.col("_quota"))
    return ranked.select(*df.columns)


def _half_even(x: Column) -> Column:
    return F.bround(x, 0)


def by_ratio(df: DataFrame, by: list[str], keys: list[str], ratio: float = HEALTHY_PER_FAILED, seed: int = SAMPLE_SEED,
             max_failed: int | None = None, label: str = "y") -> DataFrame:
    """All failed rows (or ``max_failed`` of them) and ``ratio`` healthy rows per failed one."""
    failed = F.col("n_failed") if max_failed is None else F.least(F.col("n_failed"), F.lit(max_failed))
    healthy = F.least(F.col("n_healthy"), _half_even(failed * F.lit(float(ratio))).cast("long"))
    return take(df, by, keys, seed, failed, healthy, label)


def one_to_one(df: DataFrame, by: list[str], keys: list[str], seed: int = 0, label: str = "y") -> DataFrame:
    """Both classes cut to the size of the smaller one."""
    n = F.least("n_failed", "n_healthy")
    return take(df, by, keys, seed, n, n, label)


def balanced(df: DataFrame, by: list[str], keys: list[str], ratio: float = 1.0, seed: int = 0, label: str = "y") -> DataFrame:
    """``ratio`` healthy per failed; when healthy rows are too few all are kept and failed ones are cut."""
    target = F.greatest(F.lit(1), _half_even(F.col("n_failed") * F.lit(float(ratio))).cast("long"))
    enough = F.col("n_healthy") >= target
    most = F.greatest(F.lit(1), F.floor(F.col("n_healthy") / F.lit(float(ratio))))
    return take(df, by, keys, seed, F.when(enough, F.col("n_failed")).otherwise(F.least(F.col("n_failed"), most)),
                F.when(enough, target).otherwise(F.col("n_healthy")), label)


def failed_only(df: DataFrame, by: list[str], keys: list[str], n: int, seed: int = 0, label: str = "y") -> DataFrame:
    return take(df, by, keys, seed, F.least(F.col("n_failed"), F.lit(n)), F.lit(0), label)


def half_and_half(df: DataFrame, by: list[str], keys: list[str], n: int, seed: int = 42, label: str = "y") -> DataFrame:
    """At most ``n`` rows per group, half of them failed as long as there are enough."""
    total = F.least(F.lit(n), F.col("n_failed") + F.col("n_healthy"))
    failed = F.least(F.col("n_failed"), F.floor(total / 2))
    return take(df, by, keys, seed, failed, F.least(F.col("n_healthy"), total - failed), label)


def capped(df: DataFrame, by: list[str], keys: list[str], cap: int, seed: int = 42) -> DataFrame:
    """A uniform sample of at most ``cap`` rows per group."""
    return hash_rank(df, by, keys, seed, "_rank", F.lit(cap)).drop("_rank")


def sampled_index(windows: DataFrame, by: list[str], keys: list[str], ratio: float = HEALTHY_PER_FAILED,
                  seed: int = SAMPLE_SEED) -> DataFrame:
    """The evaluation index: sampled windows with their group and shuffled 1-based rank."""
    chosen = by_ratio(windows, by, keys, ratio, seed)
    ranked = hash_rank(chosen, by, keys, seed + 1, "sample_rank")
    return ranked.select(*by, *keys, F.col("y").alias("true_status"),
                         F.when(F.col("y") == 1, "failed").otherwise("healthy").alias("selected_group"), "sample_rank",
                         F.lit(float(ratio)).alias("healthy_per_failed"), F.lit(seed).alias("seed"))


def sampling_summary(windows: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    raw = class_counts(windows, by).withColumnsRenamed({"n_failed": "raw_failed", "n_healthy": "raw_healthy"})
    picked = class_counts(index, [*by, "healthy_per_failed", "seed"], "true_status").withColumnsRenamed(
        {"n_failed": "selected_failed", "n_healthy": "selected_healthy"})
    return raw.join(picked, by).withColumns({
        "selected_total": F.col("selected_failed") + F.col("selected_healthy"),
        "selected_healthy_to_failed_ratio": safe_div(F.col("selected_healthy"), F.col("selected_failed")),
    })


def select_for_evaluation(windows: DataFrame, by: list[str], keys: list[str], mode: str = "ratio",
                          index: DataFrame | None = None, ratio: float = HEALTHY_PER_FAILED, seed: int = SAMPLE_SEED,
                          max_failed: int | None = None) -> DataFrame:
    """``all`` windows, those of a ``fixed`` index, or a ``ratio`` sample."""
    if mode == "all":
        return windows
    if mode == "fixed":
        if index is None:
            raise ValueError("a fixed selection needs an index")
        return windows.join(index.select(*by, *keys).distinct(), [*by, *keys], "left_semi")
    if mode == "ratio":
        return by_ratio(windows, by, keys, ratio, seed, max_failed)
    raise ValueError(f"unknown mode {mode}")
