"""Daily rows -> imputed series -> labelled, split row windows.

A device reports at most one row per calendar day, so a device's series is bounded by the days
covered, however many raw readings it has: the frames below share one exchange and one sort on
(model, disk_id, day). For series without that bound use ``operators.long_series``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from fleetpulse.fixed_values import HORIZON_DAYS, WINDOW_DAYS
from fleetpulse.functions.scalars import days_to_failure, finite_or_null, month_start, parse_failure_time
from fleetpulse.operators.ranking import exact_quantiles

KEYS = ["model", "disk_id"]


def by_device(order: str = "day") -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(order)


def forward_fill(c: str) -> Column:
    return F.last(c, ignorenulls=True).over(by_device().rowsBetween(Window.unboundedPreceding, 0))


def first_known(c: str) -> Column:
    """Fills the head of a series: rows without an earlier value take the first known one.

    The whole-partition frame is evaluated once per device; a frame from the current row to the
    end would be evaluated again for every row.
    """
    return F.first(c, ignorenulls=True).over(
        by_device().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def one_row_per_day(df: DataFrame, features: list[str]) -> DataFrame:
    """(model, disk_id, day, features): of several reports of a day the largest known value of each feature counts."""
    return df.groupBy(*KEYS, "day").agg(*[F.max(c).alias(c) for c in features])


def fill_within_device(df: DataFrame, features: list[str]) -> DataFrame:
    clean = df.withColumns({c: finite_or_null(F.col(c)) for c in features})
    return clean.withColumns({c: F.coalesce(forward_fill(c), first_known(c)) for c in features})


def unpivot_features(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in features], "attr", "value")


def feature_medians(df: DataFrame, features: list[str], train_until: Column | None = None) -> DataFrame:
    """One row per model with each feature's exact median, 0 when a feature has no value.

    ``train_until`` restricts the rows, to keep later months out of the fallback.
    """
    rows = df if train_until is None else df.filter(train_until)
    medians = exact_quantiles(unpivot_features(rows, ["model"], features), ["model", "attr"], "value", [0.5])
    return medians.groupBy("model").agg(*[
        F.coalesce(F.max(F.when(F.col("attr") == c, F.col("quantile"))), F.lit(0.0)).alias(f"median_{c}") for c in features])


def impute(df: DataFrame, features: list[str], train_until: Column | None = None) -> DataFrame:
    """Forward fill, head fill, then the model's median for devices that never report a feature."""
    filled = fill_within_device(df, features)
    medians = feature_medians(filled, features, train_until)
    # one row per device model, a short list by nature of the fleet
    joined = filled.join(F.broadcast(medians), "model", "left")
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"median_{c}"), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in df.columns])


def null_rates(df: DataFrame, features: list[str]) -> DataFrame:
    return df.groupBy("model").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])


def earliest_failures(tags: DataFrame) -> DataFrame:
    """First readable failure day per device."""
    return (
        tags.select(*KEYS, parse_failure_time(F.col("failure_time")).alias("failure_day"))
        .groupBy(*KEYS).agg(F.min("failure_day").alias("failure_day"))
    )


def month_index(df: DataFrame) -> DataFrame:
    """Dense 1-based index of the months present, per model: (model, month, month_idx)."""
    months = df.select("model", month_start(F.col("day")).alias("month")).distinct()
    return months.withColumn("month_idx", F.dense_rank().over(Window.partitionBy("model").orderBy("month")))


@dataclass(frozen=True)
class SplitRule:
    """Round r tests on the last ``test`` months that end r-1 months before ``last_month``."""

    last_month: int = 24
    val: int = 1
    test: int = 1
    rounds: tuple[int, ...] = (1, 2, 3)

    def split(self, idx: Column, round_id: int) -> Column:
        end = self.last_month - (round_id - 1)
        test_from = end - self.test + 1
        val_from = test_from - self.val
        return (
            F.when((idx >= test_from) & (idx <= end), "test")
            .when((idx >= val_from) & (idx < test_from), "val")
            .when((idx >= 1) & (idx < val_from), "train")
        )


def label(ttf: Column, horizon: int = HORIZON_DAYS) -> Column:
    return F.when(ttf.between(0, horizon), 1).otherwise(0)


def row_windows(df: DataFrame, features: list[str], size: int = WINDOW_DAYS, keep_arrays: bool = True) -> DataFrame:
    """One row per window of the last ``size`` rows of a device (day gaps are not filled)."""
    cols = {"_row": F.row_number().over(by_device())}
    if keep_arrays:
        frame = by_device().rowsBetween(-(size - 1), 0)
        cols.update({c: F.collect_list(c).over(frame) for c in features})
    return df.withColumns(cols).filter(F.col("_row") >= size).drop("_row").withColumnRenamed("day", "end_day")


def with_failures(df: DataFrame, failures: DataFrame, day: str = "end_day") -> DataFrame:
    """Adds ``ttf``; no hint, so the join follows the size of the failure table at run time."""
    joined = df.join(failures, KEYS, "left")
    return joined.withColumn("ttf", days_to_failure(F.col(day), F.col("failure_day"))).drop("failure_day")


def label_windows(windows: DataFrame, failures: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Adds ttf and y and drops windows that end after the failure."""
    joined = with_failures(windows, failures)
    kept = joined.filter("ttf is null or ttf >= 0")
    return kept.withColumn("y", label(F.col("ttf"), horizon))


def split_windows(windows: DataFrame, months: DataFrame, rule: SplitRule, rounds: tuple[int, ...] | None = None) -> DataFrame:
    """Adds round and split: one row per round a window belongs to."""
    # calendar months per model: bounded by the calendar, not by the number of rows
    joined = windows.withColumn("month", month_start(F.col("end_day"))).join(F.broadcast(months), ["model", "month"])
    places = F.array(*[F.struct(F.lit(r).alias("round"), rule.split(F.col("month_idx"), r).alias("split"))
                       for r in (rounds or rule.rounds)])
    placed = joined.withColumn("_p", F.explode(F.filter(places, lambda p: p["split"].isNotNull())))
    return placed.select("*", "_p.round", "_p.split").drop("_p", "month")


def rows_of_split(rows: DataFrame, months: DataFrame, rule: SplitRule, split: str, round_id: int = 1, size: int = WINDOW_DAYS) -> DataFrame:
    """The rows that windows ending in the months of a split hold: those of the months and the ``size`` - 1 before them.

    A window of the split is whole in what is returned, so its frames need not be computed for the rows of other splits.
    """
    placed = rows.withColumn("month", month_start(F.col("day"))).join(F.broadcast(months), ["model", "month"], "left")
    ends = F.coalesce(rule.split(F.col("month_idx"), round_id) == split, F.lit(False))
    held = placed.withColumn("_held", F.bool_or(ends).over(by_device().rowsBetween(0, size - 1)))
    return held.filter("_held").select(*rows.columns)


def mark_windows(rows: DataFrame, tags: DataFrame, rule: SplitRule, round_id: int = 1, size: int = WINDOW_DAYS,
                 horizon: int = HORIZON_DAYS) -> DataFrame:
    """Daily rows with ttf, y and split of the window that ends there; split is null where none counts.

    Keeps every row, so that patches and scalers can be computed once per day instead of per window.
    """
    full = F.row_number().over(by_device()) >= size
    counted = rows.withColumns({"_full": full, "month": month_start(F.col("day"))})
    joined = with_failures(counted, earliest_failures(tags), "day").join(F.broadcast(month_index(rows)), ["model", "month"])
    valid = F.col("_full") & (F.col("ttf").isNull() | (F.col("ttf") >= 0))
    marked = joined.withColumns({"split": F.when(valid, rule.split(F.col("month_idx"), round_id)),
                                 "y": label(F.col("ttf"), horizon)})
    return marked.drop("_full", "month", "month_idx")


def build_windows(daily: DataFrame, tags: DataFrame, features: list[str], rule: SplitRule, size: int = WINDOW_DAYS,
                  horizon: int = HORIZON_DAYS, keep_arrays: bool = True, rounds: tuple[int, ...] | None = None,
                  imputed: bool = False) -> DataFrame:
    """Daily rows and failure tags to labelled windows of every requested round."""
    # filling gaps changes values, not rows: without arrays there is nothing to fill
    rows = impute(daily, features) if keep_arrays and not imputed else daily
    if not keep_arrays:
        rows = rows.drop(*features)
    windows = row_windows(rows, features, size, keep_arrays)
    labelled = label_windows(windows, earliest_failures(tags), horizon)
    return split_windows(labelled, month_index(daily), rule, rounds)


def count_windows(windows: DataFrame) -> DataFrame:
    return windows.groupBy("model", "round", "split", "y").agg(F.count("*").alias("windows"))


def number_windows(windows: DataFrame, by: list[str]) -> DataFrame:
    """0-based position in (disk_id, end_day) order inside a group, as ``test_index``.

    Positions come from per-device counts and a running total over devices, so no group is sorted whole.
    """
    from fleetpulse.operators.ranking import running_totals

    per_device = windows.groupBy(*by, "disk_id").agg(F.count("*").alias("n"))
    before = running_totals(per_device, by, "disk_id", ["n"]).withColumn("_before", F.col("cum_n") - F.col("n"))
    inside = Window.partitionBy(*by, "disk_id").orderBy("end_day")
    joined = windows.join(before.select(*by, "disk_id", "_before"), [*by, "disk_id"])
    return joined.withColumn("test_index", F.col("_before") + F.row_number().over(inside) - 1).drop("_before")
