"""Ordered rules that name the shape of a series and of a set of series. First match wins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from fleetpulse.functions.scalars import label_role, let
from fleetpulse.functions.series import arg_first, diffs, edge_means, first, last, mean


def series_label(series: Column) -> Column:
    """Shape label of a (mean) patch."""
    return let(series, _series_label)


def series_labels(series: Column) -> Column:
    """The same label for a column of many rows: a batch's series of one length are compared as a matrix.

    A series with a hole is left to the column expression.
    """
    @F.arrow_udf("string")
    def labels(lists: pa.Array) -> pa.Array:
        out = np.full(len(lists), None, object)
        lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        for size in np.unique(lengths[lengths >= 0]):
            at = np.flatnonzero(lengths == size)
            values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
            out[at] = shape_labels(values)
        return pa.array(out, pa.string())

    whole = ~F.exists(series, lambda x: x.isNull() | F.isnan(x))
    return F.when(whole, labels(F.when(whole, series))).otherwise(series_label(series))


def _added(columns: np.ndarray) -> np.ndarray:
    """Sums of the rows, added from left to right."""
    total = np.zeros(len(columns))
    for i in range(columns.shape[1]):
        total += columns[:, i]
    return total


def shape_labels(x: np.ndarray) -> np.ndarray:
    """Labels of the rows of a matrix, by the rules of ``_series_label`` and ``_shape_rules``."""
    rows, size = x.shape
    if size == 0:
        return np.full(rows, "UNUSED_PROTO", object)
    max_abs, amp = np.abs(x).max(axis=1), np.abs(x - x[:, :1]).max(axis=1)
    small, level = max_abs < 1e-6, np.where(max_abs < 1.0, "ZERO_OR_NEAR_ZERO", "LOW_STABLE")
    if size == 1:
        return np.where(small, "ZERO_OR_NEAR_ZERO", "LOW_STABLE").astype(object)
    with np.errstate(over="ignore", invalid="ignore"):
        n = (x - x[:, :1]) / (amp + 1e-12)[:, None]
    d = n[:, 1:] - n[:, :-1]
    mid, high_enough = size // 2, np.abs(n) >= 0.7
    noise, trend, max_step = _added(np.abs(d)) / (size - 1), n[:, -1] - n[:, 0], np.abs(d).max(axis=1)
    first_half, second_half = n[:, mid - 1] - n[:, 0], n[:, -1] - n[:, mid]
    spikes = high_enough.sum(axis=1)
    spike_at = (high_enough * np.arange(size)).sum(axis=1) / np.maximum(spikes, 1) / (size - 1)
    low, high, low_at, high_at = n.min(axis=1), n.max(axis=1), n.argmin(axis=1), n.argmax(axis=1)
    quiet, bursty, plateau = noise < 0.25, (spikes > 0) & (amp >= 0.05), np.abs(second_half) < 0.1
    few, jump = (spikes <= max(2, size // 3)) & quiet, (max_step > 0.8) & (noise < 0.4)
    deep, flat = (low < -0.3) & (high > 0.3), (amp < 0.05) & (noise < 0.06)
    rises, falls = (d.min(axis=1) >= -0.05) & (trend > 0.3) & quiet, (d.max(axis=1) <= 0.05) & (trend < -0.3) & quiet
    cases = [
        (small, "ZERO_OR_NEAR_ZERO"), ((amp < 1e-12) | flat, level),
        (rises & (trend > 0.7), "FAST_RISE"), (rises, "SLOW_RISE"), (falls & (trend < -0.7), "FAST_DECAY"), (falls, "SLOW_DECAY"),
        ((first_half > 0.3) & plateau, "SATURATING_RISE"), ((first_half < -0.3) & plateau, "SATURATING_DECAY"),
        (jump & (trend > 0.2), "STEP_UP"), (jump & (trend < -0.2), "STEP_DOWN"),
        (bursty & few & (spike_at >= 2.0 / 3.0), "SINGLE_SPIKE_LATE"), (bursty & few & (spike_at <= 1.0 / 3.0), "SINGLE_SPIKE_EARLY"),
        (bursty & few, "SINGLE_SPIKE_MID"), (bursty & (spikes / size < 0.3), "LOW_RATE_BURSTS"), (bursty, "HIGH_RATE_BURSTS"),
        ((low_at < high_at) & (low_at > 0) & (high_at < size - 1) & deep, "U_SHAPED"),
        ((high_at < low_at) & (high_at > 0) & (low_at < size - 1) & deep, "HUMP_SHAPED"),
        ((np.abs(trend) > 0.2) & (noise >= 0.06), "DRIFT_WITH_NOISE")]
    return np.select([c for c, _ in cases], [v for _, v in cases], "NOISY_FLUCTUATIONS").astype(object)


def _series_label(xs: Column) -> Column:
    def shaped(amp: Column, max_abs: Column) -> Column:
        norm = F.transform(xs, lambda x: (x - first(xs)) / (amp + F.lit(1e-12)))
        return let(norm, lambda n: let(diffs(n), lambda d: _shape_rules(xs, n, d, amp, max_abs)))

    small = F.lit("ZERO_OR_NEAR_ZERO")

    def body(v: Column) -> Column:
        level = F.when(v["max_abs"] < 1.0, small).otherwise("LOW_STABLE")
        return (
            F.when(F.size(xs) == 0, "UNUSED_PROTO")
            .when(v["max_abs"] < 1e-6, small)
            .when(F.size(xs) == 1, "LOW_STABLE")
            .when(v["amp"] < 1e-12, level)
            .otherwise(shaped(v["amp"], v["max_abs"]))
        )

    return let(F.struct(
        F.array_max(F.transform(xs, F.abs)).alias("max_abs"),
        F.array_max(F.transform(xs, lambda x: F.abs(x - first(xs)))).alias("amp"),
    ), body)


def _shape_rules(xs: Column, norm: Column, d: Column, amp: Column, max_abs: Column) -> Column:
    size = F.size(xs)
    mid = F.floor(size / 2).cast("int")
    spikes = F.filter(F.transform(norm, lambda x, i: F.when(F.abs(x) >= 0.7, i)), lambda i: i.isNotNull())
    terms = F.struct(
        mean(F.transform(d, F.abs)).alias("noise"),
        (last(norm) - first(norm)).alias("trend"),
        F.array_max(F.transform(d, F.abs)).alias("max_step"),
        F.array_min(d).alias("lowest"), F.array_max(d).alias("highest"),
        (F.get(norm, mid - 1) - first(norm)).alias("first_half"),
        (last(norm) - F.get(norm, mid)).alias("second_half"),
        F.size(spikes).alias("spikes"),
        F.coalesce(mean(spikes.cast("array<double>")) / (size - 1), F.lit(0.0)).alias("spike_at"),
        F.array_min(norm).alias("low"), F.array_max(norm).alias("high"),
        arg_first(norm, F.array_min(norm)).alias("low_at"), arg_first(norm, F.array_max(norm)).alias("high_at"),
    )

    def rules(t: Column) -> Column:
        quiet = t["noise"] < 0.25
        bursty = (t["spikes"] > 0) & (amp >= 0.05)
        few = (t["spikes"] <= F.greatest(F.lit(2), F.floor(size / 3).cast("int"))) & quiet
        jump = (t["max_step"] > 0.8) & (t["noise"] < 0.4)
        deep = (t["low"] < -0.3) & (t["high"] > 0.3)
        flat = (amp < 0.05) & (t["noise"] < 0.06)
        plateau = F.abs(t["second_half"]) < 0.1
        return (
            F.when(flat & (max_abs < 1.0), "ZERO_OR_NEAR_ZERO")
            .when(flat, "LOW_STABLE")
            .when((t["lowest"] >= -0.05) & (t["trend"] > 0.3) & quiet,
                  F.when(t["trend"] > 0.7, "FAST_RISE").otherwise("SLOW_RISE"))
            .when((t["highest"] <= 0.05) & (t["trend"] < -0.3) & quiet,
                  F.when(t["trend"] < -0.7, "FAST_DECAY").otherwise("SLOW_DECAY"))
            .when((t["first_half"] > 0.3) & plateau, "SATURATING_RISE")
            .when((t["first_half"] < -0.3) & plateau, "SATURATING_DECAY")
            .when(jump & (t["trend"] > 0.2), "STEP_UP")
            .when(jump & (t["trend"] < -0.2), "STEP_DOWN")
            .when(bursty & few, F.when(t["spike_at"] >= 2.0 / 3.0, "SINGLE_SPIKE_LATE")
                  .when(t["spike_at"] <= 1.0 / 3.0, "SINGLE_SPIKE_EARLY").otherwise("SINGLE_SPIKE_MID"))
            .when(bursty, F.when(t["spikes"] / size < 0.3, "LOW_RATE_BURSTS").otherwise("HIGH_RATE_BURSTS"))
            .when((t["low_at"] < t["high_at"]) & (t["low_at"] > 0) & (t["high_at"] < size - 1) & deep, "U_SHAPED")
            .when((t["high_at"] < t["low_at"]) & (t["high_at"] > 0) & (t["low_at"] < size - 1) & deep, "HUMP_SHAPED")
            .when((F.abs(t["trend"]) > 0.2) & (t["noise"] >= 0.06), "DRIFT_WITH_NOISE")
            .otherwise("NOISY_FLUCTUATIONS")
        )

    return let(terms, rules)


def cross_label(labels: Column, groups: list[str]) -> Column:
    """Label of a cross-attribute pattern from its attributes' labels and (fixed) groups."""
    members = F.arrays_zip(F.transform(labels, label_role).alias("role"),
                           F.array(*[F.lit(g) for g in groups]).alias("grp"))

    def build(m: Column) -> Column:
        def share(role: str, group: str | None = None) -> Column:
            n = len(groups) if group is None else groups.count(group)
            if n == 0:
                return F.lit(0.0)
            hit = F.filter(m, lambda z: (z["role"] == role) & (F.lit(True) if group is None else z["grp"] == group))
            return F.size(hit) / F.lit(float(n))

        terms = F.struct(
            share("stable").alias("stable"), share("spiky").alias("spiky"), share("trend").alias("trend"),
            (share("spiky", "workload") + share("trend", "workload")).alias("load"),
            (share("spiky", "error") + share("trend", "error")).alias("errors"),
            share("spiky", "error").alias("error_spiky"), share("trend", "wear").alias("wear_trend"),
        )

        def rules(t: Column) -> Column:
            has = {g: F.lit(g in groups) for g in ("error", "wear", "workload")}
            return (
                F.when(F.size(labels) == 0, "UNUSED_PROTO")
                .when((t["stable"] > 0.8) & (t["spiky"] < 0.1) & (t["trend"] < 0.1), "ALL_STABLE")
                .when(has["workload"] & has["error"] & (t["load"] >= 0.3) & (t["errors"] < 0.1), "WORKLOAD_SPIKE_NO_ERRORS")
                .when(has["wear"] & (t["wear_trend"] >= 0.3),
                      F.when(t["errors"] < 0.1, "WEAROUT_NO_ERRORS").otherwise("WEAROUT_WITH_ERRORS"))
                .when(has["error"] & (t["error_spiky"] >= 0.4), "ERROR_BURST_WIDESPREAD")
                .when(has["error"] & (t["error_spiky"] >= 0.1), "ERROR_BURST_ISOLATED")
                .when(F.array_contains(labels, "STEP_DOWN"), "RESET_OR_WRAP")
                .when((t["spiky"] < 0.1) & (t["trend"] >= 0.2), "MULTI_ATTR_TRENDS")
                .when((t["spiky"] >= 0.4) & (t["stable"] > 0.3), "MULTI_ERROR_BURSTS")
                .when((t["spiky"] >= 0.2) & (t["stable"] > 0.5), "FEW_ERROR_BURSTS")
                .when((t["trend"] >= 0.2) & (t["spiky"] >= 0.2), "TREND_PLUS_BURSTS")
                .otherwise("MIXED_PATTERN")
            )

        return let(terms, rules)

    return let(members, build)


def window_phrase(xs: Column) -> Column:
    """One heuristic phrase for a whole window of one attribute."""
    terms = F.struct(
        F.size(xs).alias("days"), F.array_max(xs).alias("high"), F.array_min(xs).alias("low"), mean(xs).alias("mean"),
        first(xs).alias("first"), last(xs).alias("last"), F.size(F.filter(xs, lambda x: x > 0)).alias("pos"),
        edge_means(xs)["early"].alias("early"), edge_means(xs)["late"].alias("late"),
        arg_first(xs, F.array_max(xs)).alias("top_at"),
    )
    return let(terms, phrase_rules)


def phrase_rules(t) -> Column:
    """The phrase from a window's terms: days, high, low, mean, first, last, pos, early, late, top_at."""
    spread, delta = t["high"] - t["low"], t["last"] - t["first"]
    scale = F.greatest(F.abs(t["mean"]), F.abs(t["high"]), F.lit(1.0))
    days, third = t["days"].cast("string"), F.greatest(F.lit(1), F.floor(t["days"] / 3).cast("int")).cast("string")
    silent, wide = t["pos"] == 0, spread > 0.5 * scale
    return (
        F.when((spread < 1e-3) & silent, F.concat(F.lit("mostly zero across "), days, F.lit(" days")))
        .when((spread < 0.01 * scale) & silent, F.concat(F.lit("exactly zero across "), days, F.lit(" days")))
        .when(spread < 0.01 * scale, "roughly constant at a small nonzero value")
        .when((delta > 0.2 * scale) & (t["late"] > t["early"] * 1.5),
              F.when(wide, "steady increase with strong late growth").otherwise("steady increase over the window"))
        .when((delta < -0.2 * scale) & (t["early"] > t["late"] * 1.5), "monotonic decrease across the window")
        .when(wide & (F.abs(delta) < 0.2 * spread),
              F.when(t["top_at"] >= t["days"] * 2 / 3, F.concat(F.lit("sharp late spike in the last "), third, F.lit(" days")))
              .when(t["top_at"] <= t["days"] / 3, F.concat(F.lit("sharp early spike in the first "), third, F.lit(" days")))
              .otherwise("sharp spikes in the middle of the window"))
        .when(silent, "mostly zero with harmless fluctuations")
        .otherwise("low but noisy with occasional small spikes")
    )
