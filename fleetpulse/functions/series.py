"""Functions over one series held as ARRAY<DOUBLE> (a window or a patch of it)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from fleetpulse.functions.scalars import let


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def std_pop(xs: Column) -> Column:
    return let(mean(xs), lambda m: F.sqrt(mean(F.transform(xs, lambda x: (x - m) * (x - m)))))


def first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def last(xs: Column) -> Column:
    return F.get(xs, F.size(xs) - 1)


def diffs(xs: Column) -> Column:
    """Consecutive differences; empty for fewer than two values."""
    n = F.greatest(F.size(xs) - 1, F.lit(0))
    return F.zip_with(F.slice(xs, F.lit(2), n), F.slice(xs, F.lit(1), n), lambda b, a: b - a)


def arg_first(xs: Column, value: Column) -> Column:
    """0-based position of the first element equal to ``value``."""
    return (F.array_position(xs, value) - 1).cast("int")


def by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, values by position and row) of the lists of each length; lists that are empty, null or hold a null are left out."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()  # without what a null list may hold
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    starts, whole = np.cumsum(lengths) - lengths, lengths > 0
    whole[np.repeat(np.arange(len(lists)), lengths)[~known]] = False
    for length in np.unique(lengths[whole]).tolist():
        rows = np.flatnonzero(whole & (lengths == length))
        yield rows, values[starts[rows] + np.arange(length)[:, None]]


def _mean(x: np.ndarray) -> np.ndarray:
    """Means by row; values are added up in the order of a list."""
    total = np.zeros(x.shape[1])
    for v in x:
        total = total + v
    return total / len(x)


def _std(x: np.ndarray) -> np.ndarray:
    gap = x - _mean(x)
    return np.sqrt(_mean(gap * gap))


STATS = ["level_mean", "level_std", "delta", "amp", "max_step", "mean_abs_step", "step_std", "pos_max_step"]


def _with_holes(x: list | None) -> list[float | None]:
    """The statistics of a series that is empty, null or holds nulls: sums over a null are null, extremes pass it over, and the first four are 0 then."""
    x, rank = x or [], lambda v: (math.isnan(v), v)  # a NaN counts as greater than any number
    known, steps = [v for v in x if v is not None], [None if a is None or b is None else abs(b - a) for a, b in zip(x, x[1:])]
    delta = x[-1] - x[0] if x and x[0] is not None and x[-1] is not None else 0.0
    amp = max(known, key=rank) - min(known, key=rank) if known else 0.0
    if not steps:
        return [known[0] if known else 0.0, 0.0 if not known or math.isfinite(known[0]) else math.nan, delta, amp, 0.0, 0.0, 0.0, 0.0]
    found = [v for v in steps if v is not None]
    top = max(found, key=rank) if found else None
    at = None if top is None else next(k for k, v in enumerate(steps) if v is not None and rank(v) == rank(top) or v is not None and math.isnan(v) and math.isnan(top))
    return [0.0, 0.0, delta, amp, top, None, None, None if at is None else at / len(steps)]


def series_stats(xs: Column) -> Column:
    """Length, level, spread and step statistics of a series, all 0 when it is empty; taken from the lists of a batch, position by position."""
    @F.arrow_udf("L int, " + ", ".join(f"{c} double" for c in STATS))
    def stats(lists: pa.Array) -> pa.Array:
        n, ends = len(lists), lists.value_lengths().cast(pa.int32())
        out, left, missing = np.zeros((len(STATS), n)), np.ones(n, bool), np.zeros((len(STATS), n), bool)
        with np.errstate(invalid="ignore", over="ignore"):
            for rows, x in by_length(lists):
                left[rows] = False
                found = [_mean(x), _std(x), x[-1] - x[0], x.max(axis=0) - np.fmin.reduce(x, axis=0)]
                if len(x) > 1:
                    d = x[1:] - x[:-1]
                    steps = np.abs(d)
                    found += [steps.max(axis=0), _mean(steps), _std(d), steps.argmax(axis=0) / (len(x) - 1)]
                out[: len(found), rows] = found
        for row in np.flatnonzero(left).tolist():
            own = _with_holes(lists[row].as_py())
            missing[:, row] = [v is None for v in own]
            out[:, row] = [0.0 if v is None else v for v in own]
        return pa.StructArray.from_arrays([ends, *(pa.array(v, mask=m) for v, m in zip(out, missing))], names=["L", *STATS])

    return stats(xs)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the second and fourth powers of the distances from the mean, updated value by value as the engine's aggregates are."""
    avg, m2, m3, m4 = (np.zeros(x.shape[1]) for _ in range(4))
    for k, v in enumerate(x):
        delta = v - avg
        part = delta / (k + 1.0)
        avg = avg + part
        m2 = m2 + delta * (delta - part)
        delta2, part2 = delta * delta, part * part
        m3 = m3 - 3.0 * part * m2 + delta * (delta2 - part2)
        m4 = m4 - 4.0 * part * m3 - 6.0 * part2 * m2 + delta * (delta * delta2 - part * part2)
    return m2, m4


def sequence_parts(xs: Column, size: int, segments: int) -> Column:
    """Variation, kurtosis and slope of ``segments`` equal parts of a window of ``size`` values, non-finite ones as 0; null for a list of another length."""
    bounds = [(g * size // segments, (g + 1) * size // segments) for g in range(segments)]
    bounds = [(start, end) for start, end in bounds if end > start]
    width = 3 * len(bounds)

    @F.arrow_udf("array<double>")
    def parts(lists: pa.Array) -> pa.Array:
        fine = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size
        flat = lists.filter(pa.array(fine)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is a NaN
        x = np.ascontiguousarray(np.where(np.isfinite(flat), flat, 0.0).reshape(-1, size).T)
        found = []
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for start, end in bounds:
                part = x[start:end]
                m, (m2, m4) = _mean(part), _moments(part)
                v = m2 / len(part)
                found += [np.where(~(np.abs(m) <= 1e-8), np.sqrt(v) / m, 0.0), np.where(~(v <= 1e-8), len(part) * m4 / (m2 * m2) - 3.0, 0.0),
                          (part[-1] - part[0]) / max(end - start - 1, 1)]
        values = np.stack(found, axis=1).ravel() if found else np.zeros(0)
        ends = np.concatenate([[0], np.cumsum(fine * width)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~fine))

    return parts(xs)


def span_stats(xs: Column) -> Column:
    """min, max, mean, first, last, delta of a span of raw values."""
    return F.struct(
        F.array_min(xs).alias("min"), F.array_max(xs).alias("max"), mean(xs).alias("mean"),
        first(xs).alias("first"), last(xs).alias("last"), (last(xs) - first(xs)).alias("delta"),
    )


def edge_means(xs: Column) -> Column:
    """Mean of the first and of the last ``max(1, T // 3)`` values."""
    cut = F.greatest(F.lit(1), F.floor(F.size(xs) / 3).cast("int"))
    return F.struct(
        mean(F.slice(xs, F.lit(1), cut)).alias("early"),
        mean(F.slice(xs, F.size(xs) - cut + 1, cut)).alias("late"),
    )


def patches(xs: Column, length: int) -> Column:
    """Non-overlapping patches; a tail shorter than ``length`` is dropped."""
    def cut(x: Column) -> Column:
        count = F.floor(F.size(x) / length).cast("int")
        made = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(x, i * length + 1, F.lit(length)))
        return F.when(count > 0, made).otherwise(F.slice(made, F.lit(1), F.lit(0)))

    return let(xs, cut)


def all_patches(xs: Column, length: int) -> Column:
    """Every patch at stride 1 with its position."""
    def cut(x: Column) -> Column:
        top = F.size(x) - length
        made = F.transform(F.sequence(F.lit(0), F.greatest(top, F.lit(0))),
                           lambda i: F.struct(i.alias("pos"), F.slice(x, i + 1, F.lit(length)).alias("patch")))
        return F.when(top >= 0, made).otherwise(F.slice(made, F.lit(1), F.lit(0)))

    return let(xs, cut)


def cross_patches(columns: list[Column], length: int) -> Column:
    """Patches over all attributes at once: the attributes' slices one after the other."""
    pieces = [patches(c, length) for c in columns]
    return F.transform(F.arrays_zip(*[p.alias(f"a{i}") for i, p in enumerate(pieces)]),
                       lambda z: F.concat(*[z[f"a{i}"] for i in range(len(pieces))]))


def segment(xs: Column, index: int, segments: int) -> Column:
    """Part ``index`` of ``segments`` equal parts, bounds ``g * T // G``."""
    size = F.size(xs)
    start = F.floor(F.lit(index) * size / segments).cast("int")
    end = F.floor(F.lit(index + 1) * size / segments).cast("int")
    return F.slice(xs, start + 1, end - start)


def segment_features(xs: Column) -> Column:
    """Coefficient of variation, excess kurtosis and slope; near-zero mean or variance gives 0.

    Taken from the lists of a batch, position by position, so sums are added up in the order of a list.
    """
    @F.arrow_udf("cv double, kurtosis double, slope double")
    def features(lists: pa.Array) -> pa.Array:
        n = len(lists)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()  # without what a null list may hold
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        full = lengths > 0
        full[np.repeat(np.arange(n), lengths)[~known]] = False  # a sum over a null is null
        rows = np.flatnonzero(full)

        def mean_of(x: np.ndarray) -> np.ndarray:
            total = np.zeros(n)
            for i in range(int(lengths[rows].max(initial=0))):
                own = rows[lengths[rows] > i]
                total[own] += x[starts[own] + i]
            return total / np.maximum(lengths, 1)

        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            m = mean_of(values)
            gap = values - np.repeat(m, lengths)
            m2, m4 = mean_of(gap * gap), mean_of(gap * gap * gap * gap)
            # a NaN counts as greater than any number
            cv = np.where(full & ~(np.abs(m) <= 1e-8), np.sqrt(m2) / m, 0.0)
            kurtosis = np.where(full & ~(m2 <= 1e-8), m4 / (m2 * m2) - 3.0, 0.0)
            slope, ends = np.zeros(n), lengths > 0
            head, tail = starts[ends], (starts + lengths - 1)[ends]
            slope[ends] = (values[tail] - values[head]) / np.maximum(lengths[ends] - 1, 1)
        ends[ends] = known[head] & known[tail]
        columns = [pa.array(cv), pa.array(kurtosis), pa.array(slope, mask=~ends)]
        return pa.StructArray.from_arrays(columns, names=["cv", "kurtosis", "slope"])

    return features(xs)


def history_and_horizon(xs: Column, time_in: int = 20, time_out: int = 10) -> Column:
    return F.struct(F.slice(xs, 1, time_in).alias("history"), F.slice(xs, time_in + 1, time_out).alias("horizon"))


def flatten_day_major(columns: list[Column]) -> Column:
    """``[T, F]`` flattened day by day, non-finite values as 0."""
    from fleetpulse.functions.scalars import finite_or_zero

    zipped = F.arrays_zip(*[c.alias(f"a{i}") for i, c in enumerate(columns)])
    return F.flatten(F.transform(zipped, lambda z: F.array(*[finite_or_zero(z[f"a{i}"]) for i in range(len(columns))])))


def checked_window(xs: Column, patch_days: int, patch_count: int) -> Column:
    """The window, or null when it is not exactly ``patch_days * patch_count`` long."""
    return F.when(F.size(xs) == patch_days * patch_count, xs)


def histogram_shares(xs: Column, low: Column, high: Column, bins: int) -> Column:
    """Share of finite values per equal bin of [low, high].

    Below the first edge a value is ignored, above the last one it goes to the last bin.
    """
    @F.arrow_udf("array<double>")
    def shares(lists: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        n = len(lists)
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is a NaN
        row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        row, flat = row[np.isfinite(flat)], flat[np.isfinite(flat)]
        total = np.maximum(np.bincount(row, minlength=n), 1)
        low, high = (e.cast(pa.float64()).to_numpy(zero_copy_only=False) for e in (lows, highs))
        counted = (flat >= low[row]) & ~np.isnan(high[row])
        row, flat = row[counted], flat[counted]
        if (high[row] == low[row]).any():
            raise ValueError("a range of values is empty")
        at = np.minimum(np.floor((flat - low[row]) / (high[row] - low[row]) * bins), bins - 1).astype(np.int64)
        counts = np.bincount(row * bins + at, minlength=n * bins)
        values = pa.array((counts.reshape(n, bins) / total[:, None]).ravel(), mask=np.repeat(lists.is_null().to_numpy(zero_copy_only=False), bins))
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(bins), values)

    return shares(xs, low, high)
