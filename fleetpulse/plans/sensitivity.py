"""Sweeps over window and patch lengths: every setting is learned and evaluated, all of them in the same jobs.

A setting's windows, patches and weights are facts of the daily row they end at, so the daily rows are sorted by device once and
carry one entry per setting. The longest patch that ends at a row is kept, and a setting takes its own last days of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from fleetpulse.operators import metrics as M, patterns as PT, scaling as SC
from fleetpulse.operators.grouped import by_group
from fleetpulse.operators.windows import KEYS, SplitRule, by_device, mark_windows
from fleetpulse.session import materialize

BY = ["setting", "model"]


@dataclass(frozen=True)
class Setting:
    """Lengths of one run of the sweep; studies that share them share the run."""

    window_days: int
    patch_len: int

    @property
    def shape(self) -> PT.PatchShape:
        return PT.PatchShape(self.patch_len, self.window_days)


def listed(settings: DataFrame) -> list[Setting]:
    """Settings in order; a study has a handful of them, as each is a run of its own."""
    return [Setting(*r) for r in settings.select("window_days", "patch_len").distinct().orderBy("window_days", "patch_len").collect()]


def _ends(n: Column, y: int, size: int) -> Column:
    """1 where a train window of ``size`` rows and class y ends."""
    return F.when((F.col("split") == "train") & (F.col("y") == y) & (n >= size), 1).otherwise(0)


def settings_rows(imputed: DataFrame, tags: DataFrame, rule: SplitRule, features: list[str], settings: list[Setting], round_id: int = 1) -> DataFrame:
    """Daily rows with ``row`` (number in the device), ``split`` and ``y`` of a window that ends there, whatever its length, the
    last days as ``raw_<attr>``, and per window length ``cover_<N>``, per setting ``h_<i>`` and ``f_<i>``: train windows
    of either class that hold the patch ending here.

    Windows are counted by differences of running totals, so a long window costs no more than a short one.
    """
    w = by_device()
    sizes, longest = sorted({s.window_days for s in settings}), max(s.patch_len for s in settings)
    rows = mark_windows(imputed, tags, rule, round_id, 1).withColumn("row", F.row_number().over(w))
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {f"raw_{c}": F.collect_list(c).over(w.rowsBetween(-(longest - 1), 0)) for c in features}
    for n in sizes:
        for y in (0, 1):
            made[f"_e{y}_{n}"] = _ends(F.col("row"), y, n)
        made[f"_t_{n}"] = F.sum(made[f"_e0_{n}"] + made[f"_e1_{n}"]).over(so_far)
        made[f"_a_{n}"] = F.sum(made[f"_e0_{n}"] + made[f"_e1_{n}"]).over(whole)
    rows = rows.withColumns(made)
    covers = {}
    for n in sizes:
        upto = F.coalesce(F.lead(f"_t_{n}", n - 1).over(w), F.col(f"_a_{n}"))
        covers[f"cover_{n}"] = upto - F.col(f"_t_{n}") + F.col(f"_e0_{n}") + F.col(f"_e1_{n}")
    for i, s in enumerate(settings):
        for name, y in (("h", 0), ("f", 1)):
            ahead = [F.coalesce(F.lead(f"_e{y}_{s.window_days}", s.shape.offset(p)).over(w), F.lit(0)) for p in range(s.shape.count)]
            covers[f"{name}_{i}"] = sum(ahead[1:], ahead[0])
    rows = rows.withColumns(covers)
    return rows.drop(*[f"_{k}_{n}" for k in ("e0", "e1", "t", "a") for n in sizes])


def settings_scaler(rows: DataFrame, features: list[str], settings: list[Setting]) -> DataFrame:
    """(setting, model, mean_<attr>, std_<attr>): days count once per train window that holds them; one pass for all lengths."""
    sizes = sorted({s.window_days for s in settings})
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"cover_{n}").alias("cover")) for n in sizes]))
    covered = rows.select("model", *features, cells.alias("c")).select("model", *features, F.col("c.n").alias("size"), F.col("c.cover").alias("cover"))
    by_size = SC.scaler_row(SC.window_scaler(covered, features, ["model", "size"]), features, ["model", "size"])
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(s.window_days).alias("size")) for i, s in enumerate(settings)]))
    every = rows.sparkSession.range(1).select(own.alias("s")).select("s.*")
    return by_size.join(F.broadcast(every), "size").drop("size")


def _numbers(columns: list) -> np.ndarray:
    """Columns of numbers as one matrix; a null is a NaN."""
    return np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)


def _last_days(batch: pa.RecordBatch, features: list[str], longest: int) -> np.ndarray:
    """(row, attribute, day): the last days of each row, the latest at the end; a NaN stands before the first one and for a null."""
    out = np.full((batch.num_rows, len(features), longest), np.nan)
    for k, c in enumerate(features):
        lists = batch.column(f"raw_{c}")
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), lengths)
        back = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(values))
        out[row, k, longest - back] = values
    return out


@dataclass(frozen=True)
class SettingPatches:
    """The patches that end at daily rows, for all settings; they are cut and standardized batch by batch and never stored.

    ``scales`` has the means and deviations of the attributes by setting and model; other models have no patches.
    """

    rows: DataFrame
    features: list[str]
    settings: list[Setting]
    scales: dict[tuple, tuple[np.ndarray, np.ndarray]]

    def columns(self, *kept: str) -> DataFrame:
        """What a batch needs: ``kept`` and the facts of the settings' patches."""
        n = range(len(self.settings))
        return self.rows.select("model", "row", *kept, *[F.col(f"{k}_{i}").cast("long").alias(f"{k}_{i}") for i in n for k in "hf"], *[f"raw_{c}" for c in self.features])

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, object, np.ndarray, np.ndarray]]:
        """(setting, model, row numbers, patches by row, attribute and day)."""
        days = _last_days(batch, self.features, max(s.patch_len for s in self.settings))
        known = batch.column("row").to_numpy(zero_copy_only=False)
        for (model,), own in by_group(batch, ["model"]):
            for i, s in enumerate(self.settings):
                if (i, model) in self.scales:
                    mean, std = self.scales[i, model]
                    at = own[known[own] >= s.patch_len]
                    yield i, model, at, (days[at][:, :, -s.patch_len:] - mean[None, :, None]) / std[None, :, None]

    def in_tasks(self) -> SettingPatches:
        """The same without the table, for use inside a task."""
        return SettingPatches(None, self.features, self.settings, self.scales)

    def table(self) -> DataFrame:
        """(setting, model, disk_id, day, row, split, y, n_healthy, n_failed, zp_<attr>): one row per daily row that ends a patch and setting."""
        facts, own, n = ["disk_id", "day", "split", "y"], self.in_tasks(), len(self.features)
        held = self.columns(*facts)
        schema = T.StructType([T.StructField("setting", T.IntegerType()), held.schema["model"], *[held.schema[c] for c in ("row", *facts)],
                               *[T.StructField(c, T.LongType()) for c in ("n_healthy", "n_failed")], *[T.StructField(f"zp_{c}", T.ArrayType(T.DoubleType())) for c in self.features]])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, _, at, z in own.of(batch):
                    ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(z.shape[2]))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(z[:, k].ravel(), from_pandas=True)) for k in range(n)]
                    taken = [batch.column(c).take(pa.array(at)) for c in ("model", "row", *facts, f"h_{i}", f"f_{i}")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), *taken, *lists], names=schema.fieldNames())

        return held.mapInArrow(cut, schema)


def settings_patches(rows: DataFrame, scaler: DataFrame, features: list[str], settings: list[Setting]) -> SettingPatches:
    """Standardized patches of every setting; the scaler, a row for each setting and model, is collected, and a null in it is a NaN."""
    def listed_of(r, name: str) -> np.ndarray:
        return np.array([np.nan if r[f"{name}_{c}"] is None else r[f"{name}_{c}"] for c in features], np.float64)

    scales = {(r["setting"], r["model"]): (listed_of(r, "mean"), listed_of(r, "std")) for r in scaler.collect() if r["model"] is not None}
    return SettingPatches(rows, features, settings, scales)


def mean_centers(patches: SettingPatches) -> DataFrame:
    """(setting, model, kind, k, center): the mean patch of each attribute, and over all attributes of each class that has train windows.

    Tasks add up their patches position by position; a handful of sums for each setting and model is shuffled.
    """
    held, own = patches.columns(), patches.in_tasks()
    schema = T.StructType([T.StructField("setting", T.IntegerType()), held.schema["model"], T.StructField("kind", T.StringType()),
                           *[T.StructField(c, T.IntegerType()) for c in ("k", "at")], T.StructField("s", T.DoubleType()), T.StructField("w", T.LongType())])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for i, model, at, z in own.of(batch):
                weights = np.nan_to_num(_numbers([batch.column(f"{k}_{i}").take(pa.array(at)) for k in "hf"]))
                used = weights.sum(axis=1) > 0
                z, weights = np.nan_to_num(z[used]).reshape(used.sum(), z.shape[1] * z.shape[2]), weights[used]  # a batch may hold no train patch
                both, counts = weights.T @ z, weights.sum(axis=0)
                single = both.sum(axis=0).reshape(len(own.features), -1)
                for kind, k, x, w in [*(("attr", k, x, counts.sum()) for k, x in enumerate(single)), *(("cross", k, both[k], counts[k]) for k in (0, 1))]:
                    sums[i, model, kind, k] = sums.get((i, model, kind, k), 0.0) + np.append(x, w)
        out = [(*key, at, float(v), int(x[-1])) for key, x in sums.items() for at, v in enumerate(x[:-1])]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=schema.fieldNames())

    total = held.mapInArrow(added, schema).groupBy(*BY, "kind", "k", "at").agg(F.round(F.try_divide(F.sum("s"), F.sum("w")), 6).alias("v"))
    lists = total.filter("v is not null").groupBy(*BY, "kind", "k").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("c"))
    return lists.select(*BY, "kind", "k", F.transform("c", lambda s: s["v"]).alias("center"))


def center_lists(centers: DataFrame) -> DataFrame:
    """(setting, model, kind, ks, centers), centers in order of k."""
    lists = centers.groupBy(*BY, "kind").agg(F.sort_array(F.collect_list(F.struct("k", "center"))).alias("c"))
    return lists.select(*BY, "kind", F.transform("c", lambda s: s["k"]).alias("ks"), F.transform("c", lambda s: s["center"]).alias("centers"))


def distances(patches: SettingPatches, centers: DataFrame) -> DataFrame:
    """The daily rows with ``d_<i>`` for each setting: the distances of the patches that end there from their nearest centers, in the order of the
    attributes and then across them. Null where no patch ends, or the model has no scaler or no centers.
    """
    own, n, width = patches.in_tasks(), len(patches.settings), len(patches.features) + 1
    found = {(r["setting"], r["model"], r["kind"]): np.array(r["centers"], np.float64) for r in center_lists(centers).collect()}  # a handful for each setting and model
    held = patches.columns("disk_id", "day", "split", "y")
    passed = [f for f in held.schema.fields if not f.name.startswith("raw_")]
    schema = T.StructType([*passed, *[T.StructField(f"d_{i}", T.ArrayType(T.DoubleType())) for i in range(n)]])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, ends = np.full((n, batch.num_rows, width), np.nan), np.zeros((n, batch.num_rows), bool)
            for i, model, at, z in own.of(batch):
                attr, cross = (found.get((i, model, kind)) for kind in ("attr", "cross"))
                ends[i, at] = attr is not None or cross is not None
                if attr is not None:
                    for k in range(width - 1):
                        near[i, at, k] = PT.nearest_rows(z[:, k], attr)[0]
                if cross is not None:
                    near[i, at, -1] = PT.nearest_rows(z.reshape(len(z), z.shape[1] * z.shape[2]), cross)[0]
            lists = []
            for i in range(n):
                offsets = pa.array(np.concatenate([[0], np.cumsum(ends[i] * width)]).astype(np.int32))
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(near[i][ends[i]].ravel(), from_pandas=True), mask=pa.array(~ends[i])))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in passed), *lists], names=schema.fieldNames())

    return held.mapInArrow(measured, schema)


def tuned(hits: DataFrame, features: list[str], settings: list[Setting]) -> DataFrame:
    """(setting, model, attr threshold ``at``, cross threshold ``ct``) from the distances of train patches, all groups in one pass."""
    cells = [F.when((F.col(f"h_{i}") + F.col(f"f_{i}") > 0) & F.col(f"d_{i}").isNotNull(), F.struct(
        F.lit(i).alias("setting"), F.col(f"h_{i}").cast("long").alias("n_healthy"), F.col(f"f_{i}").cast("long").alias("n_failed"), F.col(f"d_{i}").alias("d"))) for i in range(len(settings))]
    train = hits.select("model", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("model", "c.*")
    each = train.select(*BY, "n_healthy", "n_failed", F.posexplode("d").alias("k", "dist"))
    long = each.withColumn("kind", F.when(F.col("k") < len(features), "attr").otherwise("cross")).drop("k")
    found = PT.tune_threshold(long, [*BY, "kind"])
    return found.groupBy(*BY).agg(F.max(F.when(F.col("kind") == "attr", F.col("threshold"))).alias("at"), F.max(F.when(F.col("kind") == "cross", F.col("threshold"))).alias("ct"))


def flagged_windows(hits: DataFrame, thresholds: DataFrame, features: list[str], settings: list[Setting]) -> DataFrame:
    """(setting, model, disk_id, end_day, split, y, attr_novel, cross_novel): novel patches of every window of every setting.

    A day holds the flags of all settings, as they were made from one row, and a window picks its patches up with ``lag``.
    """
    wide = thresholds.groupBy("model").agg(*[F.max(F.when(F.col("setting") == i, F.struct("at", "ct"))).alias(f"_t{i}") for i in range(len(settings))])
    joined = hits.join(F.broadcast(wide), "model")  # one row per device model
    flags = {}
    for i in range(len(settings)):
        d, t = F.col(f"d_{i}"), F.col(f"_t{i}")
        attr = [(F.get(d, F.lit(k)) > t["at"]).cast("int") for k in range(len(features))]
        flags[f"_n{i}"] = F.struct(sum(attr[1:], attr[0]).alias("a"), (F.get(d, F.lit(len(features))) > t["ct"]).cast("int").alias("c"), t.isNotNull().alias("able"))
    days = joined.select(*KEYS, "day", "row", "split", "y", *[n.alias(name) for name, n in flags.items()])
    w, sums = by_device(), []
    for i, s in enumerate(settings):
        def total(field: str) -> Column:
            parts = [F.coalesce(F.lag(F.col(f"_n{i}")[field], s.shape.offset(p)).over(w) if s.shape.offset(p) else F.col(f"_n{i}")[field], F.lit(0)) for p in range(s.shape.count)]
            return sum(parts[1:], parts[0]).cast("long")

        sums.append(F.struct(F.lit(i).alias("setting"), F.lit(s.window_days).alias("size"), F.col(f"_n{i}")["able"].alias("able"), total("a").alias("attr_novel"), total("c").alias("cross_novel")))
    each = days.select(*KEYS, F.col("day").alias("end_day"), "row", "split", "y", F.array(*sums).alias("_s")).filter(F.col("split").isNotNull())
    return each.select(*KEYS, "end_day", "row", "split", "y", F.inline("_s")).filter("able and row >= size").drop("row", "size", "able")


def run_settings(imputed: DataFrame, tags: DataFrame, rule: SplitRule, features: list[str], settings: list[Setting], round_id: int = 1,
                 centers_of: Callable[[SettingPatches], DataFrame] = mean_centers) -> DataFrame:
    """Windows of every setting with their novel patches: scaler, prototypes and thresholds are learned for each setting and model.

    ``centers_of`` gets the patches of all settings, train patches having a weight, and returns (setting, model, kind, k, center).
    """
    rows = materialize(settings_rows(imputed, tags, rule, features, settings, round_id), "sweep-rows")
    scaler = materialize(settings_scaler(rows, features, settings), "sweep-scaler")
    patches = settings_patches(rows, scaler, features, settings)
    centers = materialize(centers_of(patches), "sweep-centers")
    hits = materialize(distances(patches, centers), "sweep-distances")
    thresholds = materialize(tuned(hits, features, settings), "sweep-thresholds")
    return flagged_windows(hits, thresholds, features, settings)


def setting_rates(windows: DataFrame, named: DataFrame, settings: list[Setting], truth: str = "y") -> DataFrame:
    """Per study, setting, model and split: windows, novel patches and the rates of the rule "a window with a novel cross patch fails".

    ``named`` lists (study, window_days, patch_len); a run that two studies share counts in both.
    """
    by, pred = [*BY, "split"], (F.col("cross_novel") > 0).cast("int")
    cells = windows.groupBy(*by, F.col(truth).alias("y"), pred.alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("attr_novel").alias("attr"), F.sum("cross_novel").alias("cross"))

    def cell(y: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("pred") == p), F.col("n"))), F.lit(0))

    counts = cells.groupBy(*by).agg(
        F.sum("n").alias("windows"), F.sum("attr").alias("attr_novel"), F.sum("cross").alias("cross_novel"),
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))
    lengths = windows.sparkSession.createDataFrame([(i, s.window_days, s.patch_len, s.shape.count) for i, s in enumerate(settings)],
                                                   "setting int, window_days int, patch_len int, patches int")
    runs = named.join(lengths, ["window_days", "patch_len"])
    return M.with_rates(counts).join(F.broadcast(runs), "setting").drop("setting")


def window_counts(daily: DataFrame, settings: DataFrame) -> DataFrame:
    """Full windows and patches per window for every setting, from one pass over the daily rows.

    A device with d rows has max(0, d - N + 1) windows of N rows, so counting needs the row counts per
    device only, whatever the number of settings.
    """
    per_device = daily.groupBy("model", "disk_id").agg(F.count("*").alias("d"))
    lengths = per_device.groupBy("model", "d").agg(F.count("*").alias("devices"))
    joined = lengths.join(F.broadcast(settings), F.col("d") >= F.col("window_days"))
    return joined.groupBy("study", "window_days", "patch_len", "model").agg(
        F.sum((F.col("d") - F.col("window_days") + 1) * F.col("devices")).alias("windows")).select(
        "study", "window_days", "patch_len", F.floor(F.col("window_days") / F.col("patch_len")).cast("int").alias("patches"), "model", "windows")
