"""Patch prototypes: learning, novelty thresholds and assignment.

The patches of neighbouring windows are the same rows seen from different ends. So a patch is cut,
embedded and matched once per day and attribute, with the number of healthy and failed train
windows that contain it as weights; a window then picks its patches up with ``lag`` over the same
sort. Nothing is exploded per window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.fixed_values import (
    FALLBACK_QUANTILE, MAX_FALSE_ALARM, NOVELTY_QUANTILES, PATCH_DAYS,
    WINDOW_DAYS,
)
from fleetpulse.functions.scalars import eps_f1, let, safe_div
from fleetpulse.operators.clusters import fit_clusters
from fleetpulse.operators.directions import fit_directions, with_code
from fleetpulse.operators.grouped import by_group
from fleetpulse.operators.ranking import exact_quantiles
from fleetpulse.operators.sampling import capped
from fleetpulse.operators.windows import KEYS, by_device
from fleetpulse.session import materialize

#: Length of a patch's code.
CODE_DIMS = 64
NEAREST = "dist double, k int"


@dataclass(frozen=True)
class PatchShape:
    days: int = PATCH_DAYS
    window: int = WINDOW_DAYS

    @property
    def count(self) -> int:
        return self.window // self.days

    def offset(self, p: int) -> int:
        """Rows between the end of patch p and the end of its window."""
        return self.window - (p + 1) * self.days


def with_patches(rows: DataFrame, features: list[str], shape: PatchShape = PatchShape(), prefix: str = "z_") -> DataFrame:
    """Adds ``raw_<attr>`` and ``zp_<attr>``, the last ``days`` values; null at the head of a series."""
    names = [x for c in features for x in (c, f"{prefix}{c}")]
    back = range(shape.days - 1, 0, -1)
    # columns that look back the same number of rows share a frame, where a list over a frame is gathered anew for every row
    lags = {f"_back{i}_{x}": F.lag(x, i).over(by_device()) for i in back for x in names}
    held = rows.withColumns({"_ready": F.row_number().over(by_device()) >= shape.days, **lags})

    def listed(x: str) -> Column:
        parts = [F.col(f"_back{i}_{x}") for i in back] + [F.col(x)]
        values = F.array(*parts)
        return F.when(F.col("_ready"), F.when(reduce(and_, [p.isNotNull() for p in parts]), values).otherwise(F.array_compact(values)))

    made = {name: listed(x) for c in features for name, x in ((f"raw_{c}", c), (f"zp_{c}", f"{prefix}{c}"))}
    return held.withColumns(made).drop("_ready", *lags)


def with_train_weights(rows: DataFrame, shape: PatchShape = PatchShape()) -> DataFrame:
    """Adds ``n_healthy`` and ``n_failed``: train windows that hold the patch ending here."""
    kinds = {"n_healthy": 0, "n_failed": 1}
    out = rows.withColumns({f"_{n}": F.when((F.col("split") == "train") & (F.col("y") == y), 1).otherwise(0) for n, y in kinds.items()})
    ahead = {n: [F.coalesce(F.lead(f"_{n}", shape.offset(p)).over(by_device()), F.lit(0)) for p in range(shape.count)] for n in kinds}
    return out.withColumns({n: sum(parts, F.lit(0)) for n, parts in ahead.items()}).drop(*[f"_{n}" for n in kinds])


def attr_patches(rows: DataFrame, features: list[str]) -> DataFrame:
    """(model, disk_id, day, attr, raw, emb, n_healthy, n_failed): one row per day and attribute."""
    items = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"raw_{c}").alias("raw"), F.col(f"zp_{c}").alias("emb"))
                      for c in features])
    kept = rows.filter(F.col(f"raw_{features[0]}").isNotNull() & (F.col("n_healthy") + F.col("n_failed") > 0))
    return kept.select(*KEYS, "day", "n_healthy", "n_failed", F.explode(items).alias("i")).select(
        *KEYS, "day", "i.attr", "i.raw", "i.emb", "n_healthy", "n_failed")


def cross_patches(rows: DataFrame, features: list[str]) -> DataFrame:
    """The same for all attributes at once; ``raw`` and ``emb`` hold the attributes one after the other."""
    kept = rows.filter(F.col(f"raw_{features[0]}").isNotNull() & (F.col("n_healthy") + F.col("n_failed") > 0))
    return kept.select(*KEYS, "day", F.concat(*[F.col(f"raw_{c}") for c in features]).alias("raw"),
                       cross_embedding(features).alias("emb"), "n_healthy", "n_failed")


def cross_embedding(features: list[str]) -> Column:
    return F.concat(*[F.col(f"zp_{c}") for c in features])


def fit_embedding(patches: DataFrame, width: int, dims: int = CODE_DIMS) -> DataFrame | None:
    """(model, mean, directions): a linear code of each model's patches, which count as often as train windows hold them.

    None where a patch has no more than ``dims`` values and is its own code.
    """
    if width <= dims:
        return None
    weighted = patches.withColumn("_w", F.col("n_healthy") + F.col("n_failed"))
    return materialize(fit_directions(weighted, ["model"], "emb", width, dims, "_w"), "embedding")


def embed(patches: DataFrame, code: DataFrame | None) -> DataFrame:
    """Replaces ``emb`` by its code."""
    if code is None:
        return patches
    return with_code(patches, code, ["model"], "emb", "_code").drop("emb").withColumnRenamed("_code", "emb")


def coded(emb: Column, mean: Column, directions: Column) -> Column:
    """The same code as an expression; ``directions`` lists one direction after the other."""
    def along(shifted: Column) -> Column:
        width = F.size(shifted)
        return F.transform(F.sequence(F.lit(0), (F.size(directions) / width).cast("int") - 1), lambda d: F.aggregate(
            F.zip_with(shifted, F.slice(directions, d * width + 1, width), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))

    return F.when(emb.isNotNull(), let(F.zip_with(emb, mean, lambda a, b: a - b), along))


def fit_prototypes(patches: DataFrame, kind: str, k: int, width: int, seed: int = 0, cap: int | None = None, max_iter: int = 300,
                   tolerance: float = 1e-3) -> DataFrame:
    """K-means centers of all device models in the same jobs: (model, kind, k, center).

    Each patch counts as often as train windows hold it. All patches count unless the caller caps them.
    """
    keys = [c for c in ("disk_id", "day", "attr") if c in patches.columns]
    chosen = patches if cap is None else capped(patches, ["model"], keys, cap, seed)
    weighted = chosen.withColumn("_weight", F.col("n_healthy") + F.col("n_failed"))
    found = fit_clusters(weighted, ["model"], "emb", width, k, ["model", *keys], "_weight", seed, max_iter, tolerance)
    return found.select("model", F.lit(kind).alias("kind"), F.posexplode("centers").alias("k", "center"))


def mean_prototypes(patches: DataFrame, kind: str, group: Column, weight: Column, length: int) -> DataFrame:
    """Centers as weighted means of given groups of patches, for prototypes that need no clustering."""
    sums = [F.sum(F.get("emb", F.lit(i)) * weight) / F.sum(weight) for i in range(length)]
    means = patches.filter(weight > 0).groupBy("model", group.cast("int").alias("k")).agg(F.array(*[F.round(s, 6) for s in sums]).alias("center"))
    return means.select("model", F.lit(kind).alias("kind"), "k", "center")


def center_lists(prototypes: DataFrame) -> DataFrame:
    """One row per model with its centers in k order; K is a fixed small number."""
    lists = prototypes.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("k", "center"))).alias("c"))
    return lists.select("model", F.transform("c", lambda s: s["center"]).alias("centers"))


def nearest(emb: Column, centers: Column) -> Column:
    """struct(dist, k) of the nearest center; the lowest k wins ties."""
    def dists(e: Column) -> Column:
        return F.transform(centers, lambda c: F.sqrt(F.aggregate(
            F.zip_with(c, e, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)))

    return F.when(emb.isNotNull(), let(emb, lambda e: let(dists(e), lambda d: F.struct(
        F.array_min(d).alias("dist"), (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("k")))))


def nearest_rows(values: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and number of the nearest center of each row of a matrix; the lowest number wins ties."""
    best, k = np.full(len(values), np.nan), np.zeros(len(values), np.int32)
    for j, c in enumerate(centers):
        d2 = np.zeros(len(values))
        for i in range(len(c)):  # in the order of the components, as a fold adds them
            gap = c[i] - values[:, i]
            d2 += gap * gap
        d = np.sqrt(d2)
        closer = ~np.isnan(d) & ((d < best) | np.isnan(best))
        best[closer], k[closer] = d[closer], j
    return best, k


def nearest_of(model: str, emb: Column, lists: dict[str, list[list[float]]]) -> Column:
    """The same struct for the centers of each row's model, compared as matrices of a batch; null where the model has none.

    A vector of another length or with a hole has no distance.
    """
    centers = {m: np.array(c, np.float64) for m, c in lists.items()}

    @F.arrow_udf(NEAREST)
    def found(models: pa.Array, vectors: pa.Array) -> pa.Array:
        near, at = np.full(len(vectors), np.nan), np.zeros(len(vectors), np.int32)
        known, measured = np.zeros(len(vectors), bool), np.zeros(len(vectors), bool)
        for key, own in by_group(pa.RecordBatch.from_arrays([models], names=["model"]), ["model"]):
            some = centers.get(models[int(own[0])].as_py())
            if some is None:
                continue
            part = vectors.take(pa.array(own))
            known[own] = part.is_valid().to_numpy(zero_copy_only=False)
            width = some.shape[1]
            values, whole = list_values(part, width)
            own = own[whole]
            best, k = nearest_rows(values, some)
            near[own], at[own], measured[own] = best, k, True
        fields = [pa.array(near, pa.float64(), mask=~measured), pa.array(at, pa.int32(), mask=~measured)]
        return pa.StructArray.from_arrays(fields, names=["dist", "k"], mask=pa.array(~known))

    return found(F.col(model), emb)


def nearest_patches(model: str, series: str, mean: str, std: str, days: int, lists: dict[str, list[list[float]]]) -> Column:
    """The same structs for all patches of a series, in order, standardized by ``mean`` and ``std``; a tail shorter than ``days`` is dropped.

    A patch with a hole, or of a model without centers, has neither distance nor number.
    """
    centers = {m: np.array(c, np.float64) for m, c in lists.items()}

    @F.arrow_udf(f"array<struct<{NEAREST.replace('dist ', 'dist: ').replace('k ', 'k: ')}>>")
    def found(models: pa.Array, xs: pa.Array, means: pa.Array, stds: pa.Array) -> pa.Array:
        lengths = xs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = xs.flatten()  # without what a null list may hold
        whole = flat.is_valid().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        counts = lengths // days
        ends = np.concatenate([[0], np.cumsum(counts)])
        row = np.repeat(np.arange(len(xs)), counts)
        first = (np.cumsum(lengths) - lengths)[row] + days * (np.arange(ends[-1]) - ends[row])
        at = first[:, None] + np.arange(days)
        m, s = (v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (means, stds))
        scaled = means.is_valid().to_numpy(zero_copy_only=False) & stds.is_valid().to_numpy(zero_copy_only=False)
        fine = whole[at].all(axis=1) & scaled[row]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            z = (values[at] - m[row, None]) / s[row, None]
            near, k, measured = np.full(len(row), np.nan), np.zeros(len(row), np.int32), np.zeros(len(row), bool)
            for key, own in by_group(pa.RecordBatch.from_arrays([models], names=["model"]), ["model"]):
                some = centers.get(key[0])
                if some is None or some.shape[1] != days:
                    continue
                held = np.zeros(len(xs), bool)
                held[own] = True
                mine = np.flatnonzero(held[row] & fine)
                near[mine], k[mine] = nearest_rows(z[mine], some)
                measured[mine] = True
        fields = [pa.array(near, pa.float64(), mask=~measured), pa.array(k, pa.int32(), mask=~measured)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["dist", "k"]))

    return found(F.col(model), F.col(series), F.col(mean), F.col(std))


def list_values(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``width`` values without nulls as a matrix, and which ones these are."""
    whole = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width
    values = lists.filter(pa.array(whole)).flatten()
    if values.null_count:
        full = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)
        whole[np.flatnonzero(whole)[~full]] = False
        values = lists.filter(pa.array(whole)).flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width), whole


def collected_centers(prototypes: DataFrame) -> dict[str, list[list[float]]]:
    """Centers by model at the driver: K vectors of fixed length for each device model."""
    return {r["model"]: r["centers"] for r in center_lists(prototypes).collect() if r["model"] is not None}


def match(patches: DataFrame, prototypes: DataFrame, emb: str = "emb") -> DataFrame:
    """Adds ``proto`` and ``dist`` of the nearest prototype of the row's model."""
    lists = collected_centers(prototypes)
    joined = patches.filter(F.col("model").isin(list(lists)))
    return joined.withColumn("_n", nearest_of("model", F.col(emb), lists)).select(
        *patches.columns, F.col("_n.k").alias("proto"), F.col("_n.dist").alias("dist"))


def threshold_scores(matched: DataFrame, by: list[str], quantiles: list[float] = NOVELTY_QUANTILES) -> DataFrame:
    """False-alarm rate, hit rate and F1 of ``dist > tau`` for each quantile tau of the distances."""
    weighted = matched.withColumn("_w", F.col("n_healthy") + F.col("n_failed"))
    points = sorted({*quantiles, FALLBACK_QUANTILE})
    taus = exact_quantiles(weighted, by, "dist", points, "_w").select(*by, "q", F.col("quantile").alias("tau"))
    # stored, as they are joined twice
    rows = materialize(taus.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("q", "tau"))).alias("taus")), "taus")
    # count once per (group, number of taus below the distance), then add up the cells above a tau; plain numbers only, which are added up in a hash table
    below = [F.coalesce((F.get("taus", F.lit(k))["tau"] < F.col("dist")).cast("int"), F.lit(0)) for k in range(len(points))]
    cells = matched.join(F.broadcast(rows), by).groupBy(*by, sum(below[1:], below[0]).alias("cell")).agg(F.sum("n_healthy").alias("h"), F.sum("n_failed").alias("f"))
    packed = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "h", "f")).alias("cells")).join(F.broadcast(rows), by)

    def total(field: str, i: Column | None = None) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(
            F.lit(True) if i is None else c["cell"] > i, c[field]).otherwise(F.lit(0)))

    at = packed.select("*", F.posexplode("taus").alias("i", "t"))
    counts = at.select(*by, "t.q", "t.tau", total("f", F.col("i")).alias("tp"), total("h", F.col("i")).alias("fp"),
                       total("f").alias("n_failed"), total("h").alias("n_healthy"))
    fn = F.col("n_failed") - F.col("tp")
    return counts.withColumns({
        "fpr": safe_div(F.col("fp"), F.col("n_healthy")), "tpr": safe_div(F.col("tp"), F.col("n_failed")),
        "f1": eps_f1(F.col("tp"), F.col("fp"), fn)})


def tune_threshold(matched: DataFrame, by: list[str], max_fpr: float = MAX_FALSE_ALARM,
                   quantiles: list[float] = NOVELTY_QUANTILES) -> DataFrame:
    """(by, threshold): best F1 with few enough false alarms, the lowest quantile among equals.

    Without any such quantile the highest one is taken, and without both classes the 0.95 quantile.
    """
    scores = threshold_scores(matched, by, quantiles)
    listed = F.col("q").isin([float(q) for q in quantiles])
    fits = listed & (F.col("fpr") <= max_fpr)
    best = scores.groupBy(*by).agg(
        F.max_by("tau", F.when(fits, F.struct(F.col("f1"), -F.col("q")))).alias("best"),
        F.max_by("tau", F.when(listed, F.col("q"))).alias("top"),
        F.max(F.when(F.col("q") == FALLBACK_QUANTILE, F.col("tau"))).alias("plain"),
        F.max("n_failed").alias("nf"), F.max("n_healthy").alias("nh"))
    one_class = (F.col("nf") == 0) | (F.col("nh") == 0)
    return best.select(*by, F.when(one_class, F.col("plain")).otherwise(F.coalesce("best", "top")).alias("threshold"))


def assign_rows(rows: DataFrame, features: list[str], attr: DataFrame, attr_threshold: DataFrame, cross: DataFrame,
                cross_threshold: DataFrame, attr_code: DataFrame | None = None, cross_code: DataFrame | None = None) -> DataFrame:
    """Adds ``a_<attr>`` and ``a_cross``: struct(proto, novel, dist) of the patch that ends at a row.

    The codes are those the prototypes were learned on; None where patches are their own codes.
    """
    attr_lists, cross_lists = collected_centers(attr), collected_centers(cross)
    learned = attr_threshold.select("model", F.col("threshold").alias("_at")).join(
        cross_threshold.select("model", F.col("threshold").alias("_ct")), "model").filter(F.col("model").isin([m for m in attr_lists if m in cross_lists]))
    codes = {"a": attr_code, "c": cross_code}
    for kind, code in codes.items():
        if code is not None:
            learned = learned.join(code.select("model", F.col("mean").alias(f"_{kind}m"), F.col("directions").alias(f"_{kind}d")), "model")

    def code_of(emb: Column, kind: str) -> Column:
        return emb if codes[kind] is None else coded(emb, F.col(f"_{kind}m"), F.col(f"_{kind}d"))

    # one row per device model
    joined = rows.join(F.broadcast(learned), "model")
    near = {f"_n_{c}": nearest_of("model", code_of(F.col(f"zp_{c}"), "a"), attr_lists) for c in features}
    near["_n_cross"] = nearest_of("model", code_of(cross_embedding(features), "c"), cross_lists)

    def flagged(c: str, threshold: str) -> Column:
        n = F.col(f"_n_{c}")
        return F.when(n.isNotNull(), F.struct(n["k"].alias("proto"), (n["dist"] > F.col(threshold)).alias("novel"), n["dist"].alias("dist")))

    made = {f"a_{c}": flagged(c, "_at") for c in features} | {"a_cross": flagged("cross", "_ct")}
    return joined.withColumns(near).withColumns(made).drop(*near, "_at", "_ct", "_am", "_ad", "_cm", "_cd")


def window_assignments(assigned: DataFrame, features: list[str], shape: PatchShape = PatchShape(),
                       keep_days: bool = True) -> DataFrame:
    """One row per window with ``p_<attr>`` and ``p_cross``, its patches' assignments in order.

    With ``keep_days`` the raw days of the window come along as ``<attr>`` arrays.
    """
    w = by_device()
    made = {}
    for c in [*features, "cross"]:
        made[f"p_{c}"] = F.array(*[F.col(f"_a{p}.{c}") for p in range(shape.count)])
    # one column holds all assignments of a day, so that a patch of the window is one look back
    both = assigned.withColumn("_a", F.struct(*[F.col(f"a_{c}").alias(c) for c in [*features, "cross"]])).drop(*[f"a_{c}" for c in [*features, "cross"]])
    both = both.withColumns({f"_a{p}": F.lag("_a", shape.offset(p)).over(w) if shape.offset(p) else F.col("_a") for p in range(shape.count)})
    if keep_days:
        frame = w.rowsBetween(-(shape.window - 1), 0)
        made.update({c: F.collect_list(c).over(frame) for c in features})
    windows = both.withColumns(made).filter(F.col("split").isNotNull())
    drop = [f"{k}_{c}" for k in ("raw", "zp", "z") for c in features] + ["_a", *[f"_a{p}" for p in range(shape.count)]]
    return windows.drop(*drop, *([] if keep_days else features)).withColumnRenamed("day", "end_day")


def long_assignments(windows: DataFrame, features: list[str]) -> DataFrame:
    """(window, kind, attr, p, proto, novel): the flat form; attr is null for cross patches."""
    rows = [F.struct(F.lit("cross" if c == "cross" else "attr").alias("kind"), F.lit(None if c == "cross" else c).cast("string").alias("attr"),
                     F.col(f"p_{c}").alias("patches")) for c in [*features, "cross"]]
    window = [*KEYS, "end_day", "split", "y"]
    each = windows.select(*window, F.explode(F.array(*rows)).alias("i"))
    # a list is taken apart by generated code, where building the rows of all lists at once is interpreted
    flat = each.select(*window, "i.kind", "i.attr", F.posexplode("i.patches").alias("p", "a"))
    return flat.select(*window, "kind", "attr", "p", "a.proto", "a.novel", "a.dist")
