"""Learn scaler, prototypes, thresholds and vocabularies; assign and describe windows with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fleetpulse.fixed_values import ATTR_PROTOTYPES, CROSS_PROTOTYPES
from fleetpulse.operators import patterns as PT, scaling as SC, summaries as S, vocabulary as V
from fleetpulse.operators.windows import SplitRule, mark_windows
from fleetpulse.session import materialize


@dataclass
class PatternMemory:
    features: list[str]
    shape: PT.PatchShape
    scaler: DataFrame
    attr: DataFrame
    cross: DataFrame
    attr_threshold: DataFrame
    cross_threshold: DataFrame
    attr_vocab: DataFrame
    cross_vocab: DataFrame
    attr_code: DataFrame | None = None
    cross_code: DataFrame | None = None


def patch_rows(imputed: DataFrame, tags: DataFrame, rule: SplitRule, round_id: int, scaler: DataFrame | None, features: list[str],
               shape: PT.PatchShape) -> tuple[DataFrame, DataFrame]:
    """Daily rows with standardized patches and train weights, and the scaler (learned when not given)."""
    marked = mark_windows(imputed, tags, rule, round_id, shape.window)
    if scaler is None:
        cover = SC.train_cover(marked, F.col("split") == "train", shape.window)
        scaler = materialize(SC.window_scaler(cover, features, ["model"]), "scaler")
    z = SC.standardize(marked, scaler, features, ["model"])
    return PT.with_train_weights(PT.with_patches(z, features, shape), shape), scaler


def learn(imputed: DataFrame, tags: DataFrame, rule: SplitRule, features: list[str], round_id: int = 1,
          shape: PT.PatchShape = PT.PatchShape(), groups: dict[str, str] | None = None, seed: int = 0,
          attr_k: int = ATTR_PROTOTYPES, cross_k: int = CROSS_PROTOTYPES, attr_cap: int | None = None,
          cross_cap: int | None = None, code_dims: int = PT.CODE_DIMS) -> PatternMemory:
    """One round of pattern learning. Shared intermediate tables are written, not cached.

    Caps bound the patches a mean series is drawn from, if the caller asks; the published counts are always full.
    """
    rows, scaler = patch_rows(imputed, tags, rule, round_id, None, features, shape)
    rows = materialize(rows, "patch-rows")
    attr_rows, cross_rows = PT.attr_patches(rows, features), PT.cross_patches(rows, features)
    attr_width, cross_width = shape.days, shape.days * len(features)
    attr_code, cross_code = PT.fit_embedding(attr_rows, attr_width, code_dims), PT.fit_embedding(cross_rows, cross_width, code_dims)
    attr_rows, cross_rows = PT.embed(attr_rows, attr_code), PT.embed(cross_rows, cross_code)
    attr = PT.fit_prototypes(attr_rows, "attr", attr_k, min(attr_width, code_dims), seed)
    cross = PT.fit_prototypes(cross_rows, "cross", cross_k, min(cross_width, code_dims), seed)
    attr_hit = materialize(PT.match(attr_rows, attr), "attr-distances")
    cross_hit = materialize(PT.match(cross_rows, cross), "cross-distances")
    at = materialize(PT.tune_threshold(attr_hit, ["model"]), "attr-threshold")
    ct = materialize(PT.tune_threshold(cross_hit, ["model"]), "cross-threshold")
    attr_means = V.capped_means(attr_hit, at, attr_cap, shape.days)
    cross_means = V.capped_means(cross_hit, ct, cross_cap, shape.days * len(features))
    return PatternMemory(
        features, shape, scaler, attr, cross, at, ct, materialize(V.attr_vocabulary(attr_means, attr), "attr-vocab"),
        materialize(V.cross_vocabulary(cross_means, cross, features, shape.days, groups), "cross-vocab"),
        attr_code, cross_code)


def assign(imputed: DataFrame, tags: DataFrame, rule: SplitRule, memory: PatternMemory, round_id: int = 1) -> DataFrame:
    """Windows with the prototype and novelty of every patch."""
    rows, _ = patch_rows(imputed, tags, rule, round_id, memory.scaler, memory.features, memory.shape)
    assigned = PT.assign_rows(rows, memory.features, memory.attr, memory.attr_threshold, memory.cross, memory.cross_threshold,
                              memory.attr_code, memory.cross_code)
    return PT.window_assignments(assigned, memory.features, memory.shape)


def describe(windows: DataFrame, memory: PatternMemory, index: str) -> DataFrame:
    return S.describe_patterns(windows, V.phrase_maps(memory.attr_vocab), V.phrase_maps(memory.cross_vocab), memory.features, index, memory.shape)
