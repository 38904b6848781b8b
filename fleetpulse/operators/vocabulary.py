"""Representative patches, labels and phrases of prototypes, and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.fixed_values import ATTR_PHRASES, CROSS_PHRASES, UNKNOWN_CROSS_PHRASE, UNKNOWN_PHRASE
from fleetpulse.functions.scalars import feature_group_of, phrase_of
from fleetpulse.functions.series import series_stats
from fleetpulse.functions.trends import cross_label, label_role, series_label
from fleetpulse.operators.sampling import capped


def representatives(matched: DataFrame, thresholds: DataFrame, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Patches within the threshold with ``weight``, the number of train windows that hold them.

    Without a cap every patch counts. With a cap a uniform sample of the single occurrences is kept
    per prototype, drawn inside hash buckets.
    """
    near = matched.join(F.broadcast(thresholds), "model").filter("dist <= threshold").drop("threshold")
    near = near.withColumn("weight", F.col("n_healthy") + F.col("n_failed")).filter("weight > 0")
    if cap is None:
        return near
    single = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight")))).withColumn("weight", F.lit(1))
    keys = [c for c in ("disk_id", "day", "attr", "copy") if c in single.columns]
    return capped(single, ["model", "proto"], keys, cap, seed).drop("copy")


def mean_series(reps: DataFrame, length: int) -> DataFrame:
    """(model, k, num_patches, mean_patch): weighted mean raw patch per prototype, element by element."""
    w = F.col("weight")
    means = F.array(*[F.sum(F.get("raw", F.lit(i)) * w) / F.sum(w) for i in range(length)])
    return reps.groupBy("model", F.col("proto").alias("k")).agg(F.sum(w).alias("num_patches"), means.alias("mean_patch"))


def capped_means(matched: DataFrame, thresholds: DataFrame, cap: int | None, length: int) -> DataFrame:
    """Mean series of at most ``cap`` representatives, with the number of all of them."""
    means = mean_series(representatives(matched, thresholds, cap), length)
    if cap is None:
        return means
    full = representatives(matched, thresholds).groupBy("model", F.col("proto").alias("k")).agg(F.sum("weight").alias("num_patches"))
    return full.join(means.drop("num_patches"), ["model", "k"]).select("model", "k", "num_patches", "mean_patch")


def every_prototype(means: DataFrame, prototypes: DataFrame) -> DataFrame:
    """All prototypes; one without patches gets an empty mean and no count."""
    listed = prototypes.select("model", "k").distinct()
    joined = listed.join(means, ["model", "k"], "left")
    return joined.select("model", "k", F.coalesce("num_patches", F.lit(0)).alias("num_patches"),
                         F.coalesce("mean_patch", F.array().cast("array<double>")).alias("mean_patch"))


def attr_vocabulary(means: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(model, kind, k, label, phrase, num_patches, stats)."""
    rows = every_prototype(means, prototypes).withColumn("label", series_label(F.col("mean_patch")))
    return rows.select(
        "model", F.lit("attr").alias("kind"), "k", "label", phrase_of(F.col("label"), ATTR_PHRASES, UNKNOWN_PHRASE).alias("phrase"),
        "num_patches", F.when(F.col("num_patches") > 0, series_stats(F.col("mean_patch"))).alias("stats"))


def attribute_means(features: list[str], length: int) -> Column:
    """Array of the attributes' mean patches cut from a cross mean."""
    return F.array(*[F.slice("mean_patch", i * length + 1, length) for i in range(len(features))])


def cross_details(means: DataFrame, features: list[str], length: int, groups: dict[str, str] | None = None) -> DataFrame:
    """(model, k, attr, label, role, grp): the attributes of every cross prototype."""
    items = F.transform(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("attr"),
                                     F.array(*[F.lit(feature_group_of(f, groups)) for f in features]).alias("grp"),
                                     attribute_means(features, length).alias("m")),
                        lambda z: F.struct(z["attr"].alias("attr"), z["grp"].alias("grp"), series_label(z["m"]).alias("label")))
    rows = means.select("model", "k", F.explode(items).alias("i")).select("model", "k", "i.*")
    return rows.withColumn("role", label_role(F.col("label")))


def role_counts(details: DataFrame) -> DataFrame:
    """Attributes per role, and per group and role, of every cross prototype."""
    roles = ["stable", "trend", "spiky", "noisy"]
    cols = [F.count_if(F.col("role") == r).alias(r) for r in roles]
    cols += [F.count_if((F.col("grp") == g) & (F.col("role") == r)).alias(f"{g}_{r}")
             for g in ("error", "wear", "workload", "other") for r in roles]
    return details.groupBy("model", "k").agg(*cols)


def cross_vocabulary(means: DataFrame, prototypes: DataFrame, features: list[str], length: int,
                     groups: dict[str, str] | None = None) -> DataFrame:
    rows = every_prototype(means, prototypes)
    labels = F.transform(attribute_means(features, length), series_label)
    named = rows.withColumn("label", F.when(F.col("num_patches") == 0, "UNUSED_PROTO").otherwise(
        cross_label(labels, [feature_group_of(f, groups) for f in features])))
    return named.select(
        "model", F.lit("cross").alias("kind"), "k", "label",
        phrase_of(F.col("label"), CROSS_PHRASES, UNKNOWN_CROSS_PHRASE).alias("phrase"), "num_patches",
        F.when(F.col("num_patches") > 0, series_stats(F.col("mean_patch"))).alias("stats"))


def phrase_maps(vocab: DataFrame) -> DataFrame:
    """One row per model: map of prototype number to phrase. K entries per model."""
    pairs = vocab.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "phrase")))).alias("phrases"))
    return pairs


def flat_dictionary(vocab: DataFrame, thresholds: DataFrame, patch_days: int) -> DataFrame:
    """The dictionary as flat records with cut-off, patch length and the statistics as JSON."""
    joined = vocab.join(thresholds, ["model", "kind"])
    return joined.select("model", "kind", F.col("k").alias("cluster_id"), "label", "phrase",
                         F.col("num_patches").alias("support_count"), F.col("threshold").alias("distance_cutoff"),
                         F.lit(patch_days).alias("patch_len"), F.coalesce(F.to_json("stats"), F.lit("{}")).alias("stats_json"))


def center_records(prototypes: DataFrame, thresholds: DataFrame) -> DataFrame:
    return prototypes.join(thresholds, ["model", "kind"]).select(
        "model", "kind", F.col("k").alias("cluster_id"), F.size("center").alias("embedding_dim"),
        F.col("threshold").alias("distance_cutoff"), F.to_json("center").alias("center_vector_json"))


def example_patches(reps: DataFrame, means: DataFrame, top: int = 6, samples: int = 20, seed: int = 42) -> DataFrame:
    """Sample patches and the mean of the most used prototypes of each model: the data of a figure."""
    from fleetpulse.operators.reports import top_per_group

    ranked = top_per_group(means.filter("num_patches > 0"), ["model"], [F.desc("num_patches"), F.asc("k")], top)
    keys = [c for c in ("disk_id", "day", "attr") if c in reps.columns]
    drawn = capped(reps.withColumnRenamed("proto", "k").join(ranked.select("model", "k"), ["model", "k"], "left_semi"),
                   ["model", "k"], keys, samples, seed)
    return drawn.select("model", "k", F.lit("sample").alias("part"), "raw").unionByName(
        ranked.select("model", "k", F.lit("mean").alias("part"), F.col("mean_patch").alias("raw")))
