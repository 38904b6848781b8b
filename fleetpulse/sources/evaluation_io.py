"""Evaluation files: sampled indices, predictions, run metrics, vocabularies, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

INDEX_SCHEMA = ("dataset string, round int, split string, test_index long, true_status int, selected_group string, "
                "sample_rank long, healthy_per_failed double, seed int")
PREDICTION_SCHEMA = ("index long, dataset_name string, round int, summary string, true_status int, pred_status int, "
                     "true_ttf_days double, pred_ttf_days string, pred_ttf_bucket string, concern_level string, "
                     "explanation string, recommendations array<string>, raw_response string")
TP_COLUMNS = ["idx", "status_true", "status_pred", "ttf_true", "ttf_days_pred", "ttf_bucket_pred",
              "ttf_bucket_midpoint", "explanation", "recommendations"]
STATS_SCHEMA = ("struct<L:int, level_mean:double, level_std:double, delta:double, amp:double, max_step:double, "
                "mean_abs_step:double, step_std:double, pos_max_step:double>")
VOCAB_ENTRY = f"struct<label:string, phrase:string, num_patches:long, stats:{STATS_SCHEMA}>"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .schema(schema).csv(path))


def read_sampled_indices(spark: SparkSession, path: str, dataset: str, round_id: int) -> DataFrame:
    """The fixed evaluation index of one dataset and round; an empty selection is an error."""
    rows = spark.read.option("header", True).schema(INDEX_SCHEMA).csv(path)
    return require_rows(pick_indices(rows, dataset, round_id), f"no sampled index for {dataset} round {round_id}")


def pick_indices(rows: DataFrame, dataset: str, round_id: int) -> DataFrame:
    return rows.filter((F.upper(F.trim("dataset")) == dataset.strip().upper()) & (F.col("round") == round_id))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("method", "backbone", "dataset", "round").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(PREDICTION_SCHEMA + ", method string, backbone string, dataset string").json(path)


def true_positive_details(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The flat record kept for each correctly predicted failure, after the columns that say which run it is from."""
    from fleetpulse.functions.responses import join_recommendations
    from fleetpulse.functions.scalars import bucket_midpoint

    hits = df.filter("true_status = 1 and pred_status = 1")
    return hits.select(
        *keys, F.col("index").alias("idx"), F.col("true_status").alias("status_true"), F.col("status_text").alias("status_pred"),
        F.col("true_ttf_days").alias("ttf_true"), F.col("pred_ttf_days").alias("ttf_days_pred"),
        F.trim("pred_ttf_bucket").alias("ttf_bucket_pred"), bucket_midpoint(F.col("pred_ttf_bucket")).alias("ttf_bucket_midpoint"),
        "explanation", join_recommendations(F.col("recommendations")).alias("recommendations"))


def read_run_tree(spark: SparkSession, root: str, schema: str, suffix: str = "_metrics.json", fmt: str = "json") -> DataFrame:
    """``root/method/backbone/DATASET_roundN<suffix>`` with the path's parts as columns."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    files = reader.option("multiLine", True).json(root) if fmt == "json" else reader.option("header", True).csv(root)
    path = F.col("_metadata.file_path")
    pattern = r"([^/]+)/([^/]+)/([^/_]+)_round([0-9]+)[^/]*$"
    return files.select(
        "*", F.regexp_extract(path, pattern, 1).alias("method"), F.regexp_extract(path, pattern, 2).alias("backbone"),
        F.regexp_extract(path, pattern, 3).alias("dataset"), F.regexp_extract(path, pattern, 4).cast("int").alias("round"))


def vocabulary_json(vocab: DataFrame, by: list[str]) -> DataFrame:
    """One JSON document per group: kind -> prototype id -> entry. A vocabulary has K entries per kind."""
    entry = F.struct("label", "phrase", "num_patches", "stats")
    per_kind = vocab.groupBy(*by, "kind").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("k").cast("string"), entry)))).alias("entries"))
    docs = per_kind.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col("kind"), F.to_json("entries").alias("json"))))).alias("m"))
    return docs.select(*by, F.concat(
        F.lit("{"), F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(
            F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}")).alias("document"))


def parse_vocabulary(docs: DataFrame, by: list[str], document: str = "document") -> DataFrame:
    """Nested vocabulary documents to rows (by, kind, k, label, phrase, num_patches, stats)."""
    kinds = F.from_json(document, f"map<string, map<string, {VOCAB_ENTRY}>>")
    rows = docs.select(*by, F.explode(kinds).alias("kind", "entries")).select(*by, "kind", F.explode("entries").alias("k", "e"))
    return rows.select(*by, "kind", F.col("k").cast("int").alias("k"), "e.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary files, one JSON document per file, with the file's path as the group."""
    docs = spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    return parse_vocabulary(docs, ["path"])


def metrics_document(metrics: DataFrame) -> DataFrame:
    """Confusion counts and rates nested as ``classification``, one row per run."""
    counts = ["tp", "fp", "tn", "fn", "precision", "recall", "f1", "f05", "fpr", "fnr"]
    return metrics.select("method", "backbone", "dataset", "round", F.struct(*counts).alias("classification"))

