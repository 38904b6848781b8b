"""Learned tables: scaler, prototypes, assignments; and tables that are learned once for the same input and parameters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

KINDS = ("scaler", "prototypes", "assignments")


def save_learned(df: DataFrame, root: str, kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    path = f"{root.rstrip('/')}/{kind}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_learned(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{kind}")


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """Key of what is learned from the files below ``inputs`` (their paths, sizes and times, not their content) and ``parameters``.

    The files' digests are added up, so neither their number nor their order matters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs)
    facts = [F.col("path"), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")]
    digest = [F.xxhash64(F.lit(k), *facts) for k in (0, 1)]
    sums = [F.sum(d.cast("decimal(38,0)")).cast("string") for d in digest]
    text = F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums, F.lit(json.dumps(parameters, sort_keys=True, default=str)))
    return files.agg(F.sha2(text, 256)).first()[0]


def learn_once(spark: SparkSession, root: str, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of that key: read if it is there, else built, written and read.

    A table counts once its path is in the manifest, which is written after it, so one that was left half written is never read. Of
    two runs at once both may build it; all later readers take the same one, the first by path. Tables of old keys stay until
    somebody removes their folders.
    """
    place = f"{root.rstrip('/')}/{name}/{key}"
    found = _entry(spark, f"{place}/manifest")
    if found is None:
        run = uuid.uuid4().hex
        build().write.parquet(f"{place}/data-{run}")
        # a folder of its own: writers that append to one folder at once remove each other's temporary files
        spark.createDataFrame([(f"{place}/data-{run}",)], "data string").coalesce(1).write.parquet(f"{place}/manifest/{run}")
        found = _entry(spark, f"{place}/manifest")
    return spark.read.parquet(found)


def _entry(spark: SparkSession, manifest: str) -> str | None:
    try:
        return spark.read.schema("data string").option("recursiveFileLookup", True).parquet(manifest).agg(F.min("data")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
