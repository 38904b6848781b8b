"""Daily telemetry logs and failure tags as CSV folders; the per-model sink."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import quote

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetpulse.fixed_values import MODEL_ATTRIBUTES, RAW_ATTRIBUTES, SKIPPED_DAY_FILES
from fleetpulse.functions.scalars import parse_day

ID_COLUMNS = ["disk_id", "ds", "model"]
#: Bytes that are read of a file at a time to find its header.
HEADER_BYTES = 1 << 16
#: Stores whose files a task can open with its own credentials.
ARROW_STORES = frozenset({"file", "s3", "s3a", "gs", "abfs", "abfss"})


def log_schema(attributes: Iterable[str] = RAW_ATTRIBUTES) -> T.StructType:
    fields = [T.StructField("disk_id", T.LongType()), T.StructField("ds", T.IntegerType()),
              T.StructField("model", T.StringType())]
    return T.StructType(fields + [T.StructField(a, T.DoubleType()) for a in attributes])


def first_line(file, step: int = HEADER_BYTES) -> str | None:
    """First line of an open binary file, read in steps until it ends; None for an empty file."""
    head = b""
    while True:
        more = file.read(step)
        head += more
        if not more or b"\n" in more or b"\r" in more:
            return re.split("[\r\n]", head.decode("utf-8", "replace"), maxsplit=1)[0] if head else None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark lists it, and the path in it; for use in tasks."""
    scheme, _, rest = ("", "", path) if path.startswith("/") else path.partition(":")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(scheme.replace("s3a", "s3") + ":" + quote(rest, safe="/@"))


def _open(path: str):
    store, inner = _store(path)
    return store.open_input_stream(inner)


def _headers(batches):
    for batch in batches:
        paths, lines = batch.column(0), []
        for path in paths.to_pylist():
            with _open(path) as f:
                lines.append(first_line(f))
        yield pa.record_batch([paths, pa.array(lines, pa.string())], ["file", "header"])


def file_headers(spark: SparkSession, directories: list[str], stores: frozenset[str] = ARROW_STORES) -> DataFrame:
    """(header, files): the files below the folders by their first line; empty files are left out.

    The list of files comes without their content; a task opens each file and reads no further than the step that ends its first
    line. Only where a file lies in a store not named in ``stores`` are the lines found by a scan.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(directories)
    if {f.partition(":")[0] for f in listed.inputFiles()} <= stores:
        first = listed.filter("length > 0").select("path").mapInArrow(_headers, "file string, header string")
    else:
        first = scanned_headers(spark, directories)
    return first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def scanned_headers(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(file, header) from a scan of all lines, of which only those of the block at a file's start count."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(directories)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"),
                         F.col("_metadata.file_block_start").alias("start")).filter("start = 0")
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def read_daily_logs(spark: SparkSession, directories: list[str], schema: T.StructType | None = None,
                    skipped: list[str] | None = None, stores: frozenset[str] = ARROW_STORES) -> DataFrame:
    """Every CSV below the listed folders as one DataFrame, each file by its own header.

    Files of equal headers are read together and the reads united by name, so columns that a file lacks are null. A file
    without an id column is an error that names it, and so is a file that can't be read: no file is left out silently. Day
    files named in ``skipped`` are left out. The list of files is what the driver holds, as Spark's own file index does.
    """
    wanted, parts = schema or log_schema(), []
    for row in file_headers(spark, directories, stores).orderBy("header").collect():
        header = [c.strip().strip('"') for c in row.header.lstrip("\ufeff").split(",")]
        try:
            require_columns(header)
        except ValueError as e:
            raise ValueError(f"{e} in {row.files[:5]}") from None
        part = spark.read.option("header", True).schema(T.StructType(_in_order(wanted, header))).csv(row.files)
        parts.append(without_skipped_days(part, skipped) if skipped else part)
    if not parts:
        return spark.createDataFrame([], wanted)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _in_order(schema: T.StructType, header: list[str]) -> list[T.StructField]:
    known = {f.name: f for f in schema.fields}
    return [known.get(c, T.StructField(c, T.StringType())) for c in header]


def require_columns(columns: Iterable[str], required: Iterable[str] = ID_COLUMNS) -> None:
    missing = [c for c in required if c not in set(columns)]
    if missing:
        raise ValueError(f"missing required columns {missing}")


def without_skipped_days(df: DataFrame, skipped: list[str] = SKIPPED_DAY_FILES) -> DataFrame:
    """Leaves out whole files by name; needs a DataFrame read straight from files."""
    return df.filter(~F.col("_metadata.file_name").isin(skipped))


def project_model(df: DataFrame, model: str, attributes: dict[str, list[str]] = MODEL_ATTRIBUTES) -> DataFrame:
    """One model's rows and kept attributes; attributes the log lacks are left out."""
    require_columns(df.columns)
    kept = [c for c in attributes[model] if c in df.columns]
    return df.filter(F.col("model") == model).select(*ID_COLUMNS, *kept)


def project_models(df: DataFrame, models: Iterable[str], attributes: dict[str, list[str]] = MODEL_ATTRIBUTES) -> DataFrame:
    """The rows of several models in one pass; an attribute that a row's own model does not keep is null."""
    require_columns(df.columns)
    models = list(models)
    kept = [c for c in dict.fromkeys(c for m in models for c in attributes[m]) if c in df.columns]
    own = [F.when(F.col("model").isin([m for m in models if c in attributes[m]]), F.col(c)).alias(c) for c in kept]
    return df.filter(F.col("model").isin(models)).select(*ID_COLUMNS, *own)


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", parse_day(F.col("ds"))).drop("ds")


def write_model_logs(df: DataFrame, path: str, models: Iterable[str] = tuple(MODEL_ATTRIBUTES)) -> None:
    """All models in one pass, one folder per model and day; large days are split over several files by size."""
    known = df.filter(F.col("model").isin(list(models)))
    (known.hint("rebalance", "model", "ds").withColumn("day_file", F.col("ds"))
     .write.partitionBy("model", "day_file").option("header", True).csv(path))


def write_day_files(df: DataFrame, path: str) -> int:
    """One CSV per day, named ``<ds>.csv``; returns how many. Rows go through a task in the order of their days, so no day is held as a whole."""
    columns = df.columns
    place = columns.index("ds")

    def write(batches):
        store, inner = _store(path)
        store.create_dir(inner)
        now, file, days = None, None, []
        for batch in batches:
            ds = batch.column(place).to_numpy()
            cuts = [0, *((ds[1:] != ds[:-1]).nonzero()[0] + 1).tolist(), len(ds)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if ds[start] != now:
                    if file:
                        file.close()
                    now = ds[start]
                    days.append(int(now))
                    file = csv.CSVWriter(store.open_output_stream(f"{inner}/{now}.csv"), batch.schema)
                file.write(batch.slice(start, end - start))
        if file:
            file.close()
        yield pa.record_batch([pa.array(days, pa.int32())], ["ds"])

    known = df.filter("ds is not null")
    return known.repartition("ds").sortWithinPartitions("ds").mapInArrow(write, "ds int").count()


def rows_per_model(df: DataFrame, models: Iterable[str] = tuple(MODEL_ATTRIBUTES)) -> DataFrame:
    """Row count of every listed model, 0 for absent ones."""
    listed = df.sparkSession.createDataFrame([(m,) for m in models], "model string")
    counted = df.groupBy("model").agg(F.count("*").alias("n"))
    return listed.join(counted, "model", "left").select("model", F.coalesce("n", F.lit(0)).alias("n"))


def read_failure_tags(spark: SparkSession, path: str, prefix: str = "M") -> DataFrame:
    """Failure tags; their short model code (B1) is mapped to the log's model name (MB1)."""
    tags = spark.read.option("header", True).schema("model string, failure_time string, disk_id long").option(
        "enforceSchema", False).csv(path)
    return tags.withColumn("model", F.concat(F.lit(prefix), F.col("model")))


def profile(df: DataFrame) -> DataFrame:
    """Rows, devices, first and last day per model."""
    return df.groupBy("model").agg(
        F.count("*").alias("n_rows"), F.countDistinct("disk_id").alias("disks"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"))
