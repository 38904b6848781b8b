"""New daily log files to per-model folders as they arrive: the batch scan and its rules, run once per new file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.fixed_values import MODEL_ATTRIBUTES, SKIPPED_DAY_FILES
from fleetpulse.sources.daily_logs import ID_COLUMNS, log_schema, read_daily_logs

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """Paths of new log files; their content is not read."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(directory).select("path")


def kept_attributes(logs: DataFrame, attributes: dict[str, list[str]] = MODEL_ATTRIBUTES) -> DataFrame:
    """Rows of the listed models; an attribute that a model does not keep is null there."""
    every = sorted({a for kept in attributes.values() for a in kept} & set(logs.columns))
    known = logs.filter(F.col("model").isin(list(attributes)))
    return known.select(*ID_COLUMNS, *[F.when(F.col("model").isin([m for m, kept in attributes.items() if a in kept]), F.col(a)).alias(a) for a in every])


def ingest(spark: SparkSession, directory: str, out: str, checkpoint: str, schema: T.StructType | None = None, skipped: list[str] = SKIPPED_DAY_FILES,
           files_per_batch: int = 1000) -> StreamingQuery:
    """Processes every file not seen yet and stops; the checkpoint makes each file count once.

    A batch's files are read as the batch reader does: each by its own header, skipped days left out, a file without an id column an error. The
    driver holds the paths of one batch. A batch goes to a folder of its own number and replaces it when it runs again; below it are
    one folder per model and day.
    """

    def write(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]  # files_per_batch at most
        if paths:
            logs = kept_attributes(read_daily_logs(spark, paths, schema or log_schema(), skipped)).withColumn("day_file", F.col("ds"))
            logs.hint("rebalance", "model", "ds").write.mode("overwrite").partitionBy("model", "day_file").parquet(f"{out}/batch={number}")

    files = stream_files(spark, directory, files_per_batch)
    return files.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
