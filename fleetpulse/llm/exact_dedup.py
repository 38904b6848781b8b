"""Exact duplicates by stateful streaming: disk-backed keyed state, and a check of full bytes on every hit.

A streaming job reads the digests of all documents and keeps, for each digest and without expiry, how many rows have it
and which row stays: the one with the largest identifier, with its content locator (file and row in it). The state lives
in an embedded store on the executors' disks, is checkpointed in the shared folder and read back as a table. It is
updated by partial sums, so a text that a third of all rows share is one row a task. Then the whole texts of the rows
that hit a digest seen elsewhere are compared; should texts of one digest differ, each forms a group of its own.

Null texts count as empty, and empty texts are equal to each other. Null identifiers are the smallest; of rows with equal
identifiers the one with the largest locator stays, so repeated rows keep exactly one. An empty table gives an empty
table. Only digests are kept of long texts, but for those that occur more than once. Extra columns never meet internal
ones: decisions carry their own columns, joined by locator.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.common import free_name, materialize, scratch_dir

# State on disk, in bounded memory, and without disk space reserved ahead for each of many small stores.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their place (file and row in the file) in one more column, and that column's name, which no other has.

    Tables that aren't read from Parquet are written first.
    """
    name = free_name(docs.columns, "__place")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("hidden by a column of that name")
        return docs.select("*", place.alias(name)), name
    except AnalysisException:
        hidden = free_name(docs.columns, "__metadata")
        plain = docs.withColumnRenamed("_metadata", hidden)
        return materialize(plain, "located").select("*", place.alias(name)).withColumnRenamed(hidden, "_metadata"), name


def keyed_state(spark: SparkSession, records: str, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs the stream over the digests in ``records`` to its end; per digest the row that stays and the number of rows."""
    schema = spark.read.parquet(records).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    kept = reader.parquet(records).groupBy("digest").agg(F.max(F.struct("id", "place")).alias("stays"), F.count(F.lit(1)).alias("copies"))
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        stream = (
            kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
        )
        stream.awaitTermination()
        return spark.read.format("statestore").load(folder).select("key.digest", F.col("value.max").alias("stays"), F.col("value.count").alias("copies"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_letters: int = 64, files_per_batch: int | None = None, place_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``place``, ``id``, ``digest`` (hex), ``keep_id``, ``group_size``, ``kept``.

    ``digest_letters`` below 64 shortens the digest; the result stays the same, as differing texts are told apart by their bytes.
    ``place_col`` names the places of rows that are located already.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "exact-dedup")
    content = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs, place = (docs, place_col) if place_col else located(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{place}`").alias("place"), content.alias("content"))
    full = F.sha2("content", 256)
    short: Column = F.substring(full, 1, digest_letters) if digest_letters < 64 else full
    digest = F.unhex(short)

    rows.select("id", "place", digest.alias("digest"), *([F.unhex(full).alias("whole")] if digest_letters < 64 else [])).write.parquet(f"{folder}/digests")
    records = spark.read.parquet(f"{folder}/digests")
    whole = F.lower(F.hex("whole" if digest_letters < 64 else "digest"))
    if records.isEmpty():
        groups = records.select("digest", F.struct("id", "place").alias("stays"), F.lit(0).cast("bigint").alias("copies"))
    else:
        groups = keyed_state(spark, f"{folder}/digests", f"{folder}/state", files_per_batch)
    groups = _stored(groups, f"{folder}/groups")

    repeated = groups.filter("copies > 1").select("digest")
    hits = rows.select(digest.alias("digest"), "id", "place", "content").join(repeated.hint("shuffle_hash"), "digest", "left_semi")
    hits = _stored(hits, f"{folder}/hits")
    texts = hits.groupBy("digest", "content").agg(F.max(F.struct("id", "place")).alias("stays"), F.count(F.lit(1)).alias("copies"))
    differ = _stored(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), f"{folder}/differ")

    decided = records.join(groups, "digest")
    if not differ.isEmpty():
        apart = hits.join(differ, "digest", "left_semi").join(texts, ["digest", "content"])
        apart = apart.select("place", F.col("stays").alias("own_stays"), F.col("copies").alias("own_copies"))
        decided = decided.join(apart, "place", "left").withColumns({"stays": F.coalesce("own_stays", "stays"), "copies": F.coalesce("own_copies", "copies")})
    return decided.select(
        "place", "id", whole.alias("digest"), F.col("stays.id").alias("keep_id"), F.col("copies").alias("group_size"),
        (F.col("place") == F.col("stays.place")).alias("kept"),
    )


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    rows, place = located(docs)
    dropped = exact_dedup(rows, id_col, text_col, place_col=place).filter("not kept").select(F.col("place").alias(place))
    return rows.join(dropped, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
