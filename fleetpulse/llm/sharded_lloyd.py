"""Exact k-means with the dimensions of the vectors cut into shards.

Vectors become whole numbers and are packed into chunks of rows; each chunk is cut into blocks of columns. A shard
holds blocks of one range of columns and needs no more of the centroids than its slice. In a round, every block gives the exact partial squared distances
of its rows to each centroid's slice; ``reduceByKey`` adds the blocks of a chunk and takes the nearest centroid; the
choices go back to the shards, and each shard sums its columns per centroid and updates its own slice.

On Spark: blocks are dealt to their shards once, so rounds shuffle a few bytes a vector (partial distances in the shortest whole numbers
that hold them, then one choice) and never the vectors. The driver holds the centroids (clusters times dimensions). Blocks are read
from a written table, and a round's centroids are values, so a lost executor repeats no earlier round.

Kept are vectors of the stated length without null or non-finite components. The first centroids are those kept
vectors whose identifiers (null: empty) have the least hashes, ties by components; with fewer vectors than clusters all of them. Equal
distances go to the smaller number; an empty cluster keeps its centroid; repeated rows count one by one. No kept vector: an empty table. A kept component beyond 2^27 in
size after scaling is an error, as squared distances would leave 64 bits. Only the identifier is taken along, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import importable, materialize

LARGEST = 1 << 27


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(scale * values.astype(np.float64))
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a scaled component is not below {LARGEST}")
    return out.astype(np.int32)


def pack(batches: Iterator[pa.RecordBatch], dims: int, width: int, scale: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (chunk, block, cells, ids): a chunk's rows as 32-bit numbers, cut by columns; the ids are with block 0."""
    first = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            cells = whole(piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
            blocks = [np.ascontiguousarray(cells[:, k : k + width]).tobytes() for k in range(0, dims, width)]
            ids = pa.array([piece.column(0).to_pylist()] + [None] * (len(blocks) - 1), pa.list_(batch.schema.field(0).type))
            columns = [pa.array([first] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary()), ids]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "block", "cells", "ids"])
            first += 1


def complete(vector: Column, dims: int) -> Column:
    """The vector has the stated length and finite components alone."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(F.size(vector) == dims, F.lit(False)) & F.coalesce(finite, F.lit(False))


def partial_distances(cells: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to each centroid, over one block's columns."""
    out = np.stack([np.square(cells - c).sum(axis=1) for c in piece], axis=1)
    return out.astype(np.min_scalar_type(int(out.max(initial=0))))


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) + b


def nearest(distances: np.ndarray) -> np.ndarray:
    return distances.argmin(axis=1).astype(np.min_scalar_type(distances.shape[1]))  # of equal ones the first


def sums_of(cells: np.ndarray, choice: np.ndarray, clusters: int) -> np.ndarray:
    """Per centroid the sums of its rows' columns, and their number in the last column."""
    out = np.zeros((clusters, cells.shape[1] + 1), np.int64)
    for k in range(clusters):
        mine = cells[choice == k]
        out[k, :-1], out[k, -1] = mine.sum(axis=0), len(mine)
    return out


def moved(sums: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A shard's new slice: exact floors of the means; an empty cluster's stays."""
    number = sums[:, -1:]
    return np.where(number > 0, sums[:, :-1] // np.maximum(number, 1), piece)


class Shards:
    """Blocks of all vectors, dealt out by range of columns and chunk."""

    def __init__(self, packed: DataFrame, dims: int, width: int, per_shard: int):
        self.width, self.blocks = width, -(-dims // width)
        chunks = packed.filter("block = 0").count()
        self.groups = groups = max(1, -(-chunks // per_shard))
        self.number = self.blocks * groups

        def shard_of(key: tuple[int, int]) -> int:
            return key[0] * groups + (key[1] ^ key[1] >> 32) % groups

        def chunk_of(key: int) -> int:
            return (key ^ key >> 32) * 0x9E3779B1

        self.shard_of, self.chunk_of = shard_of, chunk_of  # the same functions each time, so that Spark knows the partitioning
        dims_of = [min(width, dims - k * width) for k in range(self.blocks)]
        pairs = packed.select("block", "chunk", "cells").rdd.map(lambda r: ((r[0], r[1]), np.frombuffer(r[2], np.int32).reshape(-1, dims_of[r[0]]).astype(np.int64)))
        self.cells: RDD = pairs.partitionBy(self.number, shard_of)

    def slice_of(self, centroids: np.ndarray, block: int) -> np.ndarray:
        return centroids[:, block * self.width : (block + 1) * self.width]

    def distances(self, centroids: np.ndarray) -> RDD:
        """(chunk, distances of its rows to each centroid)."""
        slices = [self.slice_of(centroids, k) for k in range(self.blocks)]
        partial = self.cells.map(lambda kv: (kv[0][1], partial_distances(kv[1], slices[kv[0][0]])))
        return partial.reduceByKey(added, self.number, self.chunk_of)

    def update(self, centroids: np.ndarray) -> np.ndarray:
        blocks, clusters = self.blocks, len(centroids)
        slices = [self.slice_of(centroids, k) for k in range(blocks)]
        choices = self.distances(centroids).mapValues(nearest)
        back = choices.flatMap(lambda kv: [((k, kv[0]), kv[1]) for k in range(blocks)]).partitionBy(self.number, self.shard_of)
        met = self.cells.union(back).groupByKey(self.number, self.shard_of)  # dealt alike, so the cells stay where they are

        def summed(kv: tuple) -> tuple[int, np.ndarray]:
            choice, cells = sorted(kv[1], key=np.ndim)
            return kv[0][0], sums_of(cells, choice, clusters)

        sums = met.map(summed).reduceByKey(np.add, blocks)
        found = dict(sums.map(lambda kv: (kv[0], moved(kv[1], slices[kv[0]]))).collect())  # the centroids
        return np.concatenate([found[k] for k in range(blocks)], axis=1)


def unpack(batches: Iterator[pa.RecordBatch], inertia: np.ndarray, digests: list[str]) -> Iterator[pa.RecordBatch]:
    """(ids, clusters, distances) of a chunk to a row for each vector."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids = batch.column(0).slice(k, 1).flatten()
            cluster = np.frombuffer(batch.column(1)[k].as_py(), np.int32)
            distance = np.frombuffer(batch.column(2)[k].as_py(), np.int64)
            columns = [ids, pa.array(cluster), pa.array(distance), pa.array(inertia[cluster]), pa.array(np.full(len(ids), inertia.sum()))]
            columns.append(pa.DictionaryArray.from_arrays(pa.array(cluster), pa.array(digests)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])


def cluster_vectors(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, width: int = 16,
    chunk_rows: int = 4096, per_shard: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: ``id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    ``width`` is the number of columns of a block, ``chunk_rows`` of rows, and ``per_shard`` the most blocks of a shard.
    """
    spark = vectors.sparkSession
    rows = importable(vectors).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.filter(complete(F.col("vector"), dims))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"chunk long, block int, cells binary, ids array<{kind}>"
    packed = materialize(rows.mapInArrow(lambda it: pack(it, dims, width, scale, chunk_rows), schema), "vector-blocks")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(drawn, "vector").limit(clusters).select("vector").collect()
    result = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids = whole(np.array([r[0] for r in first], np.float64), scale).astype(np.int64)
    shards = Shards(packed, dims, width, per_shard)
    for _ in range(rounds):
        centroids = shards.update(centroids)

    def chosen(distances: np.ndarray) -> tuple[bytes, bytes]:
        cluster = distances.argmin(axis=1)
        return cluster.astype(np.int32).tobytes(), distances[np.arange(len(cluster)), cluster].astype(np.int64).tobytes()

    done = shards.distances(centroids).mapValues(chosen).map(lambda kv: (kv[0], bytearray(kv[1][0]), bytearray(kv[1][1])))
    done = materialize(spark.createDataFrame(done, "chunk long, clusters binary, distances binary"), "vector-clusters")
    number = len(centroids)

    def inertias(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(number, np.int64)
        for batch in batches:
            for cluster, distance in zip(*(c.to_pylist() for c in batch.columns)):
                np.add.at(total, np.frombuffer(cluster, np.int32), np.frombuffer(distance, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(number), pa.int32()), pa.array(total)], names=["cluster", "total"])

    found = done.select("clusters", "distances").mapInArrow(inertias, "cluster int, total long").groupBy("cluster").agg(F.sum("total").alias("total"))
    inertia = np.zeros(number, np.int64)
    for r in found.collect():
        inertia[r["cluster"]] = r["total"]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    ids = packed.filter("block = 0").select("chunk", "ids")
    return ids.join(done, "chunk").select("ids", "clusters", "distances").mapInArrow(lambda it: unpack(it, inertia, digests), result)
