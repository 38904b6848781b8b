"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, with u hashed from the row's key
and the child's path, and the least draw wins, so a child is chosen in proportion to its weight. A change of weights
moves rows only into subtrees that gained and out of subtrees that lost weight; all others keep theirs. A shard that
joins as a subtree of its own takes rows only into itself.

Slots number the rows of a shard without gaps, in the order of (checksum, content hash, key), which keeps equal texts
of a shard together. Rows are range partitioned in that order and numbered by partition offsets, so neither a shard nor a
group of equal texts is sorted in one task.

Null keys all go one way, like equal keys do; null texts have no bytes and the checksum of an empty text. Fully equal rows get
slots next to each other. An empty table gives an empty table. Other input columns pass through, but for those named like
an output column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import materialize

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Node:
    """A region, rack or shard: its name, its children, and for shards their number and weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree_of(shards: int, settled: int = 8, racks: int = 2, per_rack: int = 2) -> Node:
    """The first ``settled`` shards in regions of ``racks`` times ``per_rack``; each later one is a region of its own."""
    regions, base = [], min(shards, settled)
    for r in range(math.ceil(base / (racks * per_rack))):
        own = []
        for k in range(racks):
            first = (r * racks + k) * per_rack
            leaves = tuple(Node(f"s{s}", shard=s) for s in range(first, min(first + per_rack, base)))
            if leaves:
                own.append(Node(f"k{k}", leaves))
        regions.append(Node(f"r{r}", tuple(own)))
    regions += [Node(f"g{s}", (Node("k0", (Node(f"s{s}", shard=s),)),)) for s in range(base, shards)]
    return Node("root", tuple(regions))


def draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 53 bits of the hash of path and key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))


def shard_of(key: Column, node: Node, path: str = "") -> Column:
    """The shard that a key reaches from a node, as one expression."""
    if not node.children:
        return F.lit(node.shard)
    here = f"{path}/{node.name}"
    alive = [c for c in node.children if c.weight > 0]
    if len(alive) == 1:
        return shard_of(key, alive[0], here)
    draws = F.array(*[F.struct(draw(key, f"{here}/{c.name}", c.weight).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(alive)])
    first = F.array_min(draws)["k"]
    out = shard_of(key, alive[-1], here)
    for k in range(len(alive) - 2, -1, -1):
        out = F.when(first == k, shard_of(key, alive[k], here)).otherwise(out)
    return out


def number_rows(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: gapless numbers from 0 within each group, along ``order``, by range partitions and their offsets."""
    laid = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    place = F.monotonically_increasing_id()
    laid = materialize(laid.withColumns({"__part": F.shiftright(place, 33), "__row": place.bitwiseAND((1 << 33) - 1)}), "numbered")
    parts = laid.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__add"))
    out = laid.join(parts, [group, "__part"]).withColumn(name, (F.col("__row") + F.col("__add")).cast("bigint"))
    return out.select(*df.columns, name)


def assign_shards(
    docs: DataFrame, shards: int = 8, tree: Node | None = None, grown: Node | None = None, key_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each row without its text, with ``size``, ``text_crc32``, ``law`` (key), ``shard``, ``slot`` and ``grown_shard`` (one shard more)."""
    tree, grown = tree or tree_of(shards), grown or tree_of(shards + 1)
    keep = [c for c in docs.columns if c != text_col and c not in ADDED]
    key, text = F.col(f"`{key_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        key.alias("key"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown).alias("grown_shard"),
    )
    done = number_rows(rows, "shard", ["text_crc32", "content", "key"], "slot")
    return done.select(*[F.col("row")[c].alias(c) for c in keep], "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, **settings) -> None:
    """Writes the rows to one folder a shard, spread over several files where a shard is large."""
    key = F.col(f"`{settings.get('key_col', 'doc_id')}`").cast("string")
    tree = settings.get("tree") or tree_of(settings.get("shards", 8))
    docs.withColumn("shard", shard_of(key, tree)).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
