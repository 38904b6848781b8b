"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hashed order, are cut into blocks of ``block_bytes``. With weight w, block i of a source is
released at slot floor(i / w) and due at slot ceil((i + 1) / w); in every slot the released block with the earliest
deadline goes next. As the weights add up to one, no deadline is missed, so after any number of slots every source is
less than one block away from its share. Weights are whole numbers of units, so many that rounding
moves no source by a block before the first one has run out. The schedule repeats after as many slots
as there are units: it is drawn up once, and every block finds its slot from its
own number. When a source has run out, its slots stay empty and the others go on.

Positions in a source are prefix sums over a tree of hash prefixes with 256 children, so neither a source that holds a
third of all rows nor any other group is sorted or summed in one task.

Null sources are one source of their own, null texts count as empty, and each document counts one byte more than its
text, so empty ones have a place. Ties in the hashed order (rows equal in identifier and text) are broken by identifier;
fully equal rows may swap places. An empty table gives an empty table. Very long documents take their place in the block
where they begin. Other columns pass through, but for those named like an output column.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More sources than this are refused: the schedule of one period is drawn up on the driver.
MAX_SOURCES = 10_000
#: Rows that a group of equal hash prefixes should hold.
GROUP_ROWS = 4_000
ADDED = ("block", "release", "deadline", "slot", "on_target")


def targets(totals: DataFrame, weights: dict[str | None, float] | None, power: float) -> DataFrame:
    """Adds ``wanted``, a source's weight; sources without a weight share equally the least given one.

    Without ``weights`` a source's target follows the ``power``-th power of its bytes.
    """
    if weights is None:
        wanted: Column = F.pow(F.col("total").cast("double"), F.lit(power))
    else:
        wanted = F.lit(min(weights.values()))
        for name, w in weights.items():
            wanted = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(wanted)
    return totals.withColumn("wanted", wanted)


def whole_units(wanted: list[float], blocks: list[int], least: int) -> list[int]:
    """Targets in whole units, one at least: ``least`` units in all, doubled until no source is a block away from its true target
    by rounding when the first one runs out.
    """
    whole = sum(wanted)
    shares = [w / whole if whole else 1 / len(wanted) for w in wanted]
    last = min((b / s for b, s in zip(blocks, shares) if s), default=0)
    units = least
    while True:
        out = [max(1, int(Decimal(repr(s * units)).quantize(Decimal(1), ROUND_HALF_UP))) for s in shares]
        period = sum(out)
        if all(abs(u / period - s) * last < 1 for u, s in zip(out, shares)):
            return out
        units *= 2


def one_period(units: list[int]) -> list[list[int]]:
    """The slots of the blocks of each source within a period: of the released blocks the one with the earliest deadline goes next."""
    period, slots = sum(units), [[] for _ in units]
    waiting, due = [(0, j) for j in range(len(units))], []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            j = heappop(waiting)[1]
            heappush(due, (-(-(len(slots[j]) + 1) * period // units[j]), j))
        j = heappop(due)[1]
        slots[j].append(slot)
        if len(slots[j]) < units[j]:
            heappush(waiting, (len(slots[j]) * period // units[j], j))
    return slots


def starts(rows: DataFrame, count: int) -> DataFrame:
    """Adds ``start``: bytes of the same source before this row, in the order of ``hashed``."""
    levels = max(1, math.ceil(math.log(max(2, count / GROUP_ROWS), 256)))
    prefix = [F.substring("hashed", 1, 2 * k) for k in range(levels + 1)]
    sums = rows.groupBy("source_key", prefix[levels].alias("prefix")).agg(F.sum("size").alias("size"))
    offsets = None
    for k in range(1, levels + 1):
        at = sums.groupBy("source_key", F.substring("prefix", 1, 2 * k).alias("prefix")).agg(F.sum("size").alias("size"))
        above = F.substring("prefix", 1, 2 * k - 2)
        within = F.sum("size").over(Window.partitionBy("source_key", above).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
        at = at.select("source_key", "prefix", above.alias("above"), F.coalesce(within, F.lit(0)).alias("before"))
        if offsets is not None:
            upper = offsets.select("source_key", F.col("prefix").alias("above"), F.col("before").alias("upper"))
            at = at.join(upper, ["source_key", "above"]).withColumn("before", F.col("before") + F.col("upper"))
        offsets = at.select("source_key", "prefix", "before")
    own = Window.partitionBy("source_key", "prefix").orderBy("hashed", "order_id")
    inside = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = rows.withColumn("prefix", prefix[levels]).withColumn("inside", inside)
    return inside.join(offsets, ["source_key", "prefix"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "prefix")


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block_bytes: int = 1 << 18, units: int = 1000,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Each row with ``block`` (number in its source), ``release``, ``deadline``, ``slot`` and ``on_target``.

    Reading by ``slot`` gives the mix. ``units`` is the least number of units that weights are rounded to. ``on_target`` holds up to the first slot whose source has run out.
    """
    own = [c for c in docs.columns if c not in ADDED]
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)],  # flat, so that columns nobody asks for are not shuffled
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("source_key"),
        source.alias("source"),
        F.col(f"`{id_col}`").alias("order_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(f"`{text_col}`")), F.lit("")))).alias("hashed"),
    )
    totals = rows.groupBy("source_key", "source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows"))
    listed = targets(totals, weights, power).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed.sort(key=lambda r: r["source_key"].encode("utf-8", "surrogatepass"))
    blocks = [-(-r["total"] // block_bytes) for r in listed]
    own_units = whole_units([r["wanted"] for r in listed], blocks, units) if listed else []
    slots, whole = one_period(own_units), sum(own_units)
    first_empty = min((b // u * whole + at[b % u] for b, u, at in zip(blocks, own_units, slots)), default=None)
    spark, keys = docs.sparkSession, [r["source_key"] for r in listed]
    shares = spark.createDataFrame(pa.table({"source_key": pa.array(keys, pa.string()), "units": pa.array(own_units, pa.int64())}))
    shares = shares.withColumn("period", F.lit(whole).cast("bigint"))
    flat = [(k, n, slot) for k, at in zip(keys, slots) for n, slot in enumerate(at)]
    kinds = (("source_key", pa.string()), ("nth", pa.int64()), ("slot", pa.int64()))
    period = spark.createDataFrame(pa.table({name: pa.array([x[k] for x in flat], kind) for k, (name, kind) in enumerate(kinds)}))

    placed = starts(rows, sum(r["rows"] for r in listed)).withColumn("block", F.floor(F.col("start") / block_bytes).cast("bigint"))
    placed = placed.join(F.broadcast(shares), "source_key")  # MAX_SOURCES rows at most
    placed = placed.withColumn("nth", F.col("block") % F.col("units"))
    placed = placed.join(period, ["source_key", "nth"])
    turn = F.floor(F.col("block") / F.col("units")).cast("bigint") * F.col("period")
    placed = placed.withColumn("slot", turn + F.col("slot"))
    out = placed.withColumn("first_empty", F.lit(first_empty).cast("bigint"))
    return out.select(
        *[F.col(f"own_{k}").alias(c) for k, c in enumerate(own)],
        "block",
        F.floor(F.col("block") * F.col("period") / F.col("units")).cast("bigint").alias("release"),
        F.ceil((F.col("block") + 1) * F.col("period") / F.col("units")).cast("bigint").alias("deadline"),
        "slot",
        (F.col("slot") < F.col("first_empty")).alias("on_target"),
    )


def in_mixed_order(docs: DataFrame, **settings) -> DataFrame:
    """All rows with the columns they came with, laid out by slot: partitions, and rows in them, follow the schedule."""
    mixed = mix_sources(docs.select("*"), **settings)
    key = settings.get("id_col", "doc_id")
    tie = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    laid = mixed.repartitionByRange("slot", tie).sortWithinPartitions("slot", tie)
    return laid.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
