"""Fills and row windows over series of any length.

Some series are not bounded by the calendar (raw readings, an id shared by many devices). A
series is cut into chunks of consecutive rows; chunks carry what they need from their
predecessors, so a series that holds a third of all rows is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetpulse.operators.ranking import _join_null_safe, range_buckets


def number_rows(df: DataFrame, keys: list[str], order: list[str], block: str, out: str = "rn") -> DataFrame:
    """0-based row number within a series; ``block`` is any column that grows with the order."""
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, block).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    )
    joined = _join_null_safe(df, offsets, keys, block)
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    return joined.withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


def fill_long(df: DataFrame, keys: list[str], order: list[str], block: str, features: list[str]) -> DataFrame:
    """Forward fill, then head fill, block by block with the last known value carried over."""
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(inside) for c in features})
    sort_key = F.struct(*order)
    ends = df.groupBy(*keys, block).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), sort_key)).alias(f"_l_{c}") for c in features],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), sort_key)).alias(f"_s_{c}") for c in features])
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = ends.select(
        *keys, block,
        *[F.last(f"_l_{c}", ignorenulls=True).over(ahead).alias(f"_c_{c}") for c in features],
        *[F.first(f"_s_{c}", ignorenulls=True).over(whole).alias(f"_h_{c}") for c in features])
    joined = _join_null_safe(filled, carry, keys, block)
    return joined.select(*[
        F.coalesce(F.col(f"_f_{c}"), F.col(f"_c_{c}"), F.col(f"_h_{c}")).alias(c) if c in features else F.col(c)
        for c in df.columns])


def chunk_with_halo(df: DataFrame, halo: int, chunk_rows: int, rn: str = "rn") -> DataFrame:
    """Adds ``chunk`` and ``is_halo``: the last ``halo`` rows of a chunk are copied into the next one."""
    if halo >= chunk_rows:
        raise ValueError("a chunk must be longer than the halo")
    own = F.struct(F.floor(F.col(rn) / chunk_rows).alias("chunk"), F.lit(False).alias("is_halo"))
    copy = F.struct((F.floor(F.col(rn) / chunk_rows) + 1).alias("chunk"), F.lit(True).alias("is_halo"))
    needed = F.col(rn) % chunk_rows >= chunk_rows - halo
    places = F.when(needed, F.array(own, copy)).otherwise(F.array(own))
    return df.withColumn("_c", F.explode(places)).select("*", "_c.chunk", "_c.is_halo").drop("_c")


def row_windows_long(df: DataFrame, keys: list[str], features: list[str], size: int, rn: str = "rn",
                     chunk_rows: int = 4096) -> DataFrame:
    """The row windows of ``operators.windows`` for numbered series of any length."""
    chunks = chunk_with_halo(df, size - 1, max(chunk_rows, size), rn)
    frame = Window.partitionBy(*keys, "chunk").orderBy(rn).rowsBetween(-(size - 1), 0)
    arrays = chunks.withColumns({c: F.collect_list(c).over(frame) for c in features})
    return arrays.filter(~F.col("is_halo") & (F.col(rn) >= size - 1)).drop("chunk", "is_halo")


def time_blocks(df: DataFrame, keys: list[str], value: str, blocks: int = 64, out: str = "block") -> DataFrame:
    """Blocks of a series by its own time cuts, so that a long series has many and a short one few."""
    return range_buckets(df, keys, value, blocks, out)
