"""Exact ranks, running totals and quantiles without putting a group into one task.

A ``row_number`` or a cumulative sum over a whole class sends that class to one task. Here a
group is first cut into ordered buckets; the buckets' totals are small and give each bucket its
offset, and only the inside of a bucket is sorted by a window. The result is the same number the
plain window would give.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetpulse.operators.grouped import beside
from fleetpulse.session import materialize

HASH_DIGITS = 3  # 16**3 buckets per group, so a bucket holds about 1/4096 of it
BUCKET_ROWS = 1_000_000  # rows that one task sorts, in the largest group at most
SKETCH = 2_000  # ranks in a quantile sketch are off by a part in so many at most
GRID = 64  # parts of equal size that cuts make, besides those around the wanted ranks


def order_hash(keys: list[str], seed: int) -> Column:
    """md5 of seed and key: a repeatable uniform order that any SQL engine can replay."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def bucketed_rank(df: DataFrame, by: list[str], bucket: str, order: list[Column], out: str = "rank",
                  limit: Column | None = None) -> DataFrame:
    """1-based rank of every row in its group, for buckets that follow the order.

    With ``limit`` only ranks up to it are kept, and buckets past it are dropped before the sort.
    """
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*by, bucket).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    )
    # stored, so that the planner joins them by their size; else all rows are shuffled before the buckets past the limit are dropped
    rows = _join_null_safe(df, materialize(offsets, "offsets"), by, bucket)
    if limit is not None:
        rows = rows.filter(F.col("_before") < limit)
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    ranked = rows.withColumn(out, F.col("_before") + F.row_number().over(inside)).drop("_before")
    return ranked.filter(F.col(out) <= limit) if limit is not None else ranked


def _join_null_safe(df: DataFrame, small: DataFrame, by: list[str], bucket: str) -> DataFrame:
    keys = by + [bucket]
    renamed = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           *[c for c in small.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    return df.join(renamed, cond, "inner").drop(*[f"_k{i}" for i in range(len(keys))])


def hash_rank(df: DataFrame, by: list[str], keys: list[str], seed: int, out: str = "rank",
              limit: Column | None = None) -> DataFrame:
    """Rank of every row in its group in md5 order; group sizes do not limit it."""
    hashed = df.withColumn("_h", order_hash(keys, seed)).withColumn("_hb", F.substring("_h", 1, HASH_DIGITS))
    ranked = bucketed_rank(hashed, by, "_hb", [F.col("_h"), *[F.col(k) for k in keys]], out, limit)
    return ranked.drop("_h", "_hb")


def range_buckets(df: DataFrame, by: list[str], value: str, buckets: int, out: str = "_bucket") -> DataFrame:
    """Number of cut points below the value; the cuts are a sketch of fixed size per group."""
    count = buckets - 1
    if count < 1:
        return df.withColumn(out, F.lit(0))
    probs = [i / buckets for i in range(1, buckets)]
    # stored, so that the planner joins them by their size and does not move ``df`` to its group's task for a few cuts
    cuts = materialize(df.groupBy(*by).agg(F.percentile_approx(value, probs, 100 * buckets).alias("_cuts")), "cuts")
    joined = df.join(cuts, by)
    return with_cuts_below(joined, "_cuts", value, count, out).drop("_cuts")


def with_cuts_below(df: DataFrame, cuts: str, value: str, most: int, out: str) -> DataFrame:
    """Adds how many of the sorted ``cuts``, ``most`` at most, lie below the value.

    The search is halved, one projection a step: generated code on plain numbers, where a fold over an array is interpreted.
    """
    found = df.withColumn(out, F.lit(0))
    for i in reversed(range(most.bit_length())):
        at = F.col(out) + (1 << i)
        found = found.withColumn(out, F.when((at <= F.size(cuts)) & (F.get(F.col(cuts), at - 1) < F.col(value)), at).otherwise(F.col(out)))
    return found


def _stored_buckets(df: DataFrame, by: list[str], value: str, buckets: int | None) -> DataFrame:
    """``df`` written once and cut into as many buckets as its rows ask for (its count comes from the files' footers)."""
    stored = materialize(df, "counted-values")
    return range_buckets(stored, by, value, buckets or math.ceil(stored.count() / BUCKET_ROWS))


def running_totals(df: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` for each summed column, up to and including the row, in value order.

    ``df`` holds one row per (group, value): collapse equal values before, which also removes skew.
    """
    rows = _stored_buckets(df, by, value, buckets)
    step = F.desc if descending else F.asc
    ahead = Window.partitionBy(*by).orderBy(step("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*by, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_bucket").orderBy(step(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_null_safe(rows, offsets, by, "_bucket")
    return out.select(*df.columns, *[(F.col(f"_b_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums])


def narrowed(rows: DataFrame, held: DataFrame, keys: list[str], probs: list[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the search for ranks: every value is placed between cuts from a sketch and only counted.

    ``rows`` has keys, ``_at``, ``_v`` and ``_n``; ``held`` has keys, ``_at``, ``_rank`` and ``_left``, the wanted rank among the rows of ``_at``. Gives the
    ranks found (those of values that equal a cut), and rows and ranks that lie strictly between two cuts.
    """
    at = [*keys, "_at"]
    near = [x for p in probs for x in (p - 2 / SKETCH, p + 2 / SKETCH)]
    grid = sorted({*(k / GRID for k in range(1, GRID)), *(min(1.0, max(0.0, x)) for x in near)})
    # stored, so that the planner joins them by their size
    cuts = materialize(rows.groupBy(*at).agg(F.array_distinct(F.percentile_approx("_v", grid, SKETCH)).alias("_cuts")), "cuts")
    placed = with_cuts_below(beside(rows, cuts, at), "_cuts", "_v", len(grid), "_below")
    equal = F.coalesce(F.get("_cuts", F.col("_below")) == F.col("_v"), F.lit(False))
    placed = placed.withColumn("_slot", 2 * F.col("_below") + equal.cast("int")).drop("_cuts", "_below")

    sums = placed.groupBy(*at, "_slot").agg(F.sum("_n").alias("_in"), F.min("_v").alias("_v"))
    ahead = Window.partitionBy(*at).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_in").over(ahead), F.lit(0)))
    hits = beside(held, sums, at).filter((F.col("_start") <= F.col("_left")) & (F.col("_left") < F.col("_start") + F.col("_in")))
    hits = materialize(hits.withColumn("_left", F.col("_left") - F.col("_start")).drop("_start", "_in"), "hits")

    deeper = F.concat("_at", F.lit("."), F.col("_slot").cast("string")).alias("_at")
    between = hits.filter("_slot % 2 = 0")
    kept = beside(placed, materialize(between.select(*at, "_slot").distinct(), "between-cuts"), [*at, "_slot"])
    kept = materialize(kept.select(*keys, deeper, "_v", "_n"), "between")
    return hits.filter("_slot % 2 = 1").select(*keys, "_rank", "_v"), kept, between.select(*keys, deeper, "_rank", "_left")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], weight: str | None = None,
                    most_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation: columns by, ``q``, ``quantile``.

    The rows of a group are not sorted: a sketch gives cuts around the wanted ranks, a pass counts the rows between cuts, and only the rows between the
    two cuts around a rank go on, again and again until ``most_rows`` of them at most are sorted by value. Sketches and counts are combined before they are
    shuffled, and a value that many rows hold is a cut, so it is counted and never moved. ``weight`` is an integer multiplicity of the row; rows without
    a positive one and nulls are ignored. A null group is a group; a group without a value gives no row.
    """
    keys = by or ["_g"]
    w = (F.col(weight) if weight else F.lit(1)).cast("long")
    known = df if by else df.withColumn("_g", F.lit(0))
    stored = materialize(known.select(*keys, F.col(value).alias("_v"), w.alias("_n")).filter("_v is not null and _n > 0"), "values")
    totals = materialize(stored.groupBy(*keys).agg(F.sum("_n").alias("_total")), "totals")
    points = totals.select(*keys, F.explode(F.array(*[F.lit(float(p)) for p in dict.fromkeys(probs)])).alias("q"), (F.col("_total") - 1).alias("_last"))
    points = points.select(*keys, "q", (F.col("q") * F.col("_last")).alias("_pos"))
    ends = F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))
    held = points.select(*keys, F.explode(ends).alias("_rank")).distinct().select(*keys, F.lit("").alias("_at"), "_rank", F.col("_rank").alias("_left"))
    rows, found, few = stored.withColumn("_at", F.lit("")), [], []
    at = [*keys, "_at"]
    while True:
        sizes = materialize(rows.groupBy(*at).agg((F.count(F.lit(1)) > most_rows).alias("_many")), "sizes")
        largest = sizes.agg(F.max("_many")).first()[0]
        if not largest:
            few.append((rows, held))
            break
        rows, held = beside(rows, sizes, at), beside(held, sizes, at)
        few.append((rows.filter("not _many").drop("_many"), held.filter("not _many").drop("_many")))
        done, rows, held = narrowed(rows.filter("_many").drop("_many"), held.filter("_many").drop("_many"), keys, probs)
        found.append(done)
    for own, wanted in few:
        counts = own.groupBy(*at, "_v").agg(F.sum("_n").alias("_n"))
        inside = Window.partitionBy(*at).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_end", F.sum("_n").over(inside))
        hit = beside(wanted, counts, at).filter((F.col("_end") - F.col("_n") <= F.col("_left")) & (F.col("_left") < F.col("_end")))
        found.append(hit.select(*keys, "_rank", "_v"))
    picked = reduce(DataFrame.unionByName, found)
    each = beside(points, picked, keys).groupBy(*keys, "q").agg(
        F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_v"))).alias("_hi"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("_f"))
    return each.select(*by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))
