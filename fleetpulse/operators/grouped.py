"""Work on Arrow batches with facts that belong to each row's group: learned tables with one or a few rows per group.

Facts go to every task while they are small. Beyond a size, rows are dealt out by group and slice, and only a group's own slices
get its facts, so that neither the facts nor a group ever has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

#: Facts are sent to every task up to this size.
BROADCAST_BYTES = 64 << 20
#: Rows of a slice, about.
SLICE_ROWS = 200_000


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, and which rows are whole: of the right length, without nulls and non-finite values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whole = lengths == width
    values = column.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full((len(column), width), np.nan)
    out[whole] = values.reshape(-1, width)
    return out, np.isfinite(out).all(axis=1)


def by_group(batch: pa.RecordBatch | pa.Table, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(group, row numbers) of a batch."""
    if not batch.num_rows:
        return
    place = np.zeros(batch.num_rows, np.int64)
    for c in by:
        column = batch.column(c)
        found = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode")
        _, place = np.unique(place * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(place, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        yield tuple(batch.column(c)[int(at[0])].as_py() for c in by), at


def fields(df: DataFrame, by: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in by]


def arrow_types(df: DataFrame, by: list[str]) -> list[pa.DataType]:
    schema = df.select(*by).limit(0).toArrow().schema
    return [schema.field(c).type for c in by]


def beside(rows: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """An inner join with a row per group in which a null group meets itself."""
    names = [f"_beside{k}" for k in range(len(by))]
    other = values.select(*[F.col(c).alias(n) for c, n in zip(by, names)], *[c for c in values.columns if c not in by])
    return rows.join(other, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]).drop(*names)


def per_group(rows: DataFrame, facts: DataFrame, by: list[str], prepare: Callable[[pa.Table], object], apply: Callable[[pa.Table, object | None], pa.Table],
              schema: T.StructType, facts_bytes: int, broadcast_bytes: int = BROADCAST_BYTES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The tables that ``apply(some rows of one group, prepared facts or None)`` gives, together."""
    if facts_bytes <= broadcast_bytes:
        shared = rows.sparkSession.sparkContext.broadcast(facts.toArrow())

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            places = dict(by_group(table, by))
            ready: dict[tuple, object] = {}
            for batch in batches:
                for key, at in by_group(batch, by):
                    if key in places and key not in ready:
                        ready[key] = prepare(table.take(pa.array(places[key])))
                    yield from apply(pa.Table.from_batches([batch]).take(pa.array(at)), ready.get(key)).to_batches()

        return rows.mapInArrow(each, schema)

    slices = rows.groupBy(*by).agg((F.floor(F.count(F.lit(1)) / slice_rows) + 1).cast("int").alias("slices"))
    dealt = beside(rows, slices, by).withColumn("slice", F.floor(F.rand(0) * F.col("slices")).cast("int")).drop("slices")
    spread = beside(facts, slices, by).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def of_slice(own: pa.Table, found: pa.Table) -> pa.Table:
        return apply(own, prepare(found) if found.num_rows else None)

    return dealt.groupBy(*by, "slice").cogroup(spread.groupBy(*by, "slice")).applyInArrow(of_slice, schema)


def with_facts(rows: DataFrame, facts: DataFrame, by: list[str], prepare: Callable[[pa.Table], object], apply: Callable[[pa.Table, object | None], list | pa.Array],
               drop: list[str], out: T.StructField, facts_bytes: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Replaces the columns ``drop`` by ``out``, a value for each row of ``apply(rows of one group, prepared facts or None)``."""
    kept = [f for f in rows.schema.fields if f.name not in (*drop, out.name)]
    names = [f.name for f in kept]
    kind = rows.sparkSession.createDataFrame([], T.StructType([out])).toArrow().schema.field(0).type

    def done(own: pa.Table, found: object | None) -> pa.Table:
        return own.select(names).append_column(out.name, pa.array(apply(own, found), kind))

    return per_group(rows, facts, by, prepare, done, T.StructType([*kept, out]), facts_bytes, broadcast_bytes)
