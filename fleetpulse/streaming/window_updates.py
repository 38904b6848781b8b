"""Windows from a stream of daily rows: each micro-batch is one batch of an incremental window store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.operators.incremental import WindowStore, advance


def update_windows(daily: DataFrame, store: WindowStore, checkpoint: str) -> StreamingQuery:
    """Takes in all rows not seen yet and stops. The store must exist and take its batches from this checkpoint only, as
    their numbers make each count once.
    """

    def take_in(rows: DataFrame, number: int) -> None:
        advance(store, rows, number)

    return daily.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take_in).start()
