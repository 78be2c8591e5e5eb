"""Change requests arriving as a stream, applied batch by batch with the bulk operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fieldbeat.operators.changes import ChangeSet, Keep
from fieldbeat.sources.store import Store
from fieldbeat.sources.tables import Tables


def apply_feed(
    store: Store,
    requests: DataFrame,
    operator: Callable[[Tables, DataFrame, Keep], ChangeSet],
    checkpoint: str,
    name: str,
) -> StreamingQuery:
    """Starts a query that applies all requests available now, then stops.

    Each micro-batch sees the tables as the one before left them. A repeated batch does not
    repeat its changes, because the store knows it by ``name`` and batch number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.apply(lambda tables, keep: operator(tables, batch, keep), f"{name}-{number}")

    return (
        requests.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
