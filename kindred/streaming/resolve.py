"""Resolution of a stream of queries against a static target base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.resolve import resolve


def resolve_stream(queries: DataFrame, targets: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts a query that resolves each micro-batch and appends it to Parquet.

    Blocking counts depend on the queries of a call, here on those of a
    micro-batch. Batches are written under their number, so a batch that is
    replayed after a failure replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        resolve(batch, targets, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
