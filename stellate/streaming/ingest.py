"""Streaming ingest: micro-batches into the same upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def upsert_stream(engine: Engine, name: str, documents: DataFrame, checkpoint: str, order: str, **trigger) -> StreamingQuery:
    """Upsert a streaming DataFrame of documents; ``order`` decides which of a repeated id in a batch wins."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        engine.upsert(name, batch.withColumn("batch_seq", F.col(order).cast("long")))

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
