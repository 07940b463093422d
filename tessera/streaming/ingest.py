"""Structured Streaming: operations into a store, and expiry sweeps, batch by batch."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import maintenance
from ..sources.store import Store


def into_store(stream: DataFrame, store: Store, checkpoint: str, compact_every: int = 0, flush: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch to the store, under a name by which a batch that runs twice is known. Every compact_every
    batches the log is folded into a new base; with flush, after every batch if the store finds that it is due."""
    name = f"stream-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"

    def batch(df: DataFrame, number: int) -> None:
        store.append(df, batch=f"{name}-{number}")
        if compact_every and number % compact_every == compact_every - 1:
            store.compact()
        elif flush:
            store.flush(int(time.time() * 1000))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def expired(stream: DataFrame, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Numbers of keys that expire in each sweep bucket, when the watermark has passed it."""
    at = F.timestamp_millis(maintenance.ttl_bucket_col(F.col("expire_ms")) * 1000)
    due = stream.where("expire_ms > 0").withWatermark(event_time, delay).withColumn("due", at)
    return due.groupBy(F.window(event_time, "5 minutes"), "due").agg(F.count("*").alias("n"))
