"""Write-back on Structured Streaming: buffered writes become fragments in micro-batches.

A batch is one commit: it is written to its own `batch_id` partition, which a retry overwrites, so a failed batch neither
loses nor repeats a write. Readers resolve versions by seq, so no order between batches is needed. Backpressure is the
source's limit a trigger; draining is trigger(availableNow=True); waiting for what came before is processAllAvailable().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.overlay import split_stripes
from tidemark.schemas import STRIPE_BYTES


def flush(writes: DataFrame, store: str, checkpoint: str, stripe: int = STRIPE_BYTES, on_commit: Callable[[DataFrame, int], None] | None = None, interval: str | None = None) -> StreamingQuery:
    """Start flushing a stream of writes (fragments before splitting) to the folder store.

    on_commit(batch, id) is part of the commit: it runs before the batch counts as done, and must stand being repeated.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        pieces = split_stripes(batch, stripe)
        pieces.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        if on_commit:
            on_commit(pieces, batch_id)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_attributes(pending: DataFrame) -> DataFrame:
    """inode, live_size, live_mtime_ns (that of the last seq) over pending extents; on a stream, state of one row an inode."""
    return pending.groupBy("inode").agg(F.max(F.col("logical_off") + F.col("length")).alias("live_size"), F.max_by("mtime_ns", "seq").alias("live_mtime_ns"))


def barrier(query: StreamingQuery) -> None:
    """Wait until everything that had been written when this was called is committed; a failed flush is raised here."""
    query.processAllAvailable()
    if query.exception():
        raise query.exception()


def windowed_counts(events: DataFrame, kind: str = "tumbling", length: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling, sliding or session windows, with a watermark; an addition of this library."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = {"tumbling": F.window("ts", length), "sliding": F.window("ts", length, slide), "session": F.session_window("ts", length)}[kind]
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
