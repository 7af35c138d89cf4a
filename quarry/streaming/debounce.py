"""Debounced changes: the last event of a key within a quiet span, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_events(events: DataFrame, keys: list[str], ts: str, order: str, millis: int) -> DataFrame:
    """keys, started, ended (microseconds of the first and last event), last id and count of each key's bursts: events less than ``millis`` apart."""
    out = events.groupBy(*keys, F.session_window(ts, f"{millis} milliseconds").alias("w")).agg(
        F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("started"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("ended"), F.max_by(order, F.struct(ts, order)).alias("last_id"), F.count("*").alias("n")
    )
    return out.drop("w")


def stream_last_events(events: DataFrame, keys: list[str], ts: str, order: str, millis: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream under a watermark; a burst is emitted once, when it can't grow any more."""
    return last_events(events.withWatermark(ts, late), keys, ts, order, millis)


def apply_changes(changes: DataFrame, write, checkpoint: str):
    """Hand each micro-batch's latest change per path to write(batch, batch_id), which merges it by key and so may be repeated."""

    def one(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "seq").alias("r")).select("r.*")
        write(latest, batch_id)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
