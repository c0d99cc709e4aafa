"""Structured Streaming twins of the batch state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from loomspark.operators import merge


def source(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder, at most so many in a batch; progress is kept by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def rate_limit(events: DataFrame, limit: int = 5, window_seconds: float = 60.0, delay: str = "10 minutes") -> DataFrame:
    """(key, event_id, accepted) of a stream of (key, event_id, at); each key's accepted times are its state.

    Events of a batch are taken in the order of time, then id; the state is dropped once the window has passed by the
    watermark. Rejected events never count, so the decision can't be a windowed aggregate.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event in zip(rows["at"].astype("datetime64[us]").astype("int64"), rows["event_id"], strict=True):
            recent = [t for t in recent if t > at - int(window_seconds * 1_000_000)]
            ok = len(recent) < limit
            if ok:
                recent.append(at)
            out.append((key[0], event, ok))
        state.update((recent,))
        state.setTimeoutTimestamp(max(max(recent, default=0) // 1000 + int(window_seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "accepted"])

    kinds = dict(events.dtypes)
    return events.withWatermark("at", delay).groupBy("key").applyInPandasWithState(
        step, f"key {kinds['key']}, event_id {kinds['event_id']}, accepted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def session_counts(events: DataFrame, ttl: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and span of each session of (key, at); a session ends once nothing came for ttl, late events are dropped."""
    return events.withWatermark("at", delay).groupBy("key", F.session_window("at", ttl)).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).drop("session_window")


def window_counts(events: DataFrame, length: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling or sliding windows of (kind, at, value)."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    out = events.withWatermark("at", delay).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "total")


def distinct_events(events: DataFrame, key: str = "dedupe_key", delay: str = "1 day") -> DataFrame:
    """A change feed with each key once within the watermark."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark([key])


def append_changes(stream: DataFrame, log: str, checkpoint: str, key: str):
    """Appends the newest row of each key of each batch to a log, partitioned by batch; returns the query.

    Nothing that is there is read or written again, and a batch that runs twice overwrites its own partition.
    """

    def apply(batch: DataFrame, number: int) -> None:
        merge.latest(batch, [key], [F.desc("at")]).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(log: DataFrame, key: str) -> DataFrame:
    """The newest row of each key of a log."""
    return merge.latest(log, [key], [F.desc("batch")]).drop("batch")


def changes(log: DataFrame, key: str, digest: str = "content_hash") -> DataFrame:
    """Change events of a log: the first row of each key and those with another digest than the row before, with a key that makes replays harmless."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy("batch"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("batch")) == 1
    rows = log.withColumn("action", F.when(first, "inserted").when(~F.col(digest).eqNullSafe(before), "updated").otherwise("unchanged"))
    return merge.outbox(rows, key, digest)
