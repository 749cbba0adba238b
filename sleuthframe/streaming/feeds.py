"""Feeds as streams: deduplicated landing, dead letters, windowed lanes and exact bursts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sleuthframe.operators.ingest import Mapping, content_hash, mapped


def read_json_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of JSON lines as they come: ``payload``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select(F.col("value").alias("payload"))


def deduplicated(feed: DataFrame, delay: str = "1 day") -> DataFrame:
    """``feed`` (``connector, payload, recorded_at``) with ``hash``, each content once within the watermark."""
    hashed = feed.withColumn("hash", content_hash(F.col("payload")))
    return hashed.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["connector", "hash"])


def land(feed: DataFrame, mapping: Mapping, good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Map each batch; good records go to one table, failed ones with stage and reason to another.

    A batch that runs again replaces what it wrote, so both tables have each record once.
    """

    def write(batch: DataFrame, number: int) -> None:
        records = mapped(batch, mapping).withColumn("batch", F.lit(number)).persist()
        for rows, path in ((records.where("stage = 'ok'").drop("stage", "reason"), good), (records.where("stage <> 'ok'").select("payload", "stage", "reason", "batch"), dead)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        records.unpersist()

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_lanes(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts of each lane and day (``lane, ts``), final once the watermark has passed the day."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "lane").agg(F.count(F.lit(1)).alias("total")).select("lane", F.to_date("window.start").alias("day"), "total")


def exact_bursts(events: DataFrame, hours: int, peak: int, delay: str = "1 hour") -> DataFrame:
    """``ref, peak_at, n``: whenever a ref (``ref, ts``) has ``peak`` events or more in the closed span of ``hours`` up to an event.

    State by ref holds the times of one span and the late ones the watermark
    still lets in; it goes when the ref has been silent for longer.
    """
    span = hours * 3_600_000_000

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        fresh = [int(t.value // 1000) for frame in frames for t in frame["ts"]]
        times = sorted(times + fresh)
        new, first, rows = set(fresh), 0, []
        for i, t in enumerate(times):
            while t - times[first] > span:
                first += 1
            if t in new and i - first + 1 >= peak:
                rows.append((key[0], pd.Timestamp(t, unit="us"), i - first + 1))
        keep = [t for t in times if t >= max(times) - span]
        state.update((keep,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), max(times) // 1000) + span // 1000 + 1)
        yield pd.DataFrame(rows, columns=["ref", "peak_at", "n"])

    kind = events.schema["ref"].dataType.simpleString()
    grouped = events.withWatermark("ts", delay).groupBy("ref")
    return grouped.applyInPandasWithState(follow, f"ref {kind}, peak_at timestamp, n long", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
