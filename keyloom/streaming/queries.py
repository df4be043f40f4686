"""Structured Streaming forms: latest values, windowed counts with late data, trimmed appends, and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_values(log: DataFrame) -> DataFrame:
    """The running value of each key of a log stream; for output modes ``update`` and ``complete``."""
    return log.where("op = 'SET'").groupBy("db", "key").agg(F.max_by("value", "seq").alias("value"))


def windowed_counts(events: DataFrame, ts: str, by: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding event-time windows; rows later than ``late`` behind the newest are dropped."""
    at = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(at.alias("at"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("at.start").alias("start"), F.col("at.end").alias("end"), *by, "n")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts in sessions that end after a gap."""
    rows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("at"), *by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("at.start").alias("start"), F.col("at.end").alias("end"), *by, "n")


def append_to(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A log sink: every micro-batch becomes JSON files, each exactly once."""
    return rows.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """PUBLISH to channel subscribers: a join of the stream with the subscriptions as they are at each batch."""
    return messages.join(subs, "channel")
