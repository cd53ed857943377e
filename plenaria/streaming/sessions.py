"""Speaker sessions from a stream of events: what is repeated counts once, and state ends with the watermark.

Two stateful steps in one query: events that repeat an id within the watermark are dropped, then events of one speaker with
no gap of ``gap`` between them are one session. A session comes out once, when the watermark has passed its end, and its
state goes with it; an event that is later than the watermark is lost. So state holds what is open now, however long the
stream runs, and a query that is stopped goes on from its checkpoint with the sessions that were open.

This goes beyond the batch programs, which have no unbounded source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP, LATE = "30 minutes", "1 hour"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
SESSIONS = "user_id long, start timestamp, end timestamp, n_events long, total double"


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(user_id, start, end, n_events, total) of ``events`` (event_id, ts, user_id, value); ``end`` is the last event's time
    and the gap. For tables, all sessions; for streams, those that are over."""
    once = events.withWatermark("ts", late)
    once = once.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else once.dropDuplicates(["event_id"])
    found = once.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "total")


def run_sessions(spark: SparkSession, path: str, out: str, checkpoint: str, gap: str = GAP, late: str = LATE, files_per_batch: int | None = None) -> DataFrame:
    """Take the event files at ``path`` (a pattern or folder) that no run with this checkpoint has taken, and end; the
    sessions written so far. Spark's file sink and checkpoint make the output exactly once."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    found = sessions(reader.parquet(path), gap, late)
    stream = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SESSIONS).parquet(out)
