"""Progress of runs, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as files come; the time is cast, as watermarks need one with a zone."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_by_run(events: DataFrame) -> DataFrame:
    """(run_id, events, stage, value): the last event of each run. Works on a stream in complete mode."""
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("events"), last.alias("b")).select("run_id", "events", F.col("b.event_type").alias("stage"), F.col("b.value").alias("value"))


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, stage, n) of windows; events later than `late` are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("event_type").alias("stage"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first event of each key within the watermark: bounded state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fresh(cache: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """Cached rows (checked_at) that are younger than their time to live."""
    return cache.where(F.col("checked_at") > F.to_timestamp(F.lit(now)) - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All files that are there, through a stream, into a table in memory: for tests and small summaries."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
