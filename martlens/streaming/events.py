"""Streaming twins of the batch aggregates, on the events table: windows with watermarks, sessions, running state.

Each function takes a streaming or a batch DataFrame of events; state is bounded by the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions.lineage import shared_folder

LATE = "1 hour"


def read_events(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Events with `ts` as a timestamp, which watermarks need."""
    batch = spark.read.parquet(path)
    df = batch
    if stream:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        source = spark.readStream.schema(batch.schema)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
            source, path = source.option("pathGlobFilter", p.getName()), p.getParent().toString()
        df = source.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their value by window and type."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Each user's sessions: events no more than `gap` apart."""
    rows = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it emitted."""
    spark, name = stream.sparkSession, f"drain_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
