"""Tumbling bars and sessions over a stream of events (ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars by event type: count, sum, least and greatest value; events later than `late` are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    bars = w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return bars.select(F.col("window.start").alias("start"), "event_type", "n", "total", "low", "high")


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A user's events that follow each other within the gap."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def to_end(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and stops; results as Parquet, once each."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
