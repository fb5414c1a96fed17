"""Events with their prices, sliding windows, and rows that come too late, on streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def priced(events: DataFrame, prices: DataFrame, price: str = "close", late: str = "3 days") -> DataFrame:
    """J7 on two streams (entity, date, ...): each event with its day's price, null once none can come any more.

    Both sides wait for each other as long as their watermarks allow; the condition on times lets state go.
    """
    e = events.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    p = prices.select(F.col("entity").alias("_entity"), F.col("date").cast("timestamp").alias("_ts"), price)
    p = p.withWatermark("_ts", late).dropDuplicatesWithinWatermark(["_entity", "_ts"])
    on = (F.col("entity") == F.col("_entity")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") < F.col("ts") + F.expr("interval 1 day"))
    return e.join(p, on, "left_outer").select(*events.columns, price)


def sliding(stream: DataFrame, width: str, slide: str, late: str, *by: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Rows (start, by, n, total, low, high) for windows that overlap."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *by)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total", "low", "high")


def parted(stream: DataFrame, root: str, checkpoint: str, late: str, ts: str = "ts") -> StreamingQuery:
    """Writes a stream's rows to root/on_time and root/late: late are those older than the newest of the batches before, less `late`.

    These are the rows that a watermark of that delay may drop unseen (Spark's own is a batch behind). Each batch writes under its own number.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            newest = spark.read.parquet(f"{root}/newest").where(F.col("batch") < number).agg(F.max("ts").alias("_newest"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            newest = spark.createDataFrame([(None,)], "_newest timestamp")
        rows = batch.join(F.broadcast(newest))  # one row
        is_late = F.coalesce(F.col(ts) < F.col("_newest") - F.expr(f"interval {late}"), F.lit(False))
        rows = rows.withColumn("_late", is_late).drop("_newest").persist()
        try:
            for name, part in (("late", rows.where("_late")), ("on_time", rows.where("not _late"))):
                part.drop("_late").write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
            batch.agg(F.max(ts).alias("ts")).write.mode("overwrite").parquet(f"{root}/newest/batch={number}")
        finally:
            rows.unpersist()

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def late_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows (batch, n, oldest) of a late table."""
    return df.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("oldest"))
