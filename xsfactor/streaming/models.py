"""Walk-forward models fed by the day: sums of dates are a table that batches add to, predictions come out batch by batch.

A batch brings whole dates. It writes its dates' sums and its predictions under its own number, so a batch that runs again
writes the same again; a date that comes again replaces what was there. A window's sums are the sum of its dates' rows, as
in the batch form: a day enters when it comes and leaves when it is too old, without rounding that piles up.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import models as M


def written(df: DataFrame, root: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def state(like: DataFrame, root: str, name: str) -> DataFrame:
    """All batches' rows with their number; none before the first batch."""
    try:
        return like.sparkSession.read.parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0).withColumn("batch", F.lit(0))


def feed(batch: DataFrame, number: int, root: str, xs: list[str], y: str, days: int, alpha: float, least: int) -> None:
    """M1 for one batch (entity, date, factors, label)."""
    own = batch.select("entity", "date", *xs, y).persist()
    try:
        written(M.sums(own, xs, y, "date"), root, "sums", number)
        size = 2 * len(xs) + 2 + len(xs) ** 2
        near = own.agg(F.date_sub(F.min("date"), days).alias("first"))
        have = state(M.sums(own, xs, y, "date"), root, "sums").where(F.col("batch") <= number)
        have = have.join(F.broadcast(near), F.col("date") >= F.col("first"))  # one row
        last = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("batch")))
        have = have.withColumn("_k", last).where("_k = 1").select("date", "n", *(F.col("st")[k].alias(f"_{k}") for k in range(size)))
        # Rows of dates: those of a window, and the batch's own.
        dates = own.select("date").distinct().withColumn("_new", F.lit(True))
        w = Window.orderBy(F.unix_date("date")).rangeBetween(-days, -1)
        total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
        windows = have.join(dates, "date", "full").select("date", "_new", total("n").alias("n"), F.array(*(total(f"_{k}") for k in range(size))).alias("st")).where("_new").drop("_new")
        written(M.predicted(own, M.solved(windows, alpha, least), xs).select("entity", "date", F.col(y).alias("y_true"), "y_pred", "n_train"), root, "predictions", number)
    finally:
        own.unpersist()


def predictions(like: DataFrame, root: str) -> DataFrame:
    """What has been predicted so far, of each date by the batch that brought it last."""
    last = F.max("batch").over(Window.partitionBy("date"))
    return state(like, root, "predictions").withColumn("_last", last).where(F.col("batch") == F.col("_last")).drop("_last")


def follow(stream: DataFrame, root: str, checkpoint: str, xs: list[str], y: str, days: int, alpha: float = 1.0, least: int = 1000) -> StreamingQuery:
    """Feeds what a stream has and stops."""
    run = lambda batch, number: feed(batch, number, root, xs, y, days, alpha, least)
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
