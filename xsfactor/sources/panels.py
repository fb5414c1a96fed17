"""Panels made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of suppliers by month."""
    return supplier_bars(spark, sf_dir, F.trunc("l_shipdate", "month"))


def supplier_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of suppliers by day, for what counts dates. Lines of one moment go by price: the lowest opens, the highest closes."""
    return supplier_bars(spark, sf_dir, F.to_date("l_shipdate"))


def supplier_bars(spark: SparkSession, sf_dir: str, date: Column) -> DataFrame:
    """Bars of suppliers by date: prices are unit prices, the category is the supplier's nation.

    Lines move once, by supplier and date, and are sorted once, where they arrive: a month has a few lines of a supplier,
    so a sort before the move would hardly make them fewer. The dimension joins are on the aggregate.
    """
    px = F.col("l_extendedprice") / F.col("l_quantity")
    ticks = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"), date.alias("date"), "l_shipdate", px.alias("px"),
        F.col("l_quantity").alias("q"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"),
    )
    tick = F.struct("l_shipdate", "px")
    bars = ticks.repartition("entity", "date").groupBy("entity", "date").agg(
        F.min(tick)["px"].alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max(tick)["px"].alias("close"),
        F.sum("q").alias("volume"), F.round(F.sum("v"), 4).alias("amount"), F.count(F.lit(1)).alias("ticks"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("k"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("industry"))
    named = bars.join(suppliers, "entity", "left").join(nations, "k", "left").drop("k")
    return named.withColumn("turnover", F.col("volume") / F.avg("volume").over(Window.partitionBy("entity")))


#: The same in SQL, as the first tables of a WITH clause.
SM = """
tk AS (SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_shipdate, l_extendedprice / l_quantity AS px,
         l_quantity AS q, l_extendedprice * (1 - l_discount) AS v FROM lineitem),
b0 AS (SELECT entity, date, min(struct_pack(t := l_shipdate, p := px)).p AS open, max(px) AS high, min(px) AS low,
         max(struct_pack(t := l_shipdate, p := px)).p AS close, sum(q) AS volume, round(sum(v), 4) AS amount, count(*) AS ticks FROM tk GROUP BY ALL),
b AS (SELECT b0.*, n_name AS industry, volume / avg(volume) OVER (PARTITION BY entity) AS turnover
      FROM b0 LEFT JOIN supplier ON s_suppkey = entity LEFT JOIN nation ON n_nationkey = s_nationkey)"""


def brand_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of brands by day, for long windows: the last unit price of a day, and its volume."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.join(parts, "l_partkey").groupBy("entity", F.to_date("l_shipdate").alias("date")).agg(
        F.max(F.struct("l_shipdate", px.alias("px")))["px"].alias("close"), F.sum("l_quantity").alias("volume")
    )


BD = """
bd AS (SELECT p_brand AS entity, CAST(l_shipdate AS DATE) AS date, max(struct_pack(t := l_shipdate, p := l_extendedprice / l_quantity)).p AS close,
         sum(l_quantity) AS volume FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users by day: their count and value."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value")
    )


UE = "ue AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL)"
