"""Market index, market volatility, and regimes by quantiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..schemas import EXTREME, HIGH, NORMAL


def market(panel: DataFrame) -> DataFrame:
    """A1: mean return, its dispersion and the number of names by date."""
    return panel.groupBy("date").agg(F.avg("r").alias("market_return"), F.stddev_samp("r").alias("xsec_vol"), F.count(F.lit(1)).alias("n"))


def with_volatility(m: DataFrame, n: int = 21, year: float = 252.0, expanding: bool = False) -> DataFrame:
    """T20, T21, X10 on a market table (a row a date). expanding: each date is standardised by the dates up to it."""
    w = Window.orderBy("date")
    part = lambda f, x, k, least: F.when(F.count(x).over(w.rowsBetween(1 - k, 0)) >= least, f(x).over(w.rowsBetween(1 - k, 0)))
    out = m.withColumn("vol_ts", part(F.stddev_samp, "market_return", n, n // 2) * math.sqrt(year)).withColumn("vol_xsec", part(F.avg, "xsec_vol", max(5, n // 2), 3))
    whole = w.rowsBetween(Window.unboundedPreceding, 0) if expanding else Window.partitionBy(F.lit(0))
    z = lambda x: (F.col(x) - F.avg(x).over(whole)) / (F.stddev_samp(x).over(whole) + 1e-9)
    return out.withColumn("volatility", 0.5 * z("vol_ts") + 0.5 * z("vol_xsec"))


def with_regime(m: DataFrame, low: float = 0.5, high: float = 0.9) -> DataFrame:
    """X11: by two exact quantiles of the volatility; dates without one are left out. The market table is made once."""
    known = durable(m.where("volatility is not null"), "market")  # a row a date
    q = known.agg(F.percentile("volatility", F.lit(low)).alias("lo"), F.percentile("volatility", F.lit(high)).alias("hi")).first()
    v = F.col("volatility")
    return known.withColumn("regime", F.when(v <= F.lit(q["lo"]), NORMAL).when(v <= F.lit(q["hi"]), HIGH).otherwise(EXTREME))


def with_market(panel: DataFrame, m: DataFrame) -> DataFrame:
    """The panel with its date's regime; dates without one go. Spark sees the market table's size and picks the join."""
    return panel.join(m.select("date", "regime", "volatility", "market_return"), "date")


def profile(panel: DataFrame, x: str) -> DataFrame:
    """R2: each regime's days, names a day and moments."""
    days = panel.groupBy("regime", "date").agg(F.count(F.lit(1)).alias("names"), F.first("volatility").alias("v"), F.first("market_return").alias("m"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("ss"), F.count(x).alias("k"))
    return days.groupBy("regime").agg(
        F.count(F.lit(1)).alias("days"), F.avg("names").alias("names_a_day"), F.avg("v").alias("mean_vol"), F.avg("m").alias("mean_return"),
        (F.sum("s") / F.sum("k")).alias("mean_x"), F.sum("k").alias("n_x"),
    )


def transitions(m: DataFrame) -> DataFrame:
    """How often one regime follows another, and its share of all changes."""
    w = Window.orderBy("date")
    moves = m.select("date", "regime").distinct().withColumn("was", F.lag("regime").over(w)).where("was != regime")
    n = moves.groupBy(F.concat_ws("->", "was", "regime").alias("move")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def around_transitions(panel: DataFrame, m: DataFrame, x: str, rows: int = 50, least: int = 10) -> DataFrame:
    """Mean of x over the last rows of the old regime before a change and the first of the new one, by (date, entity).

    A regime's rows are numbered: what its earlier dates hold (a table of a row a date) plus the place within the date. A
    change knows how many rows lie before it, so it meets its rows by number, and no row meets a change it isn't near.
    """
    w = Window.orderBy("date")
    moves = m.select("date", "regime").withColumn("was", F.lag("regime").over(w)).where("was != regime").select(F.col("date").alias("since"), "was", F.col("regime").alias("now"))
    known = panel.where(F.col(x).isNotNull()).select("date", "entity", "regime", x)
    held = known.groupBy("regime", "date").agg(F.count(F.lit(1)).alias("n"))
    start = held.select("regime", "date", F.coalesce(F.sum("n").over(Window.partitionBy("regime").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("regime", "date").orderBy("entity"))
    numbered = known.withColumn("place", place).join(start, ["regime", "date"]).select("regime", (F.col("start") + F.col("place")).alias("at"), x)

    def side(before: bool) -> DataFrame:
        own, name = ("was", "pre") if before else ("now", "post")
        upto = moves.join(held, (moves[own] == held["regime"]) & (held["date"] < moves["since"]), "left").groupBy("since", "was", "now").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("upto"))
        wanted = F.sequence(F.col("upto") - rows + 1, F.col("upto")) if before else F.sequence(F.col("upto") + 1, F.col("upto") + rows)
        near = upto.select("since", "was", "now", F.col(own).alias("regime"), F.explode(wanted).alias("at")).join(numbered, ["regime", "at"])
        return near.groupBy("since", "was", "now").agg(F.avg(x).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    both = side(True).join(side(False), ["since", "was", "now"])
    return both.where((F.col("n_pre") > least) & (F.col("n_post") > least)).withColumn("change", F.col("post") - F.col("pre"))
