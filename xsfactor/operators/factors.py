"""Time-series factors of an entity. Frames are of rows, inclusive; `least` values must be there, else null.

All factors of a call share one window specification, so a panel is sorted once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import lag, lead, rolling, series
from ..schemas import ratio
from .scan import moving_average

YEAR = math.sqrt(252.0)
TINY = 1e-12


def col(x: str) -> Column:
    return F.col(x)


def with_return(df: DataFrame, name: str = "r") -> DataFrame:
    """Change of the close against the row before; the lagged return stands beside it, for lag-safe frames."""
    return df.withColumn(name, ratio(col("close"), lag("close")) - 1).withColumn(f"{name}_1", lag(name))


def momentum(n: int) -> Column:
    """From n + 1 rows ago to 2 rows ago."""
    return ratio(lag("close", 2), lag("close", n + 1)) - 1


def volatility(n: int = 21, least: int = 15, year: float = YEAR) -> Column:
    """T3."""
    return rolling(F.stddev_samp, col("r"), n, least) * year


def vol_ratio(short: int = 21, long: int = 63, least_short: int = 15, least_long: int = 30) -> Column:
    """T4."""
    return rolling(F.stddev_samp, col("r"), short, least_short, 1) / (rolling(F.stddev_samp, col("r"), long, least_long, 1) + TINY) - 1


def true_range() -> Column:
    prev = lag("close")
    return F.greatest(F.abs(col("high") - col("low")), F.abs(col("high") - prev), F.abs(col("low") - prev))


def atr(n: int = 14, least: int = 10) -> Column:
    """T5, on a column tr (see true_range); relative to the close."""
    return ratio(rolling(F.avg, col("tr"), n, least), col("close"))


def garman_klass_term() -> Column:
    hl, co = F.ln(ratio(col("high"), col("low"))), F.ln(ratio(col("close"), col("open")))
    return F.lit(0.5) * hl * hl - F.lit(2 * math.log(2) - 1) * co * co


def garman_klass(n: int = 21, least: int = 15, year: float = YEAR) -> Column:
    """T6, on a column gk (see garman_klass_term). A negative mean counts as 0, a missing one stays missing."""
    m = rolling(F.avg, col("gk"), n, least)
    return F.when(m.isNotNull(), F.sqrt(F.greatest(m, F.lit(0.0)))) * year


def amplitude() -> Column:
    """T7."""
    return ratio(col("high") - col("low"), col("close"))


def breakout_high(n: int = 63, least: int | None = None) -> Column:
    """1 above the highest close of the n rows before; 0 also where that isn't known."""
    return F.coalesce(col("close") > rolling(F.max, col("close"), n, least or int(n * 0.6), 1), F.lit(False)).cast("double")


def breakout_low(n: int = 63, least: int | None = None) -> Column:
    return F.coalesce(col("close") < rolling(F.min, col("close"), n, least or int(n * 0.6), 1), F.lit(False)).cast("double")


def distance_high(n: int = 252, least: int | None = None) -> Column:
    """T9."""
    return col("close") / (rolling(F.max, col("close"), n, least or int(n * 0.6), 1) + TINY) - 1


def distance_low(n: int = 252, least: int | None = None) -> Column:
    return col("close") / (rolling(F.min, col("close"), n, least or int(n * 0.6), 1) + TINY) - 1


def volume_trend(short: int = 20, long: int = 60, least_short: int = 10, least_long: int = 30) -> Column:
    """T10."""
    return rolling(F.avg, col("volume"), short, least_short, 1) / (rolling(F.avg, col("volume"), long, least_long, 1) + TINY) - 1


def signed_volume() -> Column:
    return F.coalesce(F.signum(col("close") - lag("close")) * col("volume"), F.lit(0.0))


def on_balance_volume() -> Column:
    """T11, on a column sv (see signed_volume)."""
    return F.sum("sv").over(series().rowsBetween(Window.unboundedPreceding, 0))


def zero_return_share(n: int = 21, least: int = 10) -> Column:
    """A missing lagged return counts as none."""
    zero = (F.abs(F.coalesce(col("r_1"), F.lit(0.0))) < 1e-10).cast("double")
    return rolling(F.avg, zero, n, least)


def roll_spread(n: int = 21, least: int = 15) -> Column:
    """From the covariance of neighbouring lagged returns (n - 1 pairs), on a column r_2 = lag of r_1."""
    pairs = series().rowsBetween(2 - n, 0)
    known = F.count("r_1").over(series().rowsBetween(1 - n, 0))
    cov = F.when(known >= least, F.covar_pop("r_1", "r_2").over(pairs))
    return F.when(cov.isNotNull(), 2 * F.sqrt(F.greatest(-cov, F.lit(0.0))))


def volume_ratio(n: int = 20, least: int = 15) -> Column:
    """T14."""
    return ratio(col("volume"), rolling(F.avg, col("volume"), n, least))


def illiquidity() -> Column:
    """T16."""
    return F.abs(col("r_1")) / (lag("amount") + 1) * 1e9


def forward(n: int) -> Column:
    """The next return, or that over n rows."""
    return lead("r", 1) if n == 1 else ratio(lead("close", n), col("close")) - 1


def trimmed(df: DataFrame, rows: int = 260) -> DataFrame:
    """Without the first rows of every entity."""
    return df.withColumn("_n", F.row_number().over(series())).where(col("_n") > rows).drop("_n")


def eligible(df: DataFrame, bars: int = 40) -> DataFrame:
    """Entities with enough bars."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entity"))).where(col("_n") >= bars).drop("_n")


def ewma(df: DataFrame, x: str, span: int, out: str) -> DataFrame:
    """s = a x + (1 - a) s from the entity's first value on."""
    return moving_average(df, x, 2.0 / (span + 1), out)


def drawdown(x: Column, w: object) -> Column:
    """T23, on a running total x: its distance from the highest so far."""
    return x - F.max(x).over(w)


def islands(df: DataFrame, x: str, by: list[str], date: str = "date") -> DataFrame:
    """Runs of rows with one value: (by, x, start, end, n)."""
    w = Window.partitionBy(*by).orderBy(date) if by else Window.orderBy(date)
    new = F.when(F.col(x).eqNullSafe(F.lag(x).over(w)) & F.lag(date).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run", x).agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def filled(x: str) -> Column:
    """The last known value."""
    return F.last(x, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
