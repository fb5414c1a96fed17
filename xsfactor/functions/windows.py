"""Frames over a panel (entity, date) and over its cross-sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(entity: str = "entity", date: str = "date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(date)


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(series())


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(x, n).over(series())


def rolling(f: Callable[[Column], Column], x: Column, n: int, least: int, shift: int = 0) -> Column:
    """f over the n rows that end `shift` rows ago; null until `least` of them have a value. Rows, not days."""
    frame = series().rowsBetween(1 - n - shift, -shift)
    return F.when(F.count(x).over(frame) >= least, f(x).over(frame))


def running(f: Callable[[Column], Column], x: Column, w: WindowSpec) -> Column:
    return f(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def average_rank(x: Column | str, *by: str) -> Column:
    """Ranks within groups from 1, ties at their mean. Rows without a value must be filtered or partitioned out before."""
    x = F.col(x) if isinstance(x, str) else x
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def zscore(x: Column, *by: str, floor: float = 1e-12) -> Column:
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(x).over(w)
    return F.when(sd > floor, (x - F.avg(x).over(w)) / sd)


def indexed(dates: DataFrame, date: str = "date", name: str = "idx") -> DataFrame:
    """Distinct dates with their number from 0. Only this list, a row a date, is put in one order."""
    return dates.select(date).distinct().withColumn(name, F.row_number().over(Window.orderBy(date)).cast("long") - 1)
