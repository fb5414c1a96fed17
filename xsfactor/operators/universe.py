"""Universe construction: screens, gates, categories, ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import UNCLASSIFIED


def screen(df: DataFrame, least: dict[str, float], between: dict[str, tuple[float, float]] | None = None, without: dict[str, str] | None = None) -> DataFrame:
    """Lower bounds, ranges, and names without a substring (any case; no name counts as without)."""
    for c, v in least.items():
        df = df.where(F.col(c) >= v)
    for c, (a, b) in (between or {}).items():
        df = df.where(F.col(c).between(a, b))
    for c, word in (without or {}).items():
        df = df.where(~F.coalesce(F.contains(F.upper(c), F.lit(word.upper())), F.lit(False)))
    return df


def or_all(df: DataFrame, passes: Column) -> DataFrame:
    """P10: the rows that pass, or all if none does. Whether any does is a subquery of one value; no row moves."""
    return df.where(passes | (~df.where(passes).exists()))


def capped_top(df: DataFrame, by: list[Column], category: str, cap: int, n: int) -> DataFrame:
    """The first n by order with at most `cap` of a category; the cap hangs only on the place within it."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(*by))
    return df.withColumn("_k", place).where(F.col("_k") <= cap).drop("_k").orderBy(*by).limit(n)


def candidates(bars: DataFrame) -> DataFrame:
    """U3."""
    return bars.groupBy("entity").agg(F.count(F.lit(1)).alias("days"), F.median("amount").alias("median_amount"))


def topped_up(ranked: DataFrame, existing: DataFrame, key: str, by: list[Column], n: int) -> DataFrame:
    """U4: the first row of each key by order, then keys of the existing list that are missing, n in all.

    Both lists are cut to n rows before their places are counted, so only these meet in one task.
    """
    first = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_k = 1").drop("_k")
    more = existing.join(first.select(key), key, "left_anti").orderBy(key).limit(n)
    first = first.orderBy(*by).limit(n).withColumn("_place", F.row_number().over(Window.orderBy(*by)))
    more = more.withColumn("_place", F.row_number().over(Window.orderBy(key)) + n)
    return first.unionByName(more, allowMissingColumns=True).orderBy("_place").limit(n).drop("_place")


def gates(bars: DataFrame, universe: DataFrame, rows: int, null_share: float, recent: int, since: Column) -> DataFrame:
    """Each entity's counts and status; entities of the universe without bars are missing."""
    q = bars.groupBy("entity").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.avg(F.col("r").isNull().cast("double")).alias("null_share"), F.count_if(F.col("date") >= since).alias("recent"),
    )
    status = (
        F.when(F.col("rows").isNull(), "missing").when(F.col("rows") < rows, "short").when(F.col("null_share") > null_share, "gaps")
        .when(F.col("recent") < recent, "stale").otherwise("ok")
    )
    return universe.join(q, "entity", "left").withColumn("status", status)


def by_keyword(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The category of the first keyword that the name holds."""
    out = F.lit(None).cast("string")
    for word, category in reversed(rules):
        out = F.when(F.contains(F.lower(name), F.lit(word.lower())), category).otherwise(out)
    return out


def resolved(*sources: Column) -> Column:
    """The first source that says something."""
    known = [F.when(~F.trim(c).isin("", "None", "nan", UNCLASSIFIED), F.trim(c)) for c in sources]
    return F.coalesce(*known, F.lit(UNCLASSIFIED))


def mode(df: DataFrame, x: str, *by: str) -> DataFrame:
    """The most frequent value, the smallest of ties."""
    n = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.max_by(x, F.struct("_n", F.lit(0))).alias("_any"), F.min(F.struct((-F.col("_n")).alias("k"), F.col(x).alias("x")))["x"].alias("mode")).drop("_any")


def as_of(df: DataFrame, at: Column, value: str) -> DataFrame:
    """Each entity's last value at or before a date."""
    return df.where(F.col("date") <= at).groupBy("entity").agg(F.max_by(value, "date").alias(value), F.max("date").alias("as_of"))


def as_of_join(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Each row of left (entity, date) with the last value of right at or before it: one sort of both, no range join."""
    both = left.select("entity", "date", F.lit(1).alias("_l"), F.lit(None).alias(value)).unionByName(right.select("entity", "date", F.lit(0).alias("_l"), value))
    w = Window.partitionBy("entity").orderBy("date", "_l").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_l = 1").drop("_l")
