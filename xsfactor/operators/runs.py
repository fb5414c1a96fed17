"""Runs of the whole analysis: factor discovery, what is still to be fetched, and runs loaded by their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discovered(df: DataFrame, suffix: str = "_std", without: tuple[str, ...] = (), prefix: str = "factor_") -> list[str]:
    """The columns with the suffix but those excluded; where there is none, those with the prefix."""
    found = [c for c in df.columns if c.endswith(suffix) and c not in without]
    return found or [c for c in df.columns if c.startswith(prefix) and c not in without]


def mapped(df: DataFrame, factors: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """(df with all factors that any group maps to, absent ones null; their names)."""
    names = sorted({f for fs in factors.values() for f in fs})
    return df.withColumns({f: F.lit(None).cast("double") for f in names if f not in df.columns}), names


def cache_key(entity: Column, start: str, end: str) -> Column:
    return F.concat_ws("_", entity.cast("string"), F.lit(start), F.lit(end))


def to_fetch(wanted: DataFrame, status: DataFrame, start: str, end: str) -> DataFrame:
    """The entities of wanted whose (entity, start, end) the status table (key, status) doesn't have as done."""
    done = status.where(F.col("status") == "done").select("key").distinct()
    return wanted.withColumn("key", cache_key(F.col("entity"), start, end)).join(done, "key", "left_anti")


def highlights(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Rows (run_id, metric, value) for the summary of a bundle."""
    return metrics.unpivot(["run_id"], names, "metric", "value").where(F.col("value").isNotNull())


def loaded(metrics: DataFrame, series: DataFrame, regimes: DataFrame, run: str | None = None) -> DataFrame:
    """A run's series with its regimes and metrics; without a run id, or where it isn't there, the newest run."""
    asked = F.max(F.when(F.col("run_id") == run, F.col("run_id"))) if run is not None else F.lit(None).cast("string")
    chosen = metrics.agg(F.coalesce(asked, F.max("run_id")).alias("run_id"))
    return series.join(chosen, "run_id").join(regimes, ["run_id", "date"], "left").join(metrics, "run_id", "left")


def priced(events: DataFrame, prices: DataFrame, price: str = "close") -> DataFrame:
    """Each event with its day's price, null where there is none."""
    return events.join(prices.select("entity", "date", price).dropDuplicates(["entity", "date"]), ["entity", "date"], "left")


def with_panel(predictions: DataFrame, panel: DataFrame, *columns: str) -> DataFrame:
    """Each prediction with the panel's columns of its entity and date, null where there are none."""
    return predictions.join(panel.select("entity", "date", *columns).dropDuplicates(["entity", "date"]), ["entity", "date"], "left")
