"""All queries of the panel engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, factor_queries, ic_queries, model_queries, more_queries, portfolio_queries, relational_queries, run_queries  # noqa: F401

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["i3_ic_summary"](spark, sf_dir)
