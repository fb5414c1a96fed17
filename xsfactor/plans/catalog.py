"""The list of queries, and helpers to write their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under a name, with its SQL if there is one.

    Dates are shown as text on both sides, as clients read DATE columns in different ways. dates: the result's date
    columns; without them, `date` if the last SELECT begins with it (or with the entity).
    """

    def register(f: Callable) -> Callable:
        @functools.wraps(f)
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

        QUERIES[name] = shown
        if sql:
            last = sql[sql.rfind("SELECT") :]
            names = dates if dates is not None else ("date",) if last.startswith(("SELECT entity, date", "SELECT date")) else ()
            swaps = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in names)
            ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if swaps else sql
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded: those named as asked, others to six digits; negative zeros become zero."""
    out = {c: F.round(F.col(c), digits.get(c, 6)) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
    return df.withColumns(out)


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def over(f: str, x: str, n: int, least: int, shift: int = 0) -> str:
    """SQL of a rolling aggregate over rows of an entity."""
    w = f"OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN {n + shift - 1} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {f}({x}) {w} END"


E_ = "OVER (PARTITION BY entity ORDER BY date)"

