"""Cross-sections: standardisation, neutralisation and ranks within a date."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.special import normal_quantile
from ..functions.windows import average_rank, zscore


def standardised(df: DataFrame, *xs: str) -> DataFrame:
    """Each x as x_std, its z-score within the date."""
    return df.withColumns({f"{x}_std": zscore(F.col(x), "date") for x in xs})


def standardised_in_place(df: DataFrame, *xs: str) -> DataFrame:
    """standardised() of a table that was made once: each date's means and deviations are one row, and no other row moves."""
    one = [f(x).alias(f"_{k}_{x}") for x in xs for k, f in (("m", F.avg), ("sd", F.stddev_samp))]
    m = durable(df.groupBy(F.col("date").alias("_date")).agg(*one), "moments")
    both = df.join(m, F.col("date").eqNullSafe(F.col("_date")))
    z = {f"{x}_std": F.when(F.col(f"_sd_{x}") > 1e-12, (F.col(x) - F.col(f"_m_{x}")) / F.col(f"_sd_{x}")) for x in xs}
    return both.withColumns(z).select(*df.columns, *z)


def rank_gauss(df: DataFrame, x: str, out: str, least: int = 5) -> DataFrame:
    """Normal scores of average ranks; null on dates with few values."""
    some = F.col(x).isNotNull()
    n = F.sum(some.cast("long")).over(Window.partitionBy("date"))
    p = (average_rank(F.col(x), "date", "_some") - 0.5) / n
    score = normal_quantile(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)))
    return df.withColumn("_some", some).withColumn(out, F.when(some & (n >= least), score)).drop("_some")


def category_rank(df: DataFrame, score: str, by: str = "industry") -> DataFrame:
    """Place in (date, category) by falling score, ties at the best place; percentile 1 for the best."""
    w = Window.partitionBy("date", by)
    return df.withColumn("ind_count", F.count("entity").over(w)).withColumn("ind_rank", F.rank().over(w.orderBy(F.desc(score)))).withColumn(
        "ind_rank_pct", 1 - (F.col("ind_rank") - 1) / F.col("ind_count")
    )


def order(score: str, best_first: bool = True) -> list[Column]:
    """The one order of names on a date: score falling, then entity; no score comes last. The other leg is its tail."""
    return [F.desc_nulls_last(score), F.asc("entity")] if best_first else [F.asc_nulls_first(score), F.desc("entity")]


def membership(df: DataFrame, score: str, top: int, bottom: int) -> DataFrame:
    """Place from either end, and whether the name is in the long or the short leg."""
    up, down = (F.row_number().over(Window.partitionBy("date").orderBy(*order(score, b))) for b in (True, False))
    return df.withColumn("place", up).withColumn("from_end", down).withColumn("in_long", F.col("place") <= top).withColumn("in_short", F.col("from_end") <= bottom)


def neutralised(df: DataFrame, xs: list[str], shrink: float = 1.0, only: list[str] | None = None, by: str = "industry", drop: bool = True) -> DataFrame:
    """X minus shrink times its mean in (date, category), for the named categories or all.

    Rows without a category go (drop) or get null.
    """
    w = Window.partitionBy("date", by)
    inside = F.col(by).isin(only) if only else F.lit(True)
    out = df.withColumns({x: F.when(F.col(by).isNotNull(), F.when(inside, F.col(x) - shrink * F.avg(x).over(w)).otherwise(F.col(x))) for x in xs})
    return out.where(F.col(by).isNotNull()) if drop else out


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Products of factors, standardised within the date."""
    w = Window.partitionBy("date")
    out = df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})
    z = lambda x: (F.col(x) - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-9)
    return out.withColumns({f"{a}_x_{b}": z(f"{a}_x_{b}") for a, b in pairs})


def average_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean; NaN is the largest value and equal to itself."""
    at = np.argsort(v, kind="stable")
    w = v[at]
    begins = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) & ~(np.isnan(w[1:]) & np.isnan(w[:-1]))]) if len(v) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[begins, len(v)])
    out = np.empty(len(v))
    out[at] = np.repeat(begins + (size + 1) / 2.0, size)
    return out


def correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Of average ranks, whose means are exact; none where a side doesn't vary."""
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / size) if size > 0 else None


def daily_ic(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ("date",), least: int = 5) -> DataFrame:
    """Rank correlation by date, over rows with both values; dates with few rows or a constant side are left out.

    Only the two values move, once; a task holds those of one group at a time.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        a, b = (average_ranks(table[c].to_numpy(zero_copy_only=False)) for c in ("_x", "_y"))
        ic = correlation(a, b)
        return table.select(list(by)).slice(0, 1).append_column("ic", pa.array([ic], pa.float64())).append_column("n", pa.array([len(table)], pa.int64()))

    ic = rows.groupBy(*by).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", ic double, n long").withColumn("ic", F.round("ic", 12))
    return ic.where((F.col("n") >= least) & F.col("ic").isNotNull())


def daily_ics(df: DataFrame, xs: list[str], y: str, by: tuple[str, ...] = ("date",), least: int = 5) -> DataFrame:
    """I1 of each of several x, as daily_ic() of them unpivoted: (by, factor, ic, n). A row moves once for all of them."""
    some = functools.reduce(Column.__or__, (F.col(x).isNotNull() for x in xs))
    rows = df.where(F.col(y).isNotNull() & some).select(*by, *(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate((*xs, y))))
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        own, ics, sizes = table[f"_{len(xs)}"].to_numpy(), [], []
        for k in range(len(xs)):
            have = table[f"_{k}"].is_valid().to_numpy()
            a, b = average_ranks(table[f"_{k}"].to_numpy()[have]), average_ranks(own[have])
            ics.append(correlation(a, b) if len(a) else None)
            sizes.append(len(a))
        key = {c: pa.array(table[c].slice(0, 1).to_pylist() * len(xs), table.schema.field(c).type) for c in by}
        return pa.table({**key, "factor": pa.array(xs), "ic": pa.array(ics, pa.float64()), "n": pa.array(sizes, pa.int64())})

    ic = rows.groupBy(*by).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", factor string, ic double, n long").withColumn("ic", F.round("ic", 12))
    return ic.where((F.col("n") >= least) & F.col("ic").isNotNull())


def aligned(df: DataFrame, ics: DataFrame, factors: list[str], least: int = 60) -> DataFrame:
    """Factors whose mean correlation is negative over enough dates change sign; ics: (factor, ic), a row a date."""
    mean = ics.groupBy("factor").agg(F.avg("ic").alias("m"), F.count(F.lit(1)).alias("n"))
    signs = mean.agg(F.map_from_entries(F.collect_list(F.struct("factor", F.when((F.col("m") < 0) & (F.col("n") >= least), -1.0).otherwise(1.0)))).alias("signs")).first()
    known = signs["signs"] or {}  # one value a factor
    return df.withColumns({f: F.col(f) * known.get(f, 1.0) for f in factors})
