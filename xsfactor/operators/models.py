"""Linear models from sufficient statistics, walk-forward by calendar windows.

A date's sums (n, x, y, xx', xy, yy) are one row; a window's are a range frame over these rows, so training rows are read
once whatever the number of windows, and only a p x p system a date (and setting) is solved in Python.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from .cross import average_ranks, correlation
from .stats import ic_summary


def terms(xs: list[str], y: str) -> list[Column]:
    """What a date's sums are of, flattened: x, y, xx', xy, yy."""
    x, of = [F.col(c) for c in xs], F.col(y)
    return [*x, of, *(a * b for a in x for b in x), *(a * of for a in x), of * of]


def sums(df: DataFrame, xs: list[str], y: str, *by: str) -> DataFrame:
    """Rows (by, n, st): the sums over rows complete in label and factors, flattened: x, y, xx', xy, yy."""
    rows = df.dropna(subset=[*xs, y])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*map(F.sum, terms(xs, y))).alias("st"))


def windowed(df: DataFrame, xs: list[str], y: str, days: int, *by: str) -> DataFrame:
    """For each date (and group): the sums over the calendar days before it. Strictly before: no label of the date itself."""
    p = len(xs)
    size = 2 * p + 2 + p * p
    daily = sums(df, xs, y, *by, "date").select(*by, "date", "n", *(F.col("st")[k].alias(f"_{k}") for k in range(size)))
    return over_days(df.select(*by, "date").distinct().join(daily, [*by, "date"], "left"), size, days, *by)


def over_days(dates: DataFrame, size: int, days: int, *by: str) -> DataFrame:
    """windowed() from the dates' own sums n, _0, _1 ...; null on dates without complete rows."""
    w = (Window.partitionBy(*by) if by else Window).orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    return dates.select(*by, "date", total("n").alias("n"), F.array(*(total(f"_{k}") for k in range(size))).alias("st"))


def centred(n: float, st: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, float]:
    """(mean x, mean y, centred xx', centred xy, centred yy) of flattened sums."""
    p = int(round(np.sqrt(len(st) - 1))) - 1
    sx, sy, xx, xy, yy = st[:p], st[p], st[p + 1 : p + 1 + p * p].reshape(p, p), st[p + 1 + p * p : -1], st[-1]
    return sx / n, sy / n, xx - np.outer(sx, sx) / n, xy - sx * sy / n, yy - sy * sy / n


def ridge(n: float, st: np.ndarray, alpha: float, scaled: bool = False) -> np.ndarray:
    """M3: intercept (not penalised) and slopes; scaled: factors at unit population deviation."""
    mx, my, xx, xy, _ = centred(n, st)
    sd = np.sqrt(np.maximum(np.diag(xx) / n, 0)) if scaled else np.ones(len(mx))
    sd = np.where(sd > 0, sd, 1.0)
    beta = np.linalg.solve(xx / np.outer(sd, sd) + alpha * np.eye(len(mx)), xy / sd) / sd
    return np.r_[my - mx @ beta, beta]


def elastic_net(n: float, st: np.ndarray, alpha: float, l1: float, rounds: int = 5000) -> np.ndarray:
    """M5: coordinate descent on the centred sums, factors scaled; the loss is half the mean square."""
    mx, my, xx, xy, _ = centred(n, st)
    sd = np.sqrt(np.maximum(np.diag(xx) / n, 0))
    sd = np.where(sd > 0, sd, 1.0)
    q, c, b = xx / np.outer(sd, sd) / n, xy / sd / n, np.zeros(len(mx))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(b)):
            g = c[j] - q[j] @ b + q[j, j] * b[j]
            new = np.sign(g) * max(abs(g) - alpha * l1, 0.0) / (q[j, j] + alpha * (1 - l1) or 1.0)
            most = max(most, abs(new - b[j]))
            b[j] = new
        if most < 1e-10:
            break
    beta = b / sd
    return np.r_[my - mx @ beta, beta]


def solved(df: DataFrame, alpha: Column | float, least: float, scaled: bool = False, l1: Column | float | None = None) -> DataFrame:
    """df with the coefficients `beta` where there are enough rows; one Arrow UDF over a row a date and setting."""

    @F.pandas_udf("array<double>")
    def solve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            one = lambda n, s, a, b: ridge(n, np.asarray(s), a, scaled) if plain else elastic_net(n, np.asarray(s), a, b)
            yield pd.Series([one(*v) for v in zip(*batch, strict=True)])

    plain = l1 is None
    a, b = (x if isinstance(x, Column) else F.lit(float(x or 0.0)) for x in (alpha, l1))
    return df.where(F.col("n") >= least).withColumn("beta", solve("n", "st", a, b)).drop("st")


def predicted(df: DataFrame, betas: DataFrame, xs: list[str], *by: str) -> DataFrame:
    """Rows complete in factors with y_pred from their date's coefficients; the label may be missing."""
    b = betas.withColumnRenamed("n", "n_train")
    y = F.col("beta")[0]
    for k, x in enumerate(xs):
        y = y + F.col("beta")[k + 1] * F.col(x)
    return df.dropna(subset=xs).join(b, [*by, "date"]).withColumn("y_pred", y).drop("beta")


def walk_forward(df: DataFrame, xs: list[str], y: str, days: int, alpha: float, least: int = 1000, *by: str, scaled: bool = False, l1: float | None = None) -> DataFrame:
    """M1, M2 (by regime), M4, M5: predictions for each date from the calendar window before it."""
    return predicted(df, solved(windowed(df, xs, y, days, *by), alpha, least, scaled, l1), xs, *by)


def walk_forward_by_regime(df: DataFrame, factors: dict[str, list[str]], y: str, days: int, alpha: float, least: int = 800) -> DataFrame:
    """M2: each regime with its own factors; complete rows are those of the regime's factors.

    Rows are read once for the sums of all regimes and once to be predicted; sums and coefficients are a row a date and regime.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    parts, own = [], []
    for i, (g, xs) in enumerate(sorted(factors.items())):
        own.append(functools.reduce(Column.__and__, map(known, xs), F.col("regime") == g))
        full = own[-1] & known(y)
        parts += [F.count_if(full).cast("double").alias(f"_{i}_n"), *(F.sum(F.when(full, c)).alias(f"_{i}_{k}") for k, c in enumerate(terms(xs, y)))]
    daily = durable(df.where(F.col("regime").isin(list(factors))).groupBy("regime", "date").agg(*parts), "regime-sums")
    betas, told = [], F.lit(None).cast("double")
    for i, (g, xs) in enumerate(sorted(factors.items())):
        size = len(terms(xs, y))
        mine = daily.where(F.col("regime") == g).select("regime", "date", F.col(f"_{i}_n").alias("n"), *(F.col(f"_{i}_{k}").alias(f"_{k}") for k in range(size)))
        betas.append(solved(over_days(mine, size, days, "regime"), alpha, least).select("regime", "date", "beta"))
        p = F.col("beta")[0]
        for k, x in enumerate(xs):
            p = p + F.col("beta")[k + 1] * F.col(x)
        told = F.when(own[i], p).otherwise(told)
    rows = df.where(functools.reduce(Column.__or__, own)).join(durable(functools.reduce(DataFrame.unionByName, betas), "betas"), ["regime", "date"])
    return rows.select("entity", "date", "regime", F.col(y).alias("y_true"), told.alias("y_pred"))


def windowed_many(df: DataFrame, xs: list[str], y: str, windows: list[int], *by: str) -> DataFrame:
    """windowed() for several windows at once, with the column days: one scan, the dates' sums exploded by window."""
    p = len(xs)
    size = 2 * p + 2 + p * p
    # One pass: dates without complete rows have null sums.
    full = F.lit(True)
    for c in (*xs, y):
        full = full & F.col(c).isNotNull()
    parts = [F.sum(F.when(full, c)) for c in terms(xs, y)]
    daily = df.groupBy(*by, "date").agg(F.count_if(full).cast("double").alias("n"), *(c.alias(f"_{k}") for k, c in enumerate(parts)))
    each = daily.withColumn("days", F.explode(F.array(*map(F.lit, windows))))
    # A frame's width is a constant, so each window's sums come from its own frame, and a row takes that of its own.
    frame = lambda days: Window.partitionBy(*by, "days").orderBy(F.unix_date("date")).rangeBetween(-days, -1)

    def total(c: str) -> Column:
        out = F.lit(None).cast("double")
        for days in windows:
            out = F.when(F.col("days") == days, F.sum(c).over(frame(days))).otherwise(out)
        return F.coalesce(out, F.lit(0.0))

    return each.select(*by, "date", "days", total("n").alias("n"), F.array(*(total(f"_{k}") for k in range(size))).alias("st"))


def grid_betas(df: DataFrame, xs: list[str], y: str, windows: list[int], alphas: list[float], least: int, l1s: list[float] | None = None) -> DataFrame:
    """Coefficients for each date, window and penalty (and l1 share); the dates' sums are made once."""
    parts = windowed_many(df, xs, y, windows).withColumn("alpha", F.explode(F.array(*map(F.lit, map(float, alphas)))))
    if l1s is None:
        return solved(parts, F.col("alpha"), least)
    return solved(parts.withColumn("l1", F.explode(F.array(*map(F.lit, map(float, l1s))))), F.col("alpha"), least, l1=F.col("l1"))


def model_grid(df: DataFrame, xs: list[str], y: str, windows: list[int], alphas: list[float], least: int, l1s: list[float] | None = None) -> DataFrame:
    """Predictions for each window and penalty (and l1 share)."""
    return predicted(df, grid_betas(df, xs, y, windows, alphas, least, l1s), xs)


def model_grid_by_regime(df: DataFrame, factors: dict[str, list[str]], y: str, windows: list[int], alphas: list[float], least: int = 800) -> DataFrame:
    """M15, and M14 with regimes: each regime with its own factors and training rows, for each window and penalty."""
    out = None
    for g, xs in sorted(factors.items()):
        p = model_grid(df.where(F.col("regime") == g), xs, y, windows, alphas, least).select("entity", "date", "regime", "days", "alpha", F.col(y).alias("y_true"), "y_pred")
        out = p if out is None else out.unionByName(p)
    return out


def marked(p: DataFrame, keys: list[str], top: int, bottom: int, score: str) -> DataFrame:
    """Rows (keys, k, side, entity, y_true, ic, n): of each group and prediction k its rank correlation (side 'ic') and its legs.

    score: one prediction (null: ranked last), or an array of them (null: the row isn't of that setting). Rows move once,
    whatever the number of predictions, and a task holds the names of one date.
    """
    listed, kind = dict(p.dtypes)[score].startswith("array"), dict(p.dtypes)["entity"]
    rows = p.select(*keys, "entity", F.col("y_true").cast("double").alias("y_true"), (F.col(score) if listed else F.array(score)).alias("_s"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", k int, side string, entity {kind}, y_true double, ic double, n long"

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("entity", "ascending")]))
        y, flat = table["y_true"].combine_chunks(), table["_s"].combine_chunks().flatten()
        known = y.is_valid().to_numpy(zero_copy_only=False)
        y = y.to_numpy(zero_copy_only=False)
        there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        scores = flat.to_numpy(zero_copy_only=False).reshape(len(table), -1)
        real = average_ranks(y[known])
        out, names = [], table.select([*keys, "entity", "y_true"])
        for k in range(scores.shape[1]):
            mine = np.flatnonzero(there[:, k]) if listed else np.arange(len(table))
            if not len(mine):
                continue
            told = there[mine, k] & known[mine]
            s = np.where(there[mine, k], scores[mine, k], -np.inf)
            both = mine[told]
            ic = correlation(average_ranks(s[told]), real if len(both) == len(real) else average_ranks(y[both])) if len(both) else None
            out.append(part(names.slice(0, 1), k, "ic", ic, len(both)))
            if len(mine) >= max(1, top // 2, bottom // 2):
                best = mine[np.argsort(-s, kind="stable")]
                for side, leg in (("long", best[:top]), ("short", best[::-1][:bottom])):
                    out.append(part(names.take(pa.array(leg)), k, side, None, len(mine)))
        return pa.concat_tables(out) if out else part(names.slice(0, 0), 0, "ic", None, 0)

    def part(names: pa.Table, k: int, side: str, ic: float | None, n: int) -> pa.Table:
        m = len(names)
        columns = [names[c] for c in keys] + [pa.array([k] * m, pa.int32()), pa.array([side] * m, pa.string()), names["entity"], names["y_true"], pa.array([ic] * m, pa.float64()), pa.array([n] * m, pa.int64())]
        return pa.table(columns, names=[*keys, "k", "side", "entity", "y_true", "ic", "n"])

    return durable(rows.groupBy(*keys).applyInArrow(run, schema), "marked")


def figures(rows: DataFrame, *by: str, cost_bps: float = 0.0, year: float = 252.0) -> DataFrame:
    """The summary of marked(): by group, correlations and the returns of the legs less costs."""
    keys = [*by, "date"]
    daily = rows.where("side = 'ic' and n >= 2 and ic is not null").withColumn("ic", F.round("ic", 12))
    ic = ic_summary(daily, *by).select(*by, "ic_mean", "ic_std", "ic_ir", F.col("win_rate").alias("ic_win_rate"), F.col("n").alias("n_days"))
    held = rows.where("side != 'ic'").select(*keys, "entity", "y_true", "side")
    held = held.join(held.select(*keys).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("date"))), keys)
    was = held.select(*by, "side", "entity", (F.col("_i") + 1).alias("_i"), F.lit(1).alias("_kept"))
    legs = held.join(was, [*by, "side", "entity", "_i"], "left").groupBy(*keys).pivot("side", ["long", "short"]).agg(F.avg("y_true").alias("r"), F.avg(F.coalesce("_kept", F.lit(0))).alias("kept"))
    ls = F.col("long_r") - F.col("short_r") - cost_bps / 10000 * (2 - F.col("long_kept") - F.col("short_kept"))
    m, sd = F.avg("ls"), F.stddev_samp("ls")
    out = legs.withColumn("ls", ls).groupBy(*by).agg(F.avg("long_r").alias("long_mean"), F.avg("short_r").alias("short_mean"), m.alias("ls_mean"), (m * year).alias("ls_ann"), (m / (sd + 1e-12) * year**0.5).alias("ls_ir"))
    return ic.join(out, list(by), "left")


def graded(p: DataFrame, *by: str, top: int = 30, bottom: int = 30, cost_bps: float = 0.0, year: float = 252.0) -> DataFrame:
    """For each setting, rank correlations by date and the returns of the best names over the worst, less costs.

    Turnover is against the setting's last date before; dates with less than half a leg have no returns.
    """
    return figures(marked(p, [*by, "date"], top, bottom, "y_pred").drop("k"), *by, cost_bps=cost_bps, year=year)


def graded_grid(
    df: DataFrame, factors: list[str] | dict[str, list[str]], y: str, windows: list[int], alphas: list[float], least: int, l1s: list[float] | None = None,
    top: int = 30, bottom: int = 30, cost_bps: float = 0.0, year: float = 252.0,
) -> DataFrame:
    """graded() of model_grid(), or of model_grid_by_regime() for factors by regime, by days, alpha (and l1); predictions to nine digits.

    A panel row is not repeated by setting: it gets one array of predictions, from its date's coefficients of all settings.
    """
    names = ["days", "alpha"] if l1s is None else ["days", "alpha", "l1"]
    lists = [list(windows), list(map(float, alphas)), *([] if l1s is None else [list(map(float, l1s))])]
    place = F.lit(0)
    for name, values in zip(names, lists, strict=True):
        place = place * len(values) + (F.array_position(F.array(*map(F.lit, values)), F.col(name)) - 1)
    settings = list(itertools.product(*lists))
    parts = []
    for g, xs in sorted(factors.items()) if isinstance(factors, dict) else [(None, factors)]:
        own = df if g is None else df.where(F.col("regime") == g)
        betas = grid_betas(own, xs, y, windows, alphas, least, l1s).withColumn("_k", place.cast("int"))
        one = betas.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("_k", "beta"))).alias("_b"))  # an entry a setting

        def told(b: Column, xs: list[str] = xs) -> Column:
            s = b[0]
            for i, x in enumerate(xs):
                s = s + b[i + 1] * F.col(x)
            return F.round(s, 9)

        s = F.transform(F.array(*map(F.lit, range(len(settings)))), lambda k: told(F.try_element_at("_b", k)))
        parts.append(own.dropna(subset=xs).join(one, "date").select("entity", "date", F.col(y).alias("y_true"), s.alias("y_pred")))
    # A date may have rows of several regimes, so they are ranked together.
    rows = marked(functools.reduce(DataFrame.unionByName, parts), ["date"], top, bottom, "y_pred")
    spark = df.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in enumerate(settings)], "k int, days int, alpha double" + (", l1 double" if l1s is not None else ""))
    return figures(rows.join(F.broadcast(known), "k").drop("k"), *names, cost_bps=cost_bps, year=year)


def daily_ols(df: DataFrame, xs: list[str], y: str, least: int = 10, *by: str) -> DataFrame:
    """M8: by date, intercept and slopes, their t values, R2 and adjusted R2; rows (by, date, n, coef, t, r2, adj_r2)."""

    @F.pandas_udf("coef array<double>, t array<double>, r2 double, adj_r2 double")
    def fit(n: pd.Series, st: pd.Series) -> pd.DataFrame:
        out = []
        for k, s in zip(n, st, strict=True):
            s = np.asarray(s)
            mx, my, xx, xy, yy = centred(k, s)
            p = len(mx)
            inv = np.linalg.pinv(xx)
            beta = inv @ xy
            rss = max(yy - beta @ xy, 0.0)
            s2 = rss / (k - p - 1) if k > p + 1 else np.nan
            se = np.sqrt(np.maximum(np.r_[s2 * (1 / k + mx @ inv @ mx), s2 * np.diag(inv)], 0))
            coef = np.r_[my - mx @ beta, beta]
            r2 = 1 - rss / yy if yy > 0 else None
            out.append((coef.tolist(), [float(c / e) if e > 0 else None for c, e in zip(coef, se, strict=True)], r2, None if r2 is None or k <= p + 1 else 1 - (1 - r2) * (k - 1) / (k - p - 1)))
        return pd.DataFrame(out, columns=["coef", "t", "r2", "adj_r2"])

    return sums(df, xs, y, *by, "date").where(F.col("n") >= least).withColumn("f", fit("n", "st")).select(*by, "date", "n", "f.*")


def slopes(df: DataFrame, x: str, y: str, least: int = 10, *by: str) -> DataFrame:
    """M8 for one factor, with built-in aggregates only; dates on which x doesn't vary are left out."""
    rows = df.dropna(subset=[x, y])
    g = rows.groupBy(*by, "date").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c")
    ).where((F.col("n") >= least) & (F.col("vx") > 0))
    beta = F.col("c") / F.col("vx")
    return g.select(*by, "date", "n", beta.alias("beta"), (F.col("my") - beta * F.col("mx")).alias("alpha"), (F.col("c") * F.col("c") / F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0))).alias("r2"))


def fama_macbeth(daily: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """M9: second pass over daily slopes: mean, deviation, t, and R2's mean and median."""
    m, sd, n = F.avg("beta"), F.stddev_samp("beta"), F.count("beta")
    return daily.groupBy(*by).agg(
        m.alias("beta"), sd.alias("sd"), (m / F.nullif(sd / F.sqrt(n), F.lit(0.0))).alias("t"), n.alias("n"), F.avg("r2").alias("r2"), F.median("r2").alias("r2_median")
    ).where(F.col("n") >= least)


def diagnostics(daily: DataFrame, *by: str, few: int = 15) -> DataFrame:
    """Distribution of R2, stability and sign of slopes, thin dates."""
    m = F.avg("beta")
    pos, neg = F.count_if(F.col("beta") > 0), F.count_if(F.col("beta") < 0)
    return daily.groupBy(*by).agg(
        F.min("r2").alias("r2_min"), F.percentile("r2", F.lit(0.25)).alias("r2_q25"), F.percentile("r2", F.lit(0.75)).alias("r2_q75"), F.max("r2").alias("r2_max"),
        F.count_if(F.col("r2") < 0.05).alias("low_r2"), F.count_if(F.col("r2") > 0.3).alias("high_r2"), (F.stddev_samp("beta") / F.nullif(F.abs(m), F.lit(0.0))).alias("cv"),
        (F.greatest(pos, neg) / F.count("beta")).alias("same_sign"), F.count_if(F.col("n") < few).alias("thin_days"),
    )


def scenario_rows(parameters: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every setting; those without predictions have no metrics and 0 days."""
    return parameters.join(found, keys, "left").withColumn("n_days", F.coalesce("n_days", F.lit(0).cast("long")))
