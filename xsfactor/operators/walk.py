"""Walk-forward with any model: windows of training rows and the dates that they predict meet in a cogrouped map.

Time is cut in stretches. A stretch's test dates need the training rows from `days` before its first date to the day before
its last, so a training row goes to the few stretches whose windows hold it (days / stretch + 2 at most), where neighbouring
dates share it. A task holds one stretch's window, whatever the length of the history, and fits a model a date. A model
from a factory is anything with fit(X, y) and predict(X).

Models with of_sums(n, sums, scaled) don't need rows: they get the window's sums (see models.py), so no task holds a window.
Robust ones (in_passes) weigh rows where they are, pass by pass (see passes.py), unless the whole table is HELD rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from .models import predicted, ridge, windowed
from .passes import fitted, numbers, ordinals


#: A table of so many rows may be a task's; that is quicker than passes, and the number doesn't grow with the input.
HELD = 500_000


class Ridge:
    """Squared error with a penalty on the slopes."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        self.mx, self.my = x.mean(0), y.mean()
        c = x - self.mx
        self.beta = np.linalg.solve(c.T @ c + self.alpha * np.eye(x.shape[1]), c.T @ (y - self.my))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.my + (x - self.mx) @ self.beta

    def of_sums(self, n: float, st: np.ndarray, scaled: bool) -> np.ndarray:
        """Intercept and slopes from a window's sums."""
        return ridge(n, st, self.alpha, scaled)


class ElasticNet(Ridge):
    """Half the mean squared error, with l1 * alpha on absolute and (1 - l1) * alpha / 2 on squared slopes; coordinate descent on rows."""

    def __init__(self, alpha: float = 1.0, l1: float = 0.5, rounds: int = 5000, tol: float = 1e-10):
        self.alpha, self.l1, self.rounds, self.tol = alpha, l1, rounds, tol

    of_sums = None  # fitted on rows

    def fit(self, x: np.ndarray, y: np.ndarray) -> ElasticNet:
        self.mx, self.my = x.mean(0), y.mean()
        c, rest, n = x - self.mx, y - self.my, len(x)
        size = (c**2).sum(0) / n
        self.beta = np.zeros(x.shape[1])
        for _ in range(self.rounds):
            most = 0.0
            for j in range(len(self.beta)):
                g = c[:, j] @ rest / n + size[j] * self.beta[j]
                new = np.sign(g) * max(abs(g) - self.alpha * self.l1, 0.0) / (size[j] + self.alpha * (1 - self.l1) or 1.0)
                rest -= c[:, j] * (new - self.beta[j])
                most, self.beta[j] = max(most, abs(new - self.beta[j])), new
            if most < self.tol:
                break
        return self


class Huber(Ridge):
    """Squared error near zero, absolute error beyond `width` robust deviations: rows are weighed anew until slopes settle."""

    def __init__(self, width: float = 1.345, alpha: float = 1e-6, rounds: int = 50, tol: float = 1e-10):
        self.width, self.alpha, self.rounds, self.tol = width, alpha, rounds, tol

    of_sums, in_passes = None, True  # weights hang on each row

    def fit(self, x: np.ndarray, y: np.ndarray) -> Huber:
        w, self.beta = np.ones(len(y)), np.full(x.shape[1], np.inf)
        for _ in range(self.rounds):
            before = self.beta
            self.mx, self.my = w @ x / w.sum(), w @ y / w.sum()
            c = x - self.mx
            self.beta = np.linalg.solve((c * w[:, None]).T @ c + self.alpha * np.eye(x.shape[1]), (c * w[:, None]).T @ (y - self.my))
            off = np.abs(y - self.predict(x))
            scale = np.median(off) / 0.6745 + 1e-12
            w = np.minimum(1.0, self.width * scale / np.maximum(off, 1e-12))
            if np.abs(self.beta - before).max() < self.tol:
                break
        return self


def stretches(date: Column, days: int, stretch: int) -> Column:
    """The stretches whose test dates see a training row of that date."""
    d = F.unix_date(date)
    return F.sequence(F.floor((d + 1) / stretch), F.floor((d + days) / stretch))


def met(train: DataFrame, test: DataFrame, keys: list[str], days: int, stretch: int, run: Callable, schema: str) -> DataFrame:
    """run(key, training rows by date, test rows by date) for each stretch (and keys) with test rows."""
    # Both sides come from the same rows, so one side's columns get names of their own.
    t = train.select(*(F.col(c).alias(c) for c in train.columns), F.explode(stretches(F.col("date"), days, stretch)).alias("_stretch"))
    s = test.withColumn("_stretch", F.floor(F.unix_date("date") / stretch))

    def sorted_run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key, left.sort_by([("date", "ascending")]), right.sort_by([("date", "ascending"), ("entity", "ascending")]))

    return t.groupBy(*keys, "_stretch").cogroup(s.groupBy(*keys, "_stretch")).applyInArrow(sorted_run, schema)


def windows(have: np.ndarray, dates: np.ndarray, days: int) -> Iterator[tuple[slice, slice]]:
    """For each different test date its training rows (days before it, not itself) and its own rows; both sorted by date."""
    for d in np.unique(dates):
        yield slice(*np.searchsorted(have, [d - days, d])), slice(*np.searchsorted(dates, [d, d + 1]))


def walk_forward(
    df: DataFrame, factors: list[str] | dict[str, list[str]], y: str, days: int, factory: Callable, least: int = 800, per_factor: int = 15,
    by: str | None = None, scaled: bool = True, stretch: int | None = None,
) -> DataFrame:
    """Rows (entity, date, [by,] y_true, y_pred, n_train), a model a date (and group) from the calendar window before it.

    factors: names, or by group its own. A date is predicted if its window has `least` complete rows, and per_factor for each
    factor. scaled: factors at zero mean and unit deviation in the window. A missing label of a test row stays missing.
    """
    xs = factors if isinstance(factors, list) else sorted({f for fs in factors.values() for f in fs})
    keys = [by] if by else []
    rows = df.select("entity", "date", *keys, F.col(y).cast("double").alias("y_true"), *(F.col(x).cast("double").alias(x) for x in xs))
    if isinstance(factors, dict):
        rows = rows.where(F.col(by).isin([g for g, fs in factors.items() if fs]))
    if getattr(factory(), "of_sums", None):
        return from_sums(rows, factors, xs, days, factory, least, per_factor, by, scaled)
    if getattr(factory(), "in_passes", False) and rows.count() > HELD:
        return from_passes(rows, factors, xs, days, factory, least, per_factor, by, scaled)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("entity", "date", *keys)) + ", y_true double, y_pred double, n_train long"

    def run(key: tuple, train: pa.Table, test: pa.Table) -> pa.Table:
        own = factors if isinstance(factors, list) else factors[key[0].as_py()]
        x, known = numbers(train, own), numbers(train, ["y_true"])[:, 0]
        full = np.isfinite(x).all(1) & np.isfinite(known)
        x, known, have = x[full], known[full], ordinals(train)[full]
        ok = np.isfinite(numbers(test, own)).all(1)
        test = test.filter(pa.array(ok))
        new, dates = numbers(test, own), ordinals(test)
        guess, n_train = np.full(len(test), np.nan), np.zeros(len(test), dtype=np.int64)
        for was, now in windows(have, dates, days):
            n = was.stop - was.start
            if n < max(least, per_factor * len(own)):
                continue
            a, b = x[was], new[now]
            if scaled:
                mean, sd = a.mean(0), a.std(0)
                sd = np.where(sd > 0, sd, 1.0)
                a, b = (a - mean) / sd, (b - mean) / sd
            guess[now], n_train[now] = factory().fit(a, known[was]).predict(b), n
        done = pa.array(n_train > 0)
        out = test.select(["entity", "date", *keys, "y_true"]).append_column("y_pred", pa.array(guess)).append_column("n_train", pa.array(n_train))
        return out.filter(done)

    train = rows.dropna(subset=["y_true"]).drop("entity")
    return met(train, rows, keys, days, stretch or max(1, days // 4), run, schema)


def from_sums(rows: DataFrame, factors: list[str] | dict[str, list[str]], xs: list[str], days: int, factory: Callable, least: int, per_factor: int, by: str | None, scaled: bool) -> DataFrame:
    """walk_forward() for models that a window's sums determine: rows are added up by date where they are read."""

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, st: pd.Series) -> pd.Series:
        return pd.Series([factory().of_sums(k, np.asarray(s), scaled) for k, s in zip(n, st, strict=True)])

    keys = [by] if by else []
    rows = durable(rows.select("entity", "date", *keys, F.col("y_true"), *map(finite, xs)), "rows")  # sums and predictions read it

    def betas(mine: DataFrame, g: str | None, own: list[str]) -> DataFrame:
        sums = windowed(mine.withColumn("_y", finite("y_true")), own, "_y", days, *keys).where(F.col("n") >= max(least, per_factor * len(own), 1))
        return sums.select(*keys, "date", "n", solve("n", "st").alias("beta"))

    return foretold(rows, betas, factors, by)


def from_passes(rows: DataFrame, factors: list[str] | dict[str, list[str]], xs: list[str], days: int, factory: Callable, least: int, per_factor: int, by: str | None, scaled: bool) -> DataFrame:
    """walk_forward() for robust models: rows are dealt evenly and sorted by date once, and read again by each pass."""
    keys, spark = [by] if by else [], rows.sparkSession
    rows = rows.select("entity", "date", *keys, F.col("y_true"), *map(finite, xs)).repartition(2 * spark.sparkContext.defaultParallelism, "entity", "date")
    rows = durable(rows.sortWithinPartitions(*keys, "date"), "rows")
    of = lambda g: factors[g] if isinstance(factors, dict) else factors
    wanted = [(r[by] if by else None, r["date"]) for r in rows.where("date is not null").select(*keys, "date").distinct().collect()]  # a row a date
    wanted = [(g, d, of(g), max(least, per_factor * len(of(g)))) for g, d in sorted(wanted, key=str)]
    found = fitted(rows.select("date", *keys, "y_true", *xs), wanted, by, "y_true", days, factory(), scaled)
    kinds = dict(rows.dtypes)
    lines = spark.createDataFrame([((g,) if by else ()) + (d, n, line) for g, d, n, line in found], ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + "date date, n long, beta array<double>")
    return foretold(rows, lambda mine, g, own: lines if g is None else lines.where(F.col(by) == g), factors, by)


def finite(x: str) -> Column:
    return F.when((F.abs(x) < float("inf")) & ~F.isnan(x), F.col(x)).alias(x)


def foretold(rows: DataFrame, betas: Callable, factors: list[str] | dict[str, list[str]], by: str | None) -> DataFrame:
    """Predictions of rows from betas(rows of a group, group, its factors): (keys, date, n, beta)."""
    out, keys = None, [by] if by else []
    for g, own in sorted((g, fs) for g, fs in factors.items() if fs) if isinstance(factors, dict) else [(None, factors)]:
        mine = rows.where(F.col(by) == g) if isinstance(factors, dict) else rows
        told = predicted(mine, betas(mine, g, own), own, *keys)
        told = told.select("entity", "date", *keys, "y_true", "y_pred", F.col("n_train").cast("long").alias("n_train"))
        out = told if out is None else out.unionByName(told)
    return out if out is not None else rows.select("entity", "date", *keys, "y_true", F.lit(None).cast("double").alias("y_pred"), F.lit(0).cast("long").alias("n_train")).limit(0)


class Booster:
    """Squared error boosting on binned features, from cells: rows with equal bins, of which only count and sum of labels matter.

    As every row of a cell gets the same prediction, the gradients of a cell are its sum of labels less count times
    prediction, and trees grown from cells are those grown from rows.
    """

    def __init__(self, bins: int, trees: int = 200, rate: float = 0.05, depth: int = 3):
        self.bins, self.trees, self.rate, self.depth = bins, trees, rate, depth

    def fit(self, cells: np.ndarray, n: np.ndarray, total: np.ndarray) -> Booster:
        self.start = total.sum() / n.sum()
        at, self.grown = np.full(len(cells), self.start), []
        for _ in range(self.trees):
            tree, leaf = self.grow(cells, n, total - n * at)
            self.grown.append(tree)
            at = at + leaf
        return self

    def grow(self, cells: np.ndarray, n: np.ndarray, g: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """Levels (feature, last bin to the left) by node, the leaves' values, and each cell's."""
        node, levels, p, b = np.zeros(len(cells), dtype=np.int64), [], cells.shape[1], self.bins
        for depth in range(self.depth):
            nodes = 1 << depth
            best, feature, split = np.full(nodes, 1e-12), np.zeros(nodes, dtype=np.int64), np.full(nodes, b - 1)
            for f in range(p):
                spot = node * b + cells[:, f]
                left_n = np.bincount(spot, n, nodes * b).reshape(nodes, b).cumsum(1)
                left_g = np.bincount(spot, g, nodes * b).reshape(nodes, b).cumsum(1)
                all_n, all_g = left_n[:, -1:], left_g[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = left_g**2 / left_n + (all_g - left_g) ** 2 / (all_n - left_n) - all_g**2 / all_n
                gain = np.where((left_n > 0) & (left_n < all_n), gain, -np.inf)
                at = gain.argmax(1)
                more = gain[np.arange(nodes), at] > best * (1 + 1e-9)
                best, feature, split = np.where(more, gain[np.arange(nodes), at], best), np.where(more, f, feature), np.where(more, at, split)
            levels.append((feature, split))
            node = 2 * node + (cells[np.arange(len(cells)), feature[node]] > split[node])
        leaves = 1 << self.depth
        count, total = np.bincount(node, n, leaves), np.bincount(node, g, leaves)
        value = self.rate * np.divide(total, count, out=np.zeros(leaves), where=count > 0)
        return (levels, value), value[node]

    def predict(self, cells: np.ndarray) -> np.ndarray:
        out = np.full(len(cells), self.start)
        for levels, value in self.grown:
            node = np.zeros(len(cells), dtype=np.int64)
            for feature, split in levels:
                node = 2 * node + (cells[np.arange(len(cells)), feature[node]] > split[node])
            out += value[node]
        return out


def binned(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal bins between two values; what is beyond goes to the outer ones."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)))).cast("int")


def boosted_walk_forward(
    df: DataFrame, xs: list[str], y: str, days: int, least: int = 800, trees: int = 200, rate: float = 0.05, depth: int = 3, bins: int = 32,
    low: float = -3.0, high: float = 3.0, stretch: int | None = None,
) -> DataFrame:
    """M7: rows (entity, date, y_true, y_pred, n_train), a boosted model a date from the calendar window before it.

    Factors are standardised by date, so bins are fixed beforehand and no later date shapes them. A date's training rows
    become cells (bins, count, sum of labels) where they are read; a window's cells are added up as its first date goes and
    its next one comes, and the trees are grown anew for each date. Dates whose window has fewer than `least` rows are left out.
    """
    cell = [f"_b{k}" for k in range(len(xs))]
    rows = df.dropna(subset=xs).select("entity", "date", F.col(y).cast("double").alias("y_true"), *(binned(F.col(x), low, high, bins).alias(c) for x, c in zip(xs, cell, strict=True)))
    rows = rows.dropna(subset=cell)
    cells = rows.dropna(subset=["y_true"]).groupBy("date", *cell).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("y_true").alias("_sum"))
    kind = dict(rows.dtypes)["entity"]

    def run(key: tuple, train: pa.Table, test: pa.Table) -> pa.Table:
        have, dates = ordinals(train), ordinals(test)
        b, new = numbers(train, cell).astype(np.int64), numbers(test, cell).astype(np.int64)
        each, which = np.unique(b, axis=0, return_inverse=True)
        n, total = numbers(train, ["_n"])[:, 0], numbers(train, ["_sum"])[:, 0]
        count, summed, held = np.zeros(len(each)), np.zeros(len(each)), slice(0, 0)
        guess, n_train = np.full(len(test), np.nan), np.zeros(len(test), dtype=np.int64)
        for was, now in windows(have, dates, days):
            for part, sign in ((slice(held.stop, was.stop), 1.0), (slice(held.start, was.start), -1.0)):
                np.add.at(count, which[part], sign * n[part])
                np.add.at(summed, which[part], sign * total[part])
            held = was
            if count.sum() < max(least, 1):
                continue
            live = count > 0.5
            guess[now], n_train[now] = Booster(bins, trees, rate, depth).fit(each[live], count[live], summed[live]).predict(new[now]), round(count.sum())
        out = test.select(["entity", "date", "y_true"]).append_column("y_pred", pa.array(guess)).append_column("n_train", pa.array(n_train))
        return out.filter(pa.array(n_train > 0))

    return met(cells, rows, [], days, stretch or max(1, days // 4), run, f"entity {kind}, date date, y_true double, y_pred double, n_train long")
