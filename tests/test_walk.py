"""Walk-forward with any model and boosting against plain loops over rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from xsfactor.operators import models as M
from xsfactor.operators import passes
from xsfactor.operators import walk as W

DAY0 = dt.date(2000, 1, 1)


def made_up(n_dates=30, names=12, seed=0, gap=7):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_dates):
        for e in range(names):
            a, b = rng.normal(size=2)
            y = 0.8 * a - 0.3 * b + 0.5 * a * b + rng.standard_t(2) * 0.5
            rows.append((e, DAY0 + dt.timedelta(days=gap * k), "up" if (k // 4) % 2 else "down", a, b if rng.random() > 0.05 else None, y if rng.random() > 0.05 else None))
    return pd.DataFrame(rows, columns=["entity", "date", "regime", "a", "b", "y"])


def frame(spark, pdf, parts=3):
    schema = "entity long, date date, regime string, a double, b double, y double"
    return spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], schema).repartition(parts)


def looped(pdf, days, least, factory, xs=("a", "b"), scaled=True):
    out = {}
    for d in sorted(pdf.date.unique()):
        have = pdf[(pdf.date < d) & (pdf.date >= d - dt.timedelta(days=days))].dropna(subset=[*xs, "y"])
        test = pdf[pdf.date == d].dropna(subset=list(xs))
        if len(have) < least or not len(test):
            continue
        x, z = have[list(xs)].to_numpy(), test[list(xs)].to_numpy()
        if scaled:
            x, z = (x - x.mean(0)) / x.std(0), (z - have[list(xs)].to_numpy().mean(0)) / have[list(xs)].to_numpy().std(0)
        for e, p in zip(test.entity, factory().fit(x, have.y.to_numpy()).predict(z), strict=True):
            out[e, d] = (p, len(have))
    return out


def same(got, want):
    assert {(r.entity, r.date) for r in got.itertuples()} == set(want) and len(got) == len(want) > 100
    for r in got.itertuples():
        p, n = want[r.entity, r.date]
        assert abs(r.y_pred - p) < 1e-7 and r.n_train == n


@pytest.mark.parametrize("stretch", [1, 30, 500])
@pytest.mark.parametrize("factory", [W.Ridge, W.Huber, lambda: W.ElasticNet(0.05, 0.5)])
def test_any_model(spark, factory, stretch):
    pdf = made_up()
    got = W.walk_forward(frame(spark, pdf), ["a", "b"], "y", 60, factory, 40, stretch=stretch).toPandas()
    same(got, looped(pdf, 60, 40, factory))
    assert got.y_true.isna().any()


def test_factors_of_each_regime(spark):
    pdf = made_up(40)
    own = {"up": ["a", "b"], "down": ["b"], "none": []}
    got = W.walk_forward(frame(spark, pdf), own, "y", 120, W.Ridge, 30, 5, by="regime").toPandas()
    want = {}
    for g, xs in list(own.items())[:2]:
        want |= looped(pdf[pdf.regime == g], 120, max(30, 5 * len(xs)), W.Ridge, xs)
    same(got, want)
    assert got.groupby("regime").size().min() > 50
    assert W.walk_forward(frame(spark, pdf.head(0)), own, "y", 120, W.Ridge, by="regime").count() == 0


def test_sums_and_rows_give_the_same_elastic_net(spark):
    pdf = made_up(20)
    rows = W.walk_forward(frame(spark, pdf), ["a", "b"], "y", 60, lambda: W.ElasticNet(0.1, 0.7), 40).toPandas().set_index(["entity", "date"]).sort_index()
    sums = M.model_grid(frame(spark, pdf), ["a", "b"], "y", [30, 60], [0.1, 0.2], 40, [0.7, 0.1]).where("days = 60 and alpha = 0.1 and l1 = 0.7").toPandas().set_index(["entity", "date"]).sort_index()
    assert np.abs(rows.y_pred - sums.y_pred).max() < 1e-6 and len(rows) == len(sums) > 100


def test_a_robust_model_minds_no_outliers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1))
    y = 2 * x[:, 0] + rng.normal(size=400) * 0.1
    y[::20] += 50
    assert abs(W.Huber().fit(x, y).beta[0] - 2) < 0.05 < abs(W.Ridge().fit(x, y).beta[0] - 2) + 0.05


class RowBooster:
    """Trees grown from rows, one threshold after another."""

    def __init__(self, trees, rate, depth):
        self.trees, self.rate, self.depth = trees, rate, depth

    def grown(self, x, g, at, depth):
        if depth == 0:
            return self.rate * g[at].mean()
        best = (1e-12, None)
        for f in range(x.shape[1]):
            for s in sorted(set(x[at, f]))[:-1]:
                left, right = at[x[at, f] <= s], at[x[at, f] > s]
                gain = g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[at].sum() ** 2 / len(at)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, s, left, right))
        if best[1] is None:
            return self.grown(x, g, at, depth - 1)
        f, s, left, right = best[1]
        return f, s, self.grown(x, g, left, depth - 1), self.grown(x, g, right, depth - 1)

    def of(self, tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def fit(self, x, y):
        self.start, self.forest = y.mean(), []
        guess = np.full(len(y), self.start)
        for _ in range(self.trees):
            tree = self.grown(x, y - guess, np.arange(len(y)), self.depth)
            self.forest.append(tree)
            guess = guess + np.array([self.of(tree, r) for r in x])
        return self

    def predict(self, x):
        return np.array([self.start + sum(self.of(t, r) for t in self.forest) for r in x])


@pytest.mark.parametrize(("stretch", "bins"), [(10, 8), (400, 32)])
def test_boosting_by_date(spark, stretch, bins):
    pdf = made_up(16, 10, 5)
    got = W.boosted_walk_forward(frame(spark, pdf), ["a", "b"], "y", 50, 40, trees=12, rate=0.2, bins=bins, stretch=stretch).toPandas()
    cut = pdf.copy()
    for x in ("a", "b"):
        cut[x] = np.floor((cut[x] + 3) / (6 / bins)).clip(0, bins - 1)
    want = looped(cut, 50, 40, lambda: RowBooster(12, 0.2, 3), scaled=False)
    assert {(r.entity, r.date) for r in got.itertuples()} == set(want)
    off = [abs(r.y_pred - want[r.entity, r.date][0]) for r in got.itertuples()]
    assert max(off) < 1e-9 and all(r.n_train == want[r.entity, r.date][1] for r in got.itertuples())
    assert W.boosted_walk_forward(frame(spark, pdf.head(0)), ["a"], "y", 50).count() == 0


def test_boosting_finds_what_lines_cannot():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 16, (2000, 2))
    y = np.where((cells[:, 0] > 7) == (cells[:, 1] > 3), 1.0, -1.0)
    model = W.Booster(16, 60, 0.2).fit(cells, np.ones(2000), y)
    assert np.abs(model.predict(cells) - y).mean() < 0.05


@pytest.mark.parametrize("by", [None, "regime"])
def test_robust_models_move_no_windows(spark, by, monkeypatch):
    monkeypatch.setattr(W, "HELD", 0)
    monkeypatch.setattr(passes, "NAMED", 4)  # so that bounds close in, and ties fill single cells
    pdf = made_up(24, 10, 7)
    pdf["y"] = pdf.y.round(0 if by is None else 3)
    own = ["a", "b"] if by is None else {"up": ["a", "b"], "down": ["b"]}
    held = type("Held", (W.Huber,), {"in_passes": False})
    got, want = (W.walk_forward(frame(spark, pdf), own, "y", 90, f, 30, 5, by=by) for f in (W.Huber, held))
    plan = lambda p: p._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan(got) and "FlatMapCoGroups" in plan(want)
    got, want = ({(r["date"], r["entity"]): r for r in p.collect()} for p in (got, want))
    assert set(got) == set(want) and len(got) > 100
    assert all(abs(r["y_pred"] - want[k]["y_pred"]) < 1e-8 and r["n_train"] == want[k]["n_train"] for k, r in got.items())


@pytest.mark.parametrize("values", [[3.0], [0.0, 0.0, 5.0], [1.0, 2.0], [2.0] * 40, [1.0] * 20 + [7.0] * 20, list(np.random.default_rng(1).exponential(size=501)), [0.5, np.inf, np.inf]])
@pytest.mark.parametrize("bounds", [(0.0, 1.0), (1.0, 1.5), (40.0, 50.0), (0.0, 5e-324)])
def test_bounds_close_in_on_the_median(monkeypatch, values, bounds):
    monkeypatch.setattr(passes, "NAMED", 8)
    values, now = np.array(values), tuple(map(passes.bits, bounds))
    for _ in range(40):
        halves = [passes.Tally((0, 0, "median", None, None, (0.0, np.zeros(0)), np.inf, now, len(values))) for _ in range(2)]
        for part, k in zip(halves, (slice(0, 3), slice(3, None)), strict=True):
            if len(values[k]):
                part.add(np.zeros((0, len(values[k]))), values[k])
        near = None if any(p.row()[4] is None for p in halves) else np.concatenate([p.row()[4] for p in halves])
        found, closer = passes.middle(len(values), now, sum(p.counts for p in halves), min(p.above for p in halves), near)
        if closer is None:
            break
        now = tuple(closer)
    assert found == np.median(values)
