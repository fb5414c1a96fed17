"""Queries do the whole job: all entities, all groups, all settings."""

from __future__ import annotations

import datetime as dt
import inspect
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from xsfactor import registry
from xsfactor.functions import special
from xsfactor.operators import models, stats
from xsfactor.plans import ic_queries, model_queries, portfolio_queries


def test_as_of_join_has_all_suppliers(spark, sf):
    got = registry.QUERIES["j9_asof_join"](spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct()
    assert got.select("entity").distinct().count() == lines.count() and got.where("ticks is not null").count()


def test_regime_factors_are_screened_and_decorrelated_by_regime(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(180):
        g = "NORMAL" if i < 80 else "HIGH" if i < 160 else "EXTREME"  # EXTREME has 20 days
        y, noise = rng.normal(size=12), rng.normal(size=(5, 12))
        mom3 = y + noise[0]
        mom6 = mom3 + 0.1 * noise[1] if g == "NORMAL" else y + 1.5 * noise[1]  # like mom3 in NORMAL only
        x = np.array([mom3, mom6, noise[2], -y + 2 * noise[3], noise[4]])
        rows += [(g, dt.date(2020, 1, 1) + dt.timedelta(days=i), j, *map(float, x[:, j]), float(y[j])) for j in range(12)]
    wide = spark.createDataFrame(rows, "regime string, date date, entity long, mom3 double, mom6 double, vol6 double, vr double, amp double, fwd double").cache()
    monkeypatch.setattr(ic_queries, "regime_panel", lambda s, d: wide)
    got = registry.QUERIES["i17_regime_factors"](spark, "").collect()

    frame = wide.toPandas()
    want = []
    for g, part in frame.groupby("regime"):
        found = []
        for f in ic_queries.FACTORS:
            ic = np.array([day[f].rank().corr(day["fwd"].rank()) for _, day in part.groupby("date")])
            t = ic.mean() / (ic.std(ddof=1) / math.sqrt(len(ic)))
            if len(ic) >= 60 and abs(ic.mean()) >= 0.01 and special.t_two_sided(t, len(ic) - 1) < 0.05:
                found.append((-abs(ic.mean()), f))
        kept = []
        for _, f in sorted(found):
            if all(abs(part[f].corr(part[k])) < 0.8 for k in kept):
                kept.append(f)
        want += [(g, i, f) for i, f in enumerate(kept)]
    assert sorted(tuple(r) for r in got) == want
    assert {r["regime"] for r in got} == {"NORMAL", "HIGH"} and sum(r["factor"] in ("mom3", "mom6") for r in got) == 3


def test_screen_uses_p_values(spark, sf, monkeypatch):
    rows = [(f, m + s * (-1) ** i) for f, m, s, n in [("a", 0.2, 0.3, 80), ("b", 0.05, 0.3, 80), ("c", 0.2, 0.3, 50), ("d", 0.005, 0.001, 80)] for i in range(n)]
    monkeypatch.setattr(ic_queries, "ics", lambda s, d: spark.createDataFrame(rows, "factor string, ic double"))
    assert [r["factor"] for r in registry.QUERIES["i15_screen"](spark, sf).collect()] == ["a"]


def ridge_by_hand(train, test, xs, alpha):
    x, y = train[xs].to_numpy(), train["fwd"].to_numpy()
    beta = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(len(xs)), (x - x.mean(0)).T @ (y - y.mean()))
    return y.mean() + (test[xs].to_numpy() - x.mean(0)) @ beta


def test_model_grids_have_regimes_and_all_settings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(70):
        g = ("NORMAL", "HIGH", "EXTREME")[i % 3]
        x = rng.normal(size=(3, 80))
        y = {"NORMAL": x[0], "HIGH": x[2] - x[1], "EXTREME": -x[0]}[g] + rng.normal(size=80)
        rows += [(g, dt.date(2018, 1, 1) + dt.timedelta(days=30 * i), j, *map(float, x[:, j]), float(y[j])) for j in range(80)]
    base = spark.createDataFrame(rows, "regime string, date date, entity long, mom3_std double, vr_std double, amp_std double, fwd double").cache()
    monkeypatch.setattr(model_queries, "standard", lambda s, d, regime=False: base if regime else base.drop("regime"))
    m15 = {(r["days"], r["alpha"]): r for r in registry.QUERIES["m15_regime_specific_grid"](spark, "").collect()}
    m14 = {(r["use_regime"], r["days"], r["alpha"]): r for r in registry.QUERIES["m14_grid_use_regime"](spark, "").collect()}
    # Of a regime, 504 days hold at most 6 x 80 rows and 756 at most 9 x 80: no predictions with 800 or 1000 asked for.
    assert set(m15) == {(1008, a) for a in (0.2, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0)}
    assert set(m14) == {(False, w, a) for w in (504, 756) for a in (0.5, 1.0, 2.0, 5.0)}

    frame = base.toPandas()
    for least, xs, rows_of, windows, got in ((800, model_queries.OWN, True, (1008,), lambda w, a: m15[w, a]), (1000, None, False, (504, 756), lambda w, a: m14[False, w, a])):
        for w in windows:
            ics, ls, held = [], [], (set(), set())
            for day in sorted(frame["date"].unique()):
                test = frame[frame["date"] == day]
                train = frame[(frame["date"] < day) & (frame["date"] >= day - dt.timedelta(days=w))]
                g = test["regime"].iloc[0]
                train = train[train["regime"] == g] if rows_of else train
                if len(train) < least:
                    continue
                p = test.assign(p=ridge_by_hand(train, test, xs[g] if xs else model_queries.XS, 5.0).round(9)).sort_values("p", ascending=False)
                ics.append(p["p"].rank().corr(p["fwd"].rank()))
                now = (set(p["entity"][:30]), set(p["entity"][-30:]))
                turnover = sum(1 - len(a & b) / 30 for a, b in zip(now, held, strict=True))
                held = now
                ls.append(p["fwd"][:30].mean() - p["fwd"][-30:].mean() - (0.0005 if rows_of else 0) * turnover)
            r = got(w, 5.0)
            assert len(ics) == r["n_days"] > 5
            assert r["ic_mean"] == pytest.approx(np.mean(ics), abs=1e-5) and r["ls_mean"] == pytest.approx(np.mean(ls), abs=1e-5)


def test_model_grid_by_regime_trains_on_the_regime(spark):
    rows = [(("A", "B")[i % 2], dt.date(2020, 1, 1) + dt.timedelta(days=i), j, float(j), float(j if i % 2 else -j)) for i in range(20) for j in range(10)]
    df = spark.createDataFrame(rows, "regime string, date date, entity long, x double, y double")
    got = models.model_grid_by_regime(df, {"A": ["x"], "B": ["x"]}, "y", [10, 20], [0.001, 1.0], 20)
    assert got.select("days", "alpha", "regime").distinct().count() == 8
    assert got.where("alpha < 0.1").agg(F.max(F.abs(F.col("y_pred") - F.col("y_true")))).first()[0] < 0.01


def test_boosting_has_200_trees(spark, sf, monkeypatch):
    used, real = [], inspect.signature(model_queries.W.boosted_walk_forward)

    def called(*args, **more):
        used.append(real.bind(*args, **more))
        used[-1].apply_defaults()
        return args[0].withColumn("y_pred", F.lit(0.0))

    monkeypatch.setattr(model_queries.W, "boosted_walk_forward", called)
    registry.QUERIES["m7_boosting"](spark, sf)
    assert [(u.arguments["trees"], u.arguments["rate"], u.arguments["depth"]) for u in used] == [(200, 0.05, 3)]


def test_bootstrap_refuses_small_groups(spark, sf, monkeypatch):
    ics = spark.createDataFrame([(g, dt.date(2020, 1, 1) + dt.timedelta(days=i), math.sin(i)) for g, n in (("A", 29), ("B", 30)) for i in range(n)], "regime string, date date, ic double")
    monkeypatch.setattr(ic_queries, "regime_ics", lambda s, d: ics)
    drawn, real = [], stats.bootstrap
    monkeypatch.setattr(ic_queries.S, "bootstrap", lambda df, x, g, samples=1000, **more: drawn.append(samples) or real(df, x, g, samples, **more))
    assert [r["regime"] for r in registry.QUERIES["i13_bootstrap"](spark, sf).collect()] == ["B"] and drawn == [1000]


def test_bootstrap_does_not_hang_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=int(i) // 2), float(v)) for i, v in enumerate(rng.normal(0.1, 1, 200).round(2))]
    df = spark.createDataFrame(rows, "g string, date date, x double")
    one, four, turned = (stats.bootstrap(d, "x", "g").first() for d in (df.coalesce(1), df.repartition(4), df.orderBy(F.desc("x"))))
    assert (one["low"], one["high"]) == (four["low"], four["high"]) == (turned["low"], turned["high"])
    mean, half = np.mean([r[2] for r in rows]), 1.96 * np.std([r[2] for r in rows]) / 200**0.5
    assert abs(one["low"] - (mean - half)) < 0.03 and abs(one["high"] - (mean + half)) < 0.03


def test_mann_whitney_has_every_pair(spark):
    rng = np.random.default_rng(2)
    data = {"A": rng.normal(size=20).round(1), "B": rng.normal(0.5, 1, 25).round(1), "C": rng.normal(size=6)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "regime string, ic double")
    got = {(r["a"], r["b"]): r for r in stats.mann_whitney(df, "ic", "regime").collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "C")}
    for (a, b), r in got.items():
        x, y = data[a], data[b]
        u = sum((i > j) + 0.5 * (i == j) for i in x for j in y)
        n, ties = len(x) + len(y), np.unique(np.r_[x, y], return_counts=True)[1]
        sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
        assert (r["n_a"], r["n_b"], r["u"]) == (len(x), len(y), u)
        assert r["z"] == pytest.approx((u - len(x) * len(y) / 2) / sd)
        assert r["p"] == pytest.approx(special.normal_two_sided((abs(u - len(x) * len(y) / 2) - 0.5) / sd), abs=1e-9) or max(ties) == 1


def test_mann_whitney_exact_by_enumeration():
    us = [sum(x > y for x in pick for y in set(range(9)) - set(pick)) for pick in itertools.combinations(range(9), 4)]
    for u in range(21):
        want = min(1.0, 2 * sum(v >= max(u, 20 - u) for v in us) / len(us))
        assert special.mann_whitney_exact(u, 4, 5) == pytest.approx(want) == special.mann_whitney_exact(u, 5, 4)


def test_policy_grid_has_all_policies(spark, sf, monkeypatch):
    used = []
    monkeypatch.setattr(portfolio_queries.P, "grid", lambda p, settings, costs: used.append((settings, costs)) or p)
    registry.QUERIES["e11_policy_grid"](spark, sf)
    settings, costs = used[0]
    count = {policy: len({(x, n) for k, x, n in settings if k == policy}) for policy in portfolio_queries.P.POLICIES}
    assert count == {"baseline": 3, "low_freq": 9, "hysteresis": 9, "ema": 9, "swap_cap": 9, "combo": 27} and len(costs) == 3


def test_robustness_has_windows(spark, sf, monkeypatch):
    days = []

    def grid(df, xs, y, windows, alphas, least):
        days.extend(windows)
        rows = spark.range(20).select(F.lit("2000-01-01").cast("date").alias("date"), F.col("id").alias("entity"), F.col("id").cast("double").alias("y_pred"), F.lit(1.0).alias("y"))
        return rows.withColumn("days", F.explode(F.array(*map(F.lit, windows))))

    monkeypatch.setattr(model_queries.M, "model_grid", grid)
    got = registry.QUERIES["m18_robustness"](spark, sf)
    assert len(set(days)) == 3 and got.select("start", "days").distinct().count() == 9
