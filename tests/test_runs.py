"""Runs as a whole, ranks over stretches, sessions, and the joins around them, against values worked out by hand."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from xsfactor.functions import special
from xsfactor.operators import portfolio, runs, stats, universe
from xsfactor.plans.run_queries import full_run
from xsfactor.streaming import bars


def test_factors_are_found_by_suffix_then_prefix(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "entity int, a_std double, b_std double, factor_c double")
    assert runs.discovered(df) == ["a_std", "b_std"] and runs.discovered(df, without=("a_std",)) == ["b_std"]
    assert runs.discovered(df.drop("a_std", "b_std")) == ["factor_c"]
    whole, names = runs.mapped(df, {"X": ["b_std", "d_std"], "Y": ["a_std"]})
    assert names == ["a_std", "b_std", "d_std"] and whole.first()["d_std"] is None


def test_status_cache(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "entity int")
    status = spark.createDataFrame([("1_a_b", "done"), ("1_a_b", "done"), ("2_a_b", "failed"), ("3_a_c", "done"), (None, "done")], "key string, status string")
    assert sorted(r["entity"] for r in runs.to_fetch(wanted, status, "a", "b").collect()) == [2, 3]


def test_runs_load_by_id_or_newest(spark):
    m = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run_id string, ls_ir double")
    s = spark.createDataFrame([("r1", dt.date(2020, 1, 1), 0.1), ("r2", dt.date(2020, 1, 1), 0.2), ("r2", dt.date(2020, 1, 2), 0.3)], "run_id string, date date, ls double")
    g = spark.createDataFrame([("r2", dt.date(2020, 1, 2), "HIGH")], "run_id string, date date, regime string")
    get = lambda run: sorted((r["run_id"], r["ls"], r["regime"] or "", r["ls_ir"]) for r in runs.loaded(m, s, g, run).collect())
    assert get("r1") == [("r1", 0.1, "", 1.0)]
    assert get("nope") == get(None) and [x[:2] for x in get(None)] == [("r2", 0.2), ("r2", 0.3)]
    assert runs.highlights(m, ["ls_ir"]).count() == 2


def test_left_joins_keep_rows_and_dont_fan_out(spark):
    events = spark.createDataFrame([(1, dt.date(2020, 1, 1), "open"), (2, dt.date(2020, 1, 1), "open")], "entity int, date date, event string")
    prices = spark.createDataFrame([(1, dt.date(2020, 1, 1), 5.0), (1, dt.date(2020, 1, 1), 5.0)], "entity int, date date, close double")
    assert sorted((r["entity"], r["close"]) for r in runs.priced(events, prices).collect()) == [(1, 5.0), (2, None)]
    assert runs.with_panel(events, prices, "close").count() == 2


@pytest.mark.parametrize("cuts", [1, 7, 256])
def test_ranks_over_stretches(spark, cuts):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=500).round(2), np.zeros(300)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = {r["x"]: (r["ties"], r["before"]) for r in stats.counted(df, "x", cuts).collect()}
    assert got == {v: (int((x == v).sum()), int((x < v).sum())) for v in set(x.tolist())}
    ranks = {r["x"]: r["rank"] for r in stats.ranked(df, "x").collect()}
    assert all(abs(ranks[v] - r) < 1e-9 for v, r in zip(x.tolist(), pd.Series(x).rank(), strict=True))


def test_kolmogorov(spark):
    x = np.sort(np.random.default_rng(1).normal(2, 3, 200).round(1))
    m, s, n = x.mean(), x.std(ddof=1), len(x)
    cdf = np.array([0.5 * math.erfc(-(v - m) / s / math.sqrt(2)) for v in x])
    k = np.arange(1, n + 1)
    got = stats.kolmogorov(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert got["n"] == n and abs(got["d"] - max(np.abs(k / n - cdf).max(), np.abs(cdf - (k - 1) / n).max())) < 1e-6
    z = spark.range(-50, 51).select((F.col("id") / 10).alias("z"))
    assert all(abs(r["c"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 2e-7 for r in z.withColumn("c", special.normal_cdf(F.col("z"))).collect())


def test_shapiro_wilk_of_published_weights(spark):
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = stats.shapiro_wilk(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x").first()
    assert got["n"] == 11 and got["w"] == pytest.approx(0.78881, abs=1e-4) and got["p"] == pytest.approx(0.006704, abs=2e-4)
    even = stats.shapiro_wilk(spark.range(1, 41).select(special.normal_quantile(F.col("id") / 41.0).alias("x")), "x").first()
    assert even["w"] > 0.99 and even["p"] > 0.9


def test_all_rows_where_none_passes(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert universe.or_all(df, F.col("x") > 1).count() == 1 and universe.or_all(df, F.col("x") > 5).count() == 3
    assert universe.or_all(df.limit(0), F.col("x") > 5).count() == 0


def test_sessions(spark, tmp_path):
    t0 = dt.datetime(2020, 1, 1)
    at = [(1, 0), (1, 30), (1, 200), (2, 10), (1, 9000)]  # minutes; the last closes what came before
    rows = [(i, t0 + dt.timedelta(minutes=m), u, "view", 1.0, "{}") for i, (u, m) in enumerate(at)]
    spark.createDataFrame(rows, bars.EVENTS).write.parquet(f"{tmp_path}/in")
    bars.to_end(bars.sessions(bars.events(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("user_id", "start").collect()
    assert [(r["user_id"], r["n"], (r["end"] - r["start"]).total_seconds() / 60) for r in got] == [(1, 2, 90), (1, 1, 60), (2, 1, 60)]


def test_full_run_finds_the_factor_that_pays(spark):
    """Factor a pays in one regime and b in the other, c never: the run must earn what the right factor earns."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        g = ("NORMAL", "HIGH")[i // 10 % 2]
        a, b, c, e = rng.normal(size=(4, 40))
        y = (a if g == "NORMAL" else -b) * 0.05 + e * 0.01
        rows += [(dt.date(2018, 1, 1) + dt.timedelta(days=i), j, g, float(y[j]), float(a[j]), float(b[j]), float(c[j])) for j in range(40)]
    panel = spark.createDataFrame(rows, "date date, entity long, regime string, fwd double, a double, b double, c double")
    got = full_run(panel, ["a", "b", "c"], 5, 0, 0.0, 60, 80, 20).first()
    assert got["n_days"] > 50 and got["ls_mean"] > 0.1 and got["ls_win_rate"] > 0.95
    dear = full_run(panel, ["a", "b", "c"], 5, 0, 100.0, 60, 80, 20).first()
    assert got["ls_mean"] - dear["ls_mean"] == pytest.approx(0.01 * got["avg_turnover"], rel=0.05)


def test_grid_is_what_each_policy_gives_alone(spark):
    rng = np.random.default_rng(8)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), j, float(rng.normal()), float(rng.normal())) for i in range(30) for j in range(25) if rng.random() < 0.9]
    p = spark.createDataFrame(rows, "date date, entity long, y_pred double, y_true double")
    settings = [("baseline", None, 4), ("low_freq", 3, 4), ("hysteresis", 2, 4), ("ema", 3, 4), ("swap_cap", 0.4, 4), ("swap_cap", 0.2, 6), ("combo", (3, 2), 4)]
    got = {(r["strategy"], r["param"], r["top_n"]): r for r in portfolio.grid(p, settings, [5.0]).collect()}
    assert len(got) == len(settings)
    for policy, x, n in settings:
        alone = portfolio.metrics(portfolio.run_policy(p, policy, n, x, 5.0)).first()
        r = got[policy, str(x), n]
        assert all(r[c] == pytest.approx(alone[c], abs=1e-12) for c in alone.asDict()), policy
