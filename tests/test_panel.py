"""Operators on small made-up panels, against values worked out by hand or by NumPy."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from xsfactor import schemas
from xsfactor.functions import special
from xsfactor.operators import cross, factors, models, portfolio, stats, universe
from xsfactor.sources import files
from xsfactor.streaming import bars

D0 = dt.date(2020, 1, 1)
SCORES = "date date, entity long, y_pred double, y_true double"


def day(i):
    return D0 + dt.timedelta(days=i)


def test_two_days(spark):
    rows = [(day(i), k + 1, p, t) for i in (0, 1) for k, (p, t) in enumerate([(0.9 - 0.1 * i, 0.02 - 0.01 * i), (0.8 - 0.1 * i, 0.01 - 0.01 * i), (0.2 + 0.1 * i, -0.01 + 0.005 * i), (0.1 + 0.1 * i, -0.02 + 0.005 * i)])]
    p = spark.createDataFrame(rows, SCORES)
    got = portfolio.with_drawdown(portfolio.series(portfolio.legs(p, 2, 2), p, 5.0)).orderBy("date").collect()
    assert [round(r["long"], 6) for r in got] == [0.015, 0.005] and [round(r["short"], 6) for r in got] == [-0.015, -0.01]
    assert [r["turnover"] for r in got] == [2.0, 0.0] and [round(r["ls_net"], 6) for r in got] == [0.029, 0.015] and [r["drawdown"] for r in got] == [0, 0]


def test_hysteresis_by_hand(spark):
    rows = [(day(i), ord(c), float(-k), 0.0) for i, names in enumerate(["abcd", "cadb", "dcba"]) for k, c in enumerate(names)]
    held = portfolio.hysteresis(spark.createDataFrame(rows, SCORES), 2, 1).where("side = 'long'").collect()
    got = [{chr(r["entity"]) for r in held if r["date"] == day(i)} for i in range(3)]
    assert got == [{"a", "b"}, {"a", "c"}, {"c", "d"}]


def test_without_a_cap_every_day_has_its_best_names(spark):
    rng = random.Random(4)
    p = spark.createDataFrame([(day(i), e, rng.random(), rng.gauss(0, 1)) for i in range(25) for e in range(30)], SCORES)
    assert {tuple(r) for r in portfolio.capped(p, 5, 1.0).collect()} == {tuple(r) for r in portfolio.legs(p, 5, 5).collect()}


def test_swap_cap_limits_changes(spark):
    rng = random.Random(4)
    p = spark.createDataFrame([(day(i), e, rng.random(), 0.0) for i in range(20) for e in range(30)], SCORES)
    s = portfolio.series(portfolio.POLICIES["swap_cap"](p, 5, 0.4), p).orderBy("date").collect()
    assert all(r["added_long"] <= 2 and r["removed_long"] <= 2 for r in s[1:])


def test_quantile_and_ranks(spark):
    q = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double").agg(F.percentile("x", F.lit(0.5)), F.percentile("x", F.lit(0.9))).first()
    assert q[0] == 2.5 and q[1] == pytest.approx(7.9)
    rows = [(D0, i, x, y) for i, (x, y) in enumerate([(1.0, 2.0), (1.0, 1.0), (3.0, 5.0), (4.0, 4.0)])]
    assert cross.daily_ic(spark.createDataFrame(rows, SCORES), "y_pred", "y_true", least=3).first()["ic"] == pytest.approx(0.737865, abs=1e-6)
    same = [(D0, i, 1.0, float(i)) for i in range(12)]
    assert cross.daily_ic(spark.createDataFrame(same, SCORES), "y_pred", "y_true").count() == 0


def test_rank_gauss(spark):
    rows = [(D0, i, float(i), 0.0) for i in range(9)] + [(D0, 100, None, 0.0), (day(1), 1, 1.0, 0.0)]
    got = {r["entity"]: r["g"] for r in cross.rank_gauss(spark.createDataFrame(rows, SCORES), "y_pred", "g").where(F.col("date") == D0).collect()}
    assert got[100] is None and got[4] == pytest.approx(0, abs=1e-9)
    assert got[0] == pytest.approx(special.inverse_normal(0.5 / 9), abs=1e-7)


def test_special_functions():
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.f_upper(3.315829501, 2, 30) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_upper(7.814727903, 3) == pytest.approx(0.05, abs=1e-8)
    assert special.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert special.ks_upper(1.358, 1.0) == pytest.approx(0.05, abs=2e-4)


def panel(spark, days=60, names=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(days, names, 2))
    y = x[..., 0] * 0.5 - x[..., 1] * 0.2 + rng.normal(size=(days, names)) * 0.1
    rows = [(day(i), j, *map(float, x[i, j]), float(y[i, j])) for i in range(days) for j in range(names)]
    return spark.createDataFrame(rows, "date date, entity long, a double, b double, y double"), x, y


def test_walk_forward_is_direct_ridge(spark):
    df, x, y = panel(spark)
    got = {(r["date"], r["entity"]): r["y_pred"] for r in models.walk_forward(df, ["a", "b"], "y", 20, 2.0, 100).collect()}
    for i in (10, 30, 59):
        lo = max(0, i - 20)
        tx, ty = x[lo:i].reshape(-1, 2), y[lo:i].ravel()
        cx, cy = tx - tx.mean(0), ty - ty.mean()
        beta = np.linalg.solve(cx.T @ cx + 2 * np.eye(2), cx.T @ cy)
        for j in (0, 7):
            assert got[(day(i), j)] == pytest.approx(ty.mean() + (x[i, j] - tx.mean(0)) @ beta, abs=1e-9)
    assert (day(4), 0) not in got  # fewer than 100 rows before


def test_elastic_net_drops_noise(spark):
    df, *_ = panel(spark)
    st = models.sums(df.withColumn("z", F.sin(F.col("entity") * 7 + F.dayofyear("date"))), ["a", "b", "z"], "y").first()
    beta = models.elastic_net(st["n"], np.array(st["st"]), 0.1, 1.0)
    assert beta[3] == 0 and beta[1] > 0.3 and beta[2] < 0


def test_daily_ols(spark):
    df, x, y = panel(spark, 5)
    for r in models.daily_ols(df, ["a", "b"], "y").collect():
        i = (r["date"] - D0).days
        z = np.c_[np.ones(20), x[i]]
        coef, res, *_ = np.linalg.lstsq(z, y[i], rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * res[0] / 17)
        assert r["coef"] == pytest.approx(coef.tolist(), abs=1e-9) and r["t"] == pytest.approx((coef / se).tolist(), rel=1e-6)


def test_greedy():
    assert stats.decorrelated(["a", "b", "c"], {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.95}) == ["a", "c"]


def test_null_conventions(spark):
    df = spark.createDataFrame([(1, day(i), 1.0 + i % 2, 5.0) for i in range(8)], "entity long, date date, close double, volume double")
    out = factors.with_return(df).withColumns({"up": factors.breakout_high(4), "z": factors.zero_return_share(4, 1), "sv": factors.signed_volume()}).orderBy("date").collect()
    assert out[0]["r"] is None and out[0]["up"] == 0.0 and out[0]["z"] == 1.0 and out[0]["sv"] == 0.0
    neutral = spark.createDataFrame([(D0, "x", 1.0), (D0, "x", 3.0), (D0, None, 9.0)], "date date, industry string, v double")
    assert sorted(r["v"] for r in cross.neutralised(neutral, ["v"]).collect()) == [-1.0, 1.0]
    assert cross.neutralised(neutral, ["v"], drop=False).where("v is null").count() == 1


def test_codes_and_fallback(spark):
    df = spark.createDataFrame([("7",), ("1234567",)], "c string")
    assert [r[0] for r in df.select(schemas.pad_code(F.col("c"))).collect()] == ["000007", "1234567"]
    assert universe.or_all(df, F.col("c") == "x").count() == 2 and universe.or_all(df, F.col("c") == "7").count() == 1


def test_bar_files(spark, tmp_path):
    for code in ("000001", "600519"):
        (tmp_path / f"{code}.csv").write_text("﻿日期,股票代码,开盘,收盘,最高,最低,成交量\n2020-01-02,1,1.0,2.0,3.0,0.5,100\n2020-01-03,1,x,2.5,3.0,0.5,\n")
    (tmp_path / "notes.csv").write_text("a\n1\n")
    got = files.bars(spark, str(tmp_path)).orderBy("entity", "date").collect()
    assert len(got) == 4 and got[0]["entity"] == "000001" and got[0]["close"] == 2.0 and got[1]["open"] is None and got[1]["amount"] is None
    assert {r["entity"] for r in files.entities(spark, str(tmp_path)).collect()} == {"000001", "600519"}


def test_json_and_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"正常": ["a", "b"], "HIGH": ["c"]}')
    assert {tuple(r) for r in files.regime_factors(spark, f"{tmp_path}/m.json").collect()} == {("NORMAL", 0, "a"), ("NORMAL", 1, "b"), ("HIGH", 0, "c")}
    (tmp_path / "l.txt").write_text(" a \n\nb\n")
    assert [r[0] for r in files.listed(spark, f"{tmp_path}/l.txt").collect()] == ["a", "b"]
    assert files.parameters("1, 2.5,") == [1.0, 2.5]
    files.save(spark.range(3).toDF("x"), f"{tmp_path}/out", "csv", run="r1")
    assert spark.read.csv(f"{tmp_path}/out/run=r1", header=True).count() == 3
    with pytest.raises(ValueError, match="close"):
        files.checked(spark.range(1).toDF("date"))


def test_stream_is_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/in/e")
    bars.to_end(bars.tumbling(bars.events(spark, f"{tmp_path}/in/e")), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {(r["start"], r["event_type"]): (r["n"], round(r["total"], 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["start"], r["event_type"]): (r["n"], round(r["total"], 6)) for r in bars.tumbling(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, day(0)), (1, day(5)), (2, day(5))], "entity long, date date")
    right = spark.createDataFrame([(1, day(1), 7.0), (1, day(5), 8.0)], "entity long, date date, v double")
    got = {(r["entity"], r["date"]): r["v"] for r in universe.as_of_join(left, right, "v").collect()}
    assert got == {(1, day(0)): None, (1, day(5)): 8.0, (2, day(5)): None}


def test_kolmogorov_and_math(spark):
    df = spark.createDataFrame([(special.inverse_normal((i + 0.5) / 200),) for i in range(200)], "x double")
    r = stats.kolmogorov(df, "x").first()
    assert r["d"] < 0.02 and r["p"] > 0.99 and math.isfinite(r["p"])
