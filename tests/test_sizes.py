"""Steps that read a panel once and move its rows once, against the plain forms."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from xsfactor import registry
from xsfactor.durable import durable
from xsfactor.operators import cross, models, walk
from xsfactor.plans.ic_queries import regime_panel
from xsfactor.sources.panels import supplier_month, table


def panel(spark, n_dates=24, names=14):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n_dates):
        for e in range(names):
            a, b = map(float, rng.normal(size=2).round(1))
            rows.append((e, dt.date(2020, 1, 1) + dt.timedelta(days=i), ("A", "B", None)[i % 3], a, b if rng.random() > 0.1 else None, float(round(a + rng.normal(), 1)) if rng.random() > 0.1 else None))
    return spark.createDataFrame(rows, "entity long, date date, regime string, a double, b double, y double").repartition(3)


@pytest.mark.parametrize("by_regime", [False, True])
def test_a_grid_in_arrays_is_the_grid_by_rows(spark, by_regime):
    df, windows, alphas = panel(spark), [9, 15], [0.5, 5.0]
    own = {"A": ["a", "b"], "B": ["b"]} if by_regime else ["a", "b"]
    if by_regime:
        p = models.model_grid_by_regime(df, own, "y", windows, alphas, 12)
    else:
        p = models.model_grid(df, own, "y", windows, alphas, 12).withColumn("y_true", F.col("y"))
    p = p.withColumn("y_pred", F.round("y_pred", 9)).cache()
    got = {(r["days"], r["alpha"]): r for r in models.graded_grid(df, own, "y", windows, alphas, 12, top=3, bottom=3, cost_bps=5.0).collect()}
    ic = {(r["days"], r["alpha"]): r for r in cross.daily_ic(p, "y_pred", "y_true", ("days", "alpha", "date"), 2).groupBy("days", "alpha").agg(F.avg("ic").alias("m"), F.count("ic").alias("n")).collect()}
    assert set(got) == set(ic) and len(ic) == 4
    frame = p.toPandas()
    for k, r in got.items():
        assert r["n_days"] == ic[k]["n"] > 3 and r["ic_mean"] == pytest.approx(ic[k]["m"], abs=1e-9)
        mine = frame[(frame.days == k[0]) & (frame.alpha == k[1])].sort_values(["y_pred", "entity"], ascending=[False, True])
        assert r["long_mean"] == pytest.approx(np.mean([g.y_true[:3].mean() for _, g in mine.groupby("date")]))
        assert r["short_mean"] == pytest.approx(np.mean([g.y_true[-3:].mean() for _, g in mine.groupby("date")]))
    plain = {(r["days"], r["alpha"]): r for r in models.graded(p, "days", "alpha", top=3, bottom=3, cost_bps=5.0).collect()}
    for k, r in got.items():
        assert {c: pytest.approx(v, abs=1e-9) for c, v in r.asDict().items()} == plain[k].asDict()


def test_models_of_sums_move_no_windows(spark):
    df = panel(spark)
    plan = lambda p: p._jdf.queryExecution().toString()
    by_sums = walk.walk_forward(df, ["a", "b"], "y", 9, walk.Ridge, 12, 1)
    by_rows = walk.walk_forward(df, ["a", "b"], "y", 9, type("Rows", (walk.Ridge,), {"of_sums": None}), 12, 1)
    assert "FlatMapCoGroups" not in plan(by_sums) and "FlatMapCoGroups" in plan(by_rows)
    got, want = ({(r["date"], r["entity"]): r for r in p.collect()} for p in (by_sums, by_rows))
    assert set(got) == set(want) and len(got) > 100
    assert all(abs(r["y_pred"] - want[k]["y_pred"]) < 1e-9 and r["n_train"] == want[k]["n_train"] for k, r in got.items())


@pytest.mark.parametrize("name", ["i9_kruskal", "e5_ema"])
def test_queries_read_back_what_was_made_once(spark, sf, name):
    files = registry.QUERIES[name](spark, sf).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_bars_sort_lines_once_where_they_arrive(spark, sf):
    bars = supplier_month(spark, sf)
    below = bars._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(entity")[-1]
    assert "FileScan" in below and "Sort" not in below
    want = {}
    for r in table(spark, sf, "lineitem").collect():
        want.setdefault((r["l_suppkey"], r["l_shipdate"].date().replace(day=1)), []).append((r["l_shipdate"], r["l_extendedprice"] / r["l_quantity"]))
    got = {(r["entity"], r["date"]): (r["open"], r["high"], r["low"], r["close"], r["ticks"]) for r in bars.collect()}
    px = lambda v: [x[1] for x in v]
    assert got == {k: (min(v)[1], max(px(v)), min(px(v)), max(v)[1], len(v)) for k, v in want.items()} and len(got) > 500


def test_regime_panels_hold_what_is_asked_for(spark, sf):
    assert regime_panel(spark, sf, "mom3", "fwd").columns == ["date", "entity", "r", "mom3", "fwd", "regime", "volatility", "market_return"]
    assert {"vr", "amp", "industry"} <= set(regime_panel(spark, sf).columns)


def test_regimes_share_one_pass_for_sums_and_one_for_predictions(spark):
    mixed = panel(spark).withColumn("regime", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit(None), F.lit("C")), (F.col("entity") % 4 + 1).cast("int")))
    df, own = durable(mixed.withColumn("b", F.when(F.col("entity") % 5 == 0, float("nan")).otherwise(F.col("b"))), "panel"), {"A": ["a", "b"], "B": ["b"], "none": ["a"]}
    p = models.walk_forward_by_regime(df, own, "y", 9, 1.0, 5)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "hashpartitioning" not in plan
    key = lambda r: (r["entity"], r["date"], r["regime"])
    want = {key(r): r for g, xs in own.items() for r in models.walk_forward(df.where(F.col("regime") == g), xs, "y", 9, 1.0, 5).collect()}
    got = {key(r): r for r in p.collect()}
    assert set(got) == set(want) and {k[2] for k in got} == {"A", "B"} and len(got) > 80
    assert all(r["y_pred"] == pytest.approx(want[k]["y_pred"], abs=1e-12) and r["y_true"] == want[k]["y"] for k, r in got.items())


def test_standardising_in_place_moves_no_rows(spark):
    df = durable(panel(spark).withColumn("date", F.when(F.col("date") != dt.date(2020, 1, 2), F.col("date"))).withColumn("a", F.when(F.col("date") == dt.date(2020, 1, 3), 1.0).otherwise(F.col("a"))), "panel")
    z = cross.standardised_in_place(df, "a", "b")
    plan = z._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    rows = lambda d: sorted(((r["entity"], str(r["date"]), round(r["a_std"], 9) if r["a_std"] is not None else None, round(r["b_std"], 9) if r["b_std"] is not None else None) for r in d.collect()), key=repr)
    assert z.columns == cross.standardised(df, "a", "b").columns and rows(z) == rows(cross.standardised(df, "a", "b")) and z.count() == 24 * 14
