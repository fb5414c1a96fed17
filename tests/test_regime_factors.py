"""Factors of regimes, from the given tables to what is chosen."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from xsfactor import registry
from xsfactor.functions import special
from xsfactor.operators import cross
from xsfactor.plans.ic_queries import FACTORS
from xsfactor.sources.panels import supplier_day


def by_hand(sf):
    """(regime, place, factor), and the dates of each regime and factor."""
    lines = pd.read_parquet(f"{sf}/lineitem.parquet", columns=["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"])
    lines = lines.assign(px=lines.l_extendedprice / lines.l_quantity, date=lines.l_shipdate.dt.normalize()).sort_values(["l_suppkey", "l_shipdate", "px"])
    b = lines.groupby(["l_suppkey", "date"]).agg(close=("px", "last"), high=("px", "max"), low=("px", "min"), volume=("l_quantity", "sum")).reset_index()
    own = b.groupby("l_suppkey")
    b["r"] = b.close / own.close.shift(1) - 1
    b["fwd"] = b.groupby("l_suppkey").r.shift(-1)
    b["mom3"], b["mom6"] = (own.close.shift(2) / own.close.shift(k) - 1 for k in (4, 7))
    b["vol6"] = b.groupby("l_suppkey").r.transform(lambda v: v.rolling(6, 4).std())
    b["vr"] = b.volume / own.volume.transform(lambda v: v.rolling(6, 4).mean())
    b["amp"] = (b.high - b.low) / b.close
    b[["fwd", *FACTORS]] = b[["fwd", *FACTORS]].round(9)
    m = b.groupby("date").r.agg(["mean", "std"])
    parts = (m["mean"].rolling(21, 10).std(), m["std"].rolling(10, 3).mean())
    vol = sum(0.5 * (v - v.mean()) / (v.std() + 1e-9) for v in parts).dropna()
    regime = pd.Series(np.where(vol <= vol.quantile(0.5), "NORMAL", np.where(vol <= vol.quantile(0.9), "HIGH", "EXTREME")), vol.index)
    b["regime"] = b.date.map(regime)
    want, dates = [], {}
    for g, part in b.dropna(subset=["regime"]).groupby("regime"):
        found = []
        for f in FACTORS:
            days = part.dropna(subset=[f, "fwd"]).groupby("date")
            x, y = (days[c].rank() - (days[c].transform("size") + 1) / 2 for c in (f, "fwd"))
            xy, xx, yy = ((v * w).groupby(part.date).sum() for v, w in ((x, y), (x, x), (y, y)))
            ic = (xy / np.sqrt(xx * yy).where(xx * yy > 0))[days.size() >= 5].dropna()
            dates[g, f] = len(ic)
            if len(ic) >= 60 and abs(ic.mean()) >= 0.01 and special.t_two_sided(ic.mean() / (ic.std(ddof=1) / len(ic) ** 0.5), len(ic) - 1) < 0.05:
                found.append((-abs(ic.mean()), f))
        whole, kept = part.dropna(subset=[f for _, f in found]), []
        for _, f in sorted(found):
            if all(abs(whole[f].corr(whole[k])) < 0.8 for k in kept):
                kept.append(f)
        want += [(g, i, f) for i, f in enumerate(kept)]
    return want, dates


def test_every_regime_has_the_dates_that_the_screen_asks_for(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have two suppliers a day
    want, dates = by_hand(sf)
    assert {g for g, _ in dates} == {"NORMAL", "HIGH", "EXTREME"} and min(dates.values()) >= 60
    got = registry.QUERIES["i17_regime_factors"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == want and {g for g, _, _ in want} == {"NORMAL", "HIGH", "EXTREME"}


def test_bars_by_day_have_every_line(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", F.to_date("l_shipdate").alias("d"), "l_quantity").collect()
    want = {}
    for r in lines:
        n, q = want.get((r["l_suppkey"], r["d"]), (0, 0.0))
        want[r["l_suppkey"], r["d"]] = (n + 1, q + r["l_quantity"])
    got = {(r["entity"], r["date"]): (r["ticks"], r["volume"]) for r in supplier_day(spark, sf).collect()}
    assert got == want and len({d for _, d in want}) > 2000


def test_correlations_of_several_factors_are_those_of_each(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(30):
        for e in range(3 + i % 9):
            a, b, y = (float(v) for v in rng.normal(size=3).round(1))
            rows.append((("A", "B", None)[i % 3], dt.date(2020, 1, 1) + dt.timedelta(days=i), a if rng.random() > 0.2 else None, float("nan") if e == 1 else b, 1.0 if i == 8 else y if rng.random() > 0.2 else None))
    df = spark.createDataFrame(rows, "regime string, date date, a double, b double, y double").withColumn("none", F.lit(None).cast("double")).repartition(3)
    by, xs = ("regime", "date"), ["a", "b", "none"]
    got = cross.daily_ics(df, xs, "y", by)
    want = cross.daily_ic(df.unpivot([*by, "y"], xs, "factor", "x"), "x", "y", ("regime", "factor", "date"))
    rows_of = lambda d: sorted((tuple(r) for r in d.select("regime", "date", "factor", "ic", "n").collect()), key=repr)
    assert got.columns == ["regime", "date", "factor", "ic", "n"] and rows_of(got) == rows_of(want) and len(rows_of(got)) > 20
    assert rows_of(cross.daily_ics(df.where("y > 99"), xs, "y", by)) == []
