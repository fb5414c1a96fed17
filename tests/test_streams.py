"""Streams against their batch forms: policies with a restart, models by the day, priced events, sliding windows, late rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from xsfactor import registry
from xsfactor.operators import models as M
from xsfactor.operators import portfolio as P
from xsfactor.operators import runs
from xsfactor.plans.factor_queries import predictions
from xsfactor.plans.model_queries import LEAST, scores
from xsfactor.streaming import bars, joins, policies
from xsfactor.streaming import models as SM

SF = "/root/testdata/sf0.01"
FAR = dt.date(2100, 1, 1)


def settle(spark, path):
    spark.createDataFrame([(FAR, None, None)], policies.SCORES).write.mode("append").parquet(path)


def test_policies_on_a_stopped_and_restarted_stream(spark, tmp_path):
    policies.with_state_store(spark)
    p = predictions(spark, SF).select("date", "entity", "y_pred", "y_true").persist()
    dates = sorted(r["date"] for r in p.select("date").distinct().collect())
    settings = [("hysteresis", 2, 5), ("swap_cap", 0.4, 5), ("low_freq", 3, 5)]
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))

    def add(lo, hi):
        """Dates lo to hi, in two files that overlap in a date."""
        part = p.select("date", "entity", "y_pred").where(F.col("date").isin(dates[lo:hi]))
        mid = dates[(lo + hi) // 2]
        first = (F.col("date") < mid) | ((F.col("date") == mid) & (F.col("entity") % 2 == 0))
        for rows in (part.where(first), part.where(~first)):
            rows.coalesce(1).write.mode("append").parquet(folder)

    run = lambda: bars.to_end(policies.held(policies.scores(spark, folder), settings), out, check)
    add(0, 30)
    run()
    early = spark.read.parquet(out)
    assert 20 < early.select("date").distinct().count() < 31
    add(30, len(dates))
    settle(spark, folder)
    run()
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r["setting"], set()).add((r["date"], r["side"], r["entity"]))
    want = {0: P.hysteresis(p, 5, 2), 1: P.capped(p, 5, 0.4), 2: P.every(p, 5, 5, 3)}
    for i, held in want.items():
        assert got[i] == {(r["date"], r["side"], r["entity"]) for r in held.collect()}, settings[i]
    p.unpersist()


def test_models_by_the_day(spark, tmp_path):
    rows = scores(spark, SF).select("entity", "date", "x", "y").persist()
    dates = sorted(r["date"] for r in rows.select("date").distinct().collect())
    folder, root = f"{tmp_path}/in", f"{tmp_path}/root"
    cuts = [dates[:60], *([d] for d in dates[60:70])]
    want = {(r["entity"], r["date"]): (r["y_pred"], r["n_train"]) for r in M.walk_forward(rows, ["x"], "y", 1095, 1.0, LEAST).where(F.col("date").isin(dates[:70])).collect()}
    for cut in cuts:
        rows.where(F.col("date").isin(cut)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        SM.follow(stream, root, f"{tmp_path}/check", ["x"], "y", 1095, 1.0, LEAST)
    got = SM.predictions(rows, root)

    def same():
        found = {(r["entity"], r["date"]): (r["y_pred"], r["n_train"]) for r in SM.predictions(rows, root).collect()}
        assert set(found) == set(want) and all(found[k][0] == pytest.approx(v[0], abs=1e-9) and found[k][1] == v[1] for k, v in want.items())

    same()
    assert got.select("batch").distinct().count() > 8
    # A batch that runs again changes nothing; a date that comes again counts once.
    SM.feed(rows.where(F.col("date") == dates[69]), 10, root, ["x"], "y", 1095, 1.0, LEAST)
    same()
    SM.feed(rows.where(F.col("date") == dates[69]), 11, root, ["x"], "y", 1095, 1.0, LEAST)
    same()
    rows.unpersist()


def test_priced_events_of_two_streams(spark, tmp_path):
    events = registry.QUERIES["j7_event_prices"](spark, SF).select("entity", F.col("date").cast("date").alias("date"), "event").persist()
    prices = registry.QUERIES["s6_panel_bars"](spark, SF).select("entity", F.col("date").cast("date").alias("date"), "close").where("entity % 7 != 0").persist()
    for df, name, end in ((events, "events", (-1, FAR, "end")), (prices, "prices", (-1, FAR, 0.0))):
        cut = sorted(r["date"] for r in df.select("date").distinct().collect())
        for part in (df.where(F.col("date") <= cut[len(cut) // 2]), df.where(F.col("date") > cut[len(cut) // 2]), spark.createDataFrame([end], df.schema)):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    out = joins.priced(read("events", events.schema), read("prices", prices.schema))
    bars.to_end(out, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").where("entity >= 0").collect()
    want = runs.priced(events, prices).select(*out.columns).collect()
    key = lambda rows: sorted((r["entity"], r["date"], r["event"], -1.0 if r["close"] is None else r["close"]) for r in rows)
    assert key(got) == key(want) and len(want) > 100 and any(r["close"] is None for r in want) and any(r["close"] is not None for r in want)


def test_sliding_windows_and_late_rows(spark, tmp_path):
    rng, t0 = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=rng.randrange(6000)), i % 5, rng.choice("ab"), float(i % 13), "{}") for i in range(400)]
    rows.sort(key=lambda r: r[1])
    end = (999, t0 + dt.timedelta(days=90), 0, "end", 0.0, "{}")
    late = (1000, t0, 1, "a", 5.0, "{}")
    folder = f"{tmp_path}/in"
    # Spark drops late rows by the watermark of the batch before the last, so two batches come before the late one.
    for part in (rows[:200], [*rows[200:], rows[10]], [end], [(1001, *end[1:])], [late]):
        spark.createDataFrame(part, bars.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(bars.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    bars.to_end(joins.sliding(stream(), "2 hours", "30 minutes", "30 days", "event_type"), f"{tmp_path}/w", f"{tmp_path}/cw")
    got = {(r["start"], r["event_type"]): (r["n"], r["total"], r["low"], r["high"]) for r in spark.read.parquet(f"{tmp_path}/w").where("event_type != 'end'").collect()}
    want: dict = {}
    for _, ts, _, kind, v, _ in [*rows, rows[10]]:
        first = t0 + dt.timedelta(minutes=30 * ((ts - t0) // dt.timedelta(minutes=30)))
        for k in range(4):
            want.setdefault((first - dt.timedelta(minutes=30 * k), kind), []).append(v)
    assert got == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items()}
    joins.parted(stream(), f"{tmp_path}/parts", f"{tmp_path}/cp", "30 days")
    found = spark.read.parquet(f"{tmp_path}/parts/late")
    assert [r["event_id"] for r in found.collect()] == [1000] and spark.read.parquet(f"{tmp_path}/parts/on_time").count() == 403
    n = joins.late_counts(found).collect()
    assert len(n) == 1 and n[0]["n"] == 1 and n[0]["oldest"] == t0


def test_numbers_of_batches_are_kept_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 1, d), float(d), float(np.sin(d))) for d in range(1, 20)], "entity long, date date, x double, y double")
    SM.feed(df.where("day(date) < 10"), 0, str(tmp_path), ["x"], "y", 30, 1.0, 3)
    SM.feed(df.where("day(date) >= 10"), 1, str(tmp_path), ["x"], "y", 30, 1.0, 3)
    got = {r["date"]: r["y_pred"] for r in SM.predictions(df, str(tmp_path)).collect()}
    want = {r["date"]: r["y_pred"] for r in M.walk_forward(df, ["x"], "y", 30, 1.0, 3).collect()}
    assert set(got) == set(want) and all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want) and len(want) == 16
