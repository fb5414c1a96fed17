"""Recurrences by stretches against loops over all dates."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from xsfactor.operators import portfolio as P
from xsfactor.operators import scan

DAY0 = dt.date(2020, 1, 3)
SCORES = "date date, entity long, y_pred double, y_true double"


def scored(n=40, names=24, seed=1):
    """Scores that drift, with ties, gaps and names without a score."""
    rng = random.Random(seed)
    level = [rng.gauss(0, 1) for _ in range(names)]
    rows = []
    for i in range(n):
        level = [0.9 * x + rng.gauss(0, 0.5) for x in level]
        rows += [(DAY0 + dt.timedelta(days=2 * i), e, None if rng.random() < 0.05 else round(x, 1), 0.0) for e, x in enumerate(level) if rng.random() < 0.85]
    return rows


def looped(rows, rule):
    """All dates in order, all names of a date ranked."""
    held, out = {"long": set(), "short": set()}, set()
    for at, d in enumerate(sorted({r[0] for r in rows})):
        best = [r[1] for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))]
        for side, names in (("long", best), ("short", best[::-1])):
            held[side] = set(rule(held[side], names, at))
            out |= {(d, side, e) for e in held[side]}
    return out


POLICIES = [("hysteresis", 3, 5), ("hysteresis", 0, 4), ("swap_cap", 0.2, 6), ("swap_cap", 0.4, 5), ("low_freq", 3, 4), ("baseline", None, 5)]


@pytest.mark.parametrize("dates", [1, 7, 256])
def test_policies_by_stretches(spark, dates):
    rows = scored()
    p = spark.createDataFrame(rows, SCORES).repartition(3)
    settings = [P.setting(i, *x) for i, x in enumerate(POLICIES)]
    lists = P.ranking(p, "plain").unionByName(P.ranking(p, "tracked"))
    got = {}
    for r in scan.holdings(lists, settings, dates).collect():
        got.setdefault(r["id"], set()).add((r["date"], r["side"], r["entity"]))
    for i, (policy, x, n) in enumerate(POLICIES):
        assert got[i] == looped(rows, P.policy_rule(policy, n, x)), policy


def test_states_that_never_meet(spark):
    """A name that no rule lets go is held to the end, however many stretches later."""
    rows = [(DAY0 + dt.timedelta(days=i), e, float(-e if i == 0 else e), 0.0) for i in range(12) for e in range(4)]
    keep = lambda held, ranked, at: held or set(ranked[:1])
    got = scan.holdings(P.ranking(spark.createDataFrame(rows, SCORES), "v"), [scan.Setting(7, "v", keep, 1)], 2).where("side = 'long'").collect()
    assert {(r["id"], r["entity"]) for r in got} == {(7, 0)} and len(got) == 12


def test_policies_of_no_rows(spark):
    p = spark.createDataFrame([], SCORES)
    assert P.hysteresis(p, 5, 2).count() == 0 and P.capped(p, 5, 0.2).count() == 0


def averaged(values, a):
    s, out = None, []
    for x in values:
        s = s if x is None else x if s is None else a * x + (1 - a) * s
        out.append(s)
    return out


@pytest.mark.parametrize("days", [1, 9, 64])
@pytest.mark.parametrize("span", [1, 2, 5, 100])
def test_moving_average_by_stretches(spark, span, days):
    rng, rows, want = random.Random(span), [], {}
    for e in range(6):
        dates = sorted(rng.sample(range(400), 150))
        values = [None if rng.random() < 0.2 or (e == 1 and k < 40) or e == 2 or (e == 3 and 30 < k < 90) else rng.gauss(0, 10 ** rng.randint(-3, 3)) for k in range(150)]
        for d, x, s in zip(dates, values, averaged(values, 2 / (span + 1)), strict=True):
            rows.append((e, DAY0 + dt.timedelta(days=d), x))
            want[e, DAY0 + dt.timedelta(days=d)] = s
    df = spark.createDataFrame(rows, "entity long, date date, x double").repartition(3).withColumn("other", F.lit(1))
    got = scan.moving_average(df, "x", 2 / (span + 1), "s", days)
    assert got.columns == ["entity", "date", "x", "other", "s"]
    found = {(r["entity"], r["date"]): r["s"] for r in got.collect()}
    assert set(found) == set(want)
    for k, s in want.items():
        assert (s is None) == (found[k] is None) and (s is None or found[k] == pytest.approx(s, rel=1e-9, abs=1e-9)), k
