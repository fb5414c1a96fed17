"""Bundles, stages, statuses and imports: what breaks midway isn't seen, what is there isn't built again, bad lines come back."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from xsfactor.operators import runs
from xsfactor.sources import bundles, imports


def numbers(spark, n):
    return spark.range(n).select(F.col("id"), (F.col("id") * 2.0).alias("x"))


def test_a_broken_run_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    assert bundles.newest_run(spark, root) is None and bundles.of_runs(spark, root, "metrics") is None
    bundles.bundle(spark, root, "r1", {"metrics": numbers(spark, 1), "series": numbers(spark, 3)}, {"ls_ir": 1.5, "ls_ann": float("nan")})
    broken = numbers(spark, 5).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        bundles.bundle(spark, root, "r2", {"metrics": numbers(spark, 2), "series": broken}, {})
    assert bundles.newest_run(spark, root) == "r1" == bundles.newest_run(spark, root, "r2")
    assert bundles.of_runs(spark, root, "metrics").count() == 1
    bundles.bundle(spark, root, "r2", {"metrics": numbers(spark, 2), "series": numbers(spark, 5), "regimes": numbers(spark, 5)}, {"ls_ir": 2.0, "n": 5})
    assert bundles.newest_run(spark, root) == "r2" and bundles.newest_run(spark, root, "r1") == "r1"
    both = bundles.of_runs(spark, root, "series")
    assert {r["run_id"]: r["n"] for r in both.groupBy("run_id").agg(F.count("id").alias("n")).collect()} == {"r1": 3, "r2": 5}
    told = {(r["run_id"], r["highlight"]): r["value"] for r in bundles.summaries(spark, root, ("ls_ir", "ls_ann")).collect()}
    assert told == {("r1", "ls_ir"): 1.5, ("r1", "ls_ann"): None, ("r2", "ls_ir"): 2.0}


def test_a_second_attempt_replaces_the_first(spark, tmp_path):
    for n in (3, 4):
        bundles.bundle(spark, str(tmp_path), "r", {"series": numbers(spark, n)}, {})
    assert bundles.of_runs(spark, str(tmp_path), "series", ["r"]).count() == 4


def staged(spark, root, source, built, factor=2, cost=1.0, breaks=None):
    """Three stages in a row; built counts what is really built."""
    stages = bundles.Stages(spark, root)

    def building(name, make):
        def build():
            if breaks == name:
                raise RuntimeError(name)
            built.append(name)
            return make()

        return build

    a = stages.run("panel", {"factor": factor}, [bundles.fingerprint(spark, source)], building("panel", lambda: spark.read.parquet(source).withColumn("y", F.col("x") * factor)))
    b = stages.run("models", {}, [a], building("models", lambda: a.table.groupBy((F.col("id") % 2).alias("k")).agg(F.sum("y").alias("y"))))
    c = stages.run("costs", {"cost": cost}, [b], building("costs", lambda: b.table.select("k", (F.col("y") - cost).alias("net"))))
    return {r["k"]: r["net"] for r in c.table.collect()}, [reused for _, _, reused in stages.log]


def test_stages_are_built_once_and_only_what_depends_on_a_change_again(spark, tmp_path):
    root, source, built = f"{tmp_path}/root", f"{tmp_path}/source", []
    numbers(spark, 10).write.parquet(source)
    first, reused = staged(spark, root, source, built)
    assert built == ["panel", "models", "costs"] and reused == [False] * 3 and first == {0: 79.0, 1: 99.0}
    assert staged(spark, root, source, built) == (first, [True] * 3) and len(built) == 3
    assert staged(spark, root, source, built, cost=2.0) == ({0: 78.0, 1: 98.0}, [True, True, False])
    assert staged(spark, root, source, built, factor=3)[1] == [False] * 3
    assert staged(spark, root, source, built) == (first, [True] * 3)
    numbers(spark, 11).write.mode("overwrite").parquet(source)
    assert staged(spark, root, source, built)[1] == [False] * 3 and built.count("panel") == 3


@pytest.mark.parametrize("at", ["panel", "models", "costs"])
def test_a_run_that_dies_goes_on_where_it_was(spark, tmp_path, at):
    root, source, built = f"{tmp_path}/root", f"{tmp_path}/source", []
    numbers(spark, 10).write.parquet(source)
    with pytest.raises(RuntimeError, match=at):
        staged(spark, root, source, built, breaks=at)
    done = len(built)
    assert staged(spark, root, source, built)[1] == [True] * done + [False] * (3 - done)
    assert built == ["panel", "models", "costs"]


def test_statuses_are_written_and_the_latest_counts(spark, tmp_path):
    root, wanted = str(tmp_path), spark.createDataFrame([(1,), (2,), (3,)], "entity int")
    ask = lambda: sorted(r["entity"] for r in runs.to_fetch(wanted, bundles.statuses(spark, root), "a", "b").collect())
    say = lambda key, status, hour: bundles.record_status(spark, root, spark.createDataFrame([(key, status, dt.datetime(2024, 1, 1, hour))], bundles.STATUS))
    assert ask() == [1, 2, 3]
    say("1_a_b", "done", 1)
    say("2_a_b", "failed", 1)
    assert ask() == [2, 3]
    say("2_a_b", "done", 2)
    say("1_a_b", "failed", 3)
    assert ask() == [1, 3]


def test_nan_in_metrics_is_null(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"strategy": "x", "metrics": {"ls_ir": NaN, "ls_ann": 0.5, "n_days": 3}, "extra": Infinity}')
    got = bundles.metrics_file(spark, f"{tmp_path}/m.json", "strategy string, metrics struct<ls_ir:double,ls_ann:double,n_days:long>, extra double").first()
    assert got["metrics"].asDict() == {"ls_ir": None, "ls_ann": 0.5, "n_days": 3} and got["extra"] is None


FILES = {
    "600001.csv": "﻿date,open,close,volume\n2020-01-01,1,2,3\n2020-01-02,x,2,3\n2020-01-03,1,,3\nnot a date,1,2,3\n2020-01-05,1,2\n\n2020-01-06,1,2,3,4\n2020-01-07,,2.5,NaN\n",
    "0000022.csv": 'close,日期,"成交量"\r\n5,2020-01-01,"1"\r\n"6",2020-13-01,2\r\n7,2020-01-02,2\r\nclose,日期,成交量\r\n',
    "3.csv": "1,2,3\n2020-01-01,1,2\n",
    "600004.csv": "date,close,close\n2020-01-01,1,2\n",
    "notes.txt": "date,close\n2020-01-01,1\n",
}


def test_bad_lines_come_back_and_good_ones_are_unharmed(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    good, bad = imports.imported(spark, str(tmp_path))
    rows = {(r["entity"], str(r["date"]), r["open"], r["close"], r["volume"]) for r in good.collect()}
    assert rows == {("600001", "2020-01-01", 1.0, 2.0, 3.0), ("600001", "2020-01-07", None, 2.5, None), ("000002", "2020-01-01", None, 5.0, 1.0), ("000002", "2020-01-02", None, 7.0, 2.0)}
    got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in bad.collect())
    assert got == sorted([
        ("600001.csv", "2020-01-02,x,2,3", "open"), ("600001.csv", "2020-01-03,1,,3", "close"), ("600001.csv", "not a date,1,2,3", "date"), ("600001.csv", "2020-01-05,1,2", "cells"),
        ("600001.csv", "2020-01-06,1,2,3,4", "cells"), ("0000022.csv", '"6",2020-13-01,2', "date"), ("3.csv", "1,2,3", "no header"), ("3.csv", "2020-01-01,1,2", "no header"), ("600004.csv", "2020-01-01,1,2", "cells"),
    ])
    n = {r["file"].rsplit("/", 1)[1]: (r["good"], r["bad"], r["reasons"]) for r in imports.counts(spark, str(tmp_path)).collect()}
    assert n["600001.csv"] == (2, 5, {"open": 1, "close": 1, "date": 1, "cells": 2}) and n["3.csv"] == (0, 2, {"no header": 2}) and n["0000022.csv"][:2] == (2, 1)


def test_import_judges_lines_once(spark, tmp_path, monkeypatch):
    """s20_import reads its files for their lines and for their headers, not once more for the bad ones; cells with quotes still hold commas."""
    import __spark_entry__ as entry

    monkeypatch.setattr("xsfactor.plans.run_queries.shared_folder", lambda s: str(tmp_path / "out"))
    plan = entry.queries()["s20_import"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value#") == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "600001.csv").write_text('Date,close,name\n2024-01-02,1.5,"a, b"\n2024-01-04,3,plain date\n"日期",close,name\n', encoding="utf-8")
    good, bad = imports.imported(spark, str(tmp_path / "in"))
    assert sorted((str(r["date"]), r["close"]) for r in good.collect()) == [("2024-01-02", 1.5), ("2024-01-04", 3.0)] and bad.count() == 0
