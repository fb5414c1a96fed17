"""Recurrences over dates, computed by stretches of dates at once.

A moving average is an affine step, and steps compose: each stretch of an entity is summed up in two numbers, a short fold
over stretches carries the state in, and a row adds its own part. Holdings have no such form: each stretch is first folded
from an empty state, then again from the state in which the stretch before it ends, as long as any such state changes. A
stretch is right once the one before it is, and rules that follow the scores forget where they began, so a few rounds do.
No task holds more than a stretch of dates, and of a date only the names that can matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.windows import indexed
from .cross import order

#: Calendar days of a moving average's stretch, and dates of a policy's.
DAYS, DATES = 64, 256


def moving_average(df: DataFrame, x: str, a: float, out: str, days: int = DAYS) -> DataFrame:
    """df with s = a x + (1 - a) s from the entity's first value on; rows without a value keep s (null before the first).

    Within a stretch the values' weights are powers of 1 / (1 - a), at most `days` of them.
    """
    keep, where = 1.0 - a, ["entity", "_stretch"]
    power = lambda n: F.pow(F.lit(keep), n) if keep > 0 else F.when(n == 0, 1.0).otherwise(0.0)
    so_far = Window.partitionBy(*where).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_stretch", F.floor(F.unix_date("date") / days)).withColumn("_n", F.count(x).over(so_far))
    own = F.last(x, ignorenulls=True).over(so_far) if keep <= 0 else F.sum(a * F.col(x) * power(-F.col("_n"))).over(so_far) * power(F.col("_n"))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(0.0)))
    value_date = F.when(F.col(x).isNotNull(), F.col("date"))
    steps = rows.groupBy(*where).agg(F.max("_n").alias("n"), F.max_by("_own", "date").alias("own"), F.min_by(x, value_date).alias("first")).where("n > 0")

    def carry(done: Column, v: Column) -> Column:
        # Before an entity's first value the state counts as that value: the first step then leaves it as it is.
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["after"], v["first"])
        entry = F.struct(v["_stretch"].alias("_stretch"), before.alias("_before"), (v["own"] + power(v["n"]) * before).alias("after"), (F.size(done) == 0).alias("_begins"))
        return F.concat(done, F.array(entry))

    listed = F.array_sort(F.collect_list(F.struct("_stretch", "n", "own", "first")))
    none = F.array().cast("array<struct<_stretch:bigint,_before:double,after:double,_begins:boolean>>")
    states = steps.groupBy("entity").agg(F.aggregate(listed, none, carry).alias("v")).select("entity", F.inline("v"))
    # A stretch without values keeps the state of the last one that has some.
    every = rows.select(*where).distinct().join(states, where, "left")
    earlier = Window.partitionBy("entity").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_before", F.coalesce("_before", F.last("after", ignorenulls=True).over(earlier))).drop("after")
    begun = ~(F.coalesce("_begins", F.lit(False)) & (F.col("_n") == 0))
    return rows.join(every, where).withColumn(out, F.when(begun, F.col("_own") + power(F.col("_n")) * F.col("_before"))).select(*df.columns, out)


@dataclass(frozen=True)
class Setting:
    """A policy: rule(held, ranked names of the side, number of the date) -> names.

    The rule looks at the first `wide` names, and if it is tracked at the places of all names that it holds.
    """

    id: int
    variant: str
    rule: Callable[[set, list, int], Iterable]
    wide: int
    tracked: bool = False


def holdings(scores: DataFrame, settings: list[Setting], dates: int = DATES) -> DataFrame:
    """Rows (id, date, side, entity) of every setting, from rows (variant, date, entity, s); no s comes last."""
    kind = dict(scores.dtypes)["entity"]
    by_variant: dict[str, list[Setting]] = {}
    for x in settings:
        by_variant.setdefault(x.variant, []).append(x)
    wide = {v: max(x.wide for x in xs) for v, xs in by_variant.items()}
    tracked = [v for v, xs in by_variant.items() if any(x.tracked for x in xs)]
    days = durable(indexed(scores).withColumn("stretch", F.floor(F.col("idx") / dates)), "days")  # a row a date
    w = Window.partitionBy("variant", "date")
    least = F.element_at(F.create_map(*(F.lit(y) for v, n in wide.items() for y in (v, n))), F.col("variant"))
    ends = F.least(F.row_number().over(w.orderBy(*order("s"))), F.row_number().over(w.orderBy(*order("s", False))))
    numbered = scores.where(F.col("variant").isin(list(by_variant))).join(days, "date")
    near = numbered.withColumn("_ends", ends).where(F.col("_ends") <= least).drop("_ends")
    names = ["variant", "stretch", "entity"]

    def placed(wanted: DataFrame) -> DataFrame:
        """Their rows on all dates of the stretch."""
        return numbered.where(F.col("variant").isin(tracked)).join(wanted.select(*names).distinct(), names, "left_semi")

    columns = ["variant", "stretch", "date", "idx", "entity", "s"]
    rows = near.where(~F.col("variant").isin(tracked)).select(*columns)
    if tracked:
        rows = rows.unionByName(placed(near.where(F.col("variant").isin(tracked))).select(*columns))
    rows = durable(rows, "ranked")

    def fold(table: pa.Table, start: list[dict], show: Callable[[int, object, str, list], None]) -> dict[tuple[int, str], list]:
        ranked = table.sort_by([("idx", "ascending"), ("s", "descending"), ("entity", "ascending")])
        mine = by_variant[ranked["variant"][0].as_py()]
        held = {(x.id, side): set() for x in mine for side in ("long", "short")}
        for r in start:
            held[r["id"], r["side"]].add(r["entity"])
        idx, entity, date = (ranked[c].to_pylist() for c in ("idx", "entity", "date"))
        at = 0
        while at < len(idx):
            end = at
            while end < len(idx) and idx[end] == idx[at]:
                end += 1
            best = entity[at:end]
            for x in mine:
                for side, names in (("long", best), ("short", best[::-1])):
                    held[x.id, side] = set(x.rule(held[x.id, side], names, idx[at]))
                    show(x.id, date[at], side, sorted(held[x.id, side]))
            at = end
        return {k: sorted(v) for k, v in held.items()}

    item = f"array<struct<id:int,side:string,entity:{kind}>>"

    def end_state(key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"variant": pa.array([], pa.string()), "stretch": pa.array([], pa.int64()), "state": pa.array([], start.schema.field("state").type)})
        last = fold(table, start["state"][0].as_py() or [] if len(start) else [], lambda *_: None)
        state = [{"id": i, "side": side, "entity": e} for (i, side), es in sorted(last.items()) for e in es]
        return pa.table({"variant": pa.array([key[0].as_py()], pa.string()), "stretch": pa.array([key[1].as_py()], pa.int64()), "state": pa.array([state], start.schema.field("state").type)})

    def shown(key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])

        def show(i: int, date: object, side: str, held: list) -> None:
            for column, values in zip(out, ([i] * len(held), [date] * len(held), [side] * len(held), held), strict=True):
                column.extend(values)

        if len(table):
            fold(table, start["state"][0].as_py() or [] if len(start) else [], show)
        kinds = (pa.int32(), pa.date32(), pa.string(), table.schema.field("entity").type)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "date", "side", "entity"])

    def folded(starts: DataFrame, only: DataFrame | None, run: Callable, schema: str) -> DataFrame:
        have = rows
        if tracked:  # names that come in from the stretch before have places too
            coming = starts.where(F.col("variant").isin(tracked)).select("variant", "stretch", F.explode("state").alias("x")).select("variant", "stretch", F.col("x.entity").alias("entity"))
            have = have.unionByName(placed(coming.join(rows.select(*names).distinct(), names, "left_anti")).select(*columns))
        if only is not None:
            have = have.join(only.select("variant", "stretch"), ["variant", "stretch"], "left_semi")
        return have.groupBy("variant", "stretch").cogroup(starts.groupBy("variant", "stretch")).applyInArrow(run, schema)

    spark = scores.sparkSession
    schema = f"variant string, stretch long, state {item}"
    starts = spark.createDataFrame([], schema)
    if (days.agg(F.max("stretch")).first()[0] or 0) > 0:
        ends_ = durable(folded(starts, None, end_state, schema), "end-states")
        while True:
            now = durable(ends_.withColumn("stretch", F.col("stretch") + 1), "start-states")
            was = starts.select("variant", "stretch", F.col("state").alias("_was"))
            changed = durable(now.join(was, ["variant", "stretch"], "left").where(~F.col("state").eqNullSafe(F.coalesce("_was", F.array().cast(item)))).drop("_was"), "changed")
            starts = now
            if changed.isEmpty():
                break
            again = durable(folded(changed, changed, end_state, schema), "end-states")
            ends_ = durable(again.unionByName(ends_.join(again.select("variant", "stretch"), ["variant", "stretch"], "left_anti")), "end-states")
    return folded(starts, None, shown, f"id int, date date, side string, entity {kind}")
