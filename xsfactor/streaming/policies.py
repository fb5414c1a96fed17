"""Policies on a stream of scores: what each setting holds is state in a store, and a date is settled when it is past.

A setting is a key. Its state is what it holds and the dates that aren't settled yet; a timer for each date goes off when the
watermark passes it, and the dates before it are settled in order. So rows of a date may come in several batches and in any
order, as late as the watermark allows, and a query that is stopped goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.portfolio import policy_rule

SCORES = "date date, entity long, y_pred double"
HELD = "setting int, date date, side string, entity long"
DAY = 86_400_000


def with_state_store(spark: SparkSession) -> SparkSession:
    """Timers and several states a key need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def scores(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files with scores, so many files a batch."""
    return spark.readStream.schema(SCORES).option("maxFilesPerTrigger", files).parquet(path)


class Holder(StatefulProcessor):
    """Settings by number: (policy, parameter, names a side), as in portfolio.grid. A row without an entity settles dates before it."""

    def __init__(self, settings: list[tuple[str, object, int]]):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "long array<bigint>, short array<bigint>, settled int, dates int")
        self.open = handle.getMapState("open", "day int", "entity array<bigint>, s array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        settled = self.held.get()[2] if self.held.exists() else -1 << 31
        for batch in rows:
            batch = batch[batch["entity"].notna()]
            days = (pd.to_datetime(batch["date"]) - pd.Timestamp(0)).dt.days
            for day, part in batch.groupby(days):
                day = int(day)
                if day <= settled:
                    continue  # too late
                names, s = part["entity"].astype(int).tolist(), [None if x != x else float(x) for x in part["y_pred"].astype(float)]
                if self.open.containsKey((day,)):
                    before = self.open.getValue((day,))
                    names, s = list(before[0]) + names, list(before[1]) + s
                else:
                    self.handle.registerTimer(day * DAY)
                self.open.updateValue((day,), (names, s))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        policy, x, n = self.settings[key[0]]
        rule = policy_rule(policy, n, x)
        long, short, settled, dates = self.held.get() if self.held.exists() else ([], [], -1 << 31, 0)
        held, out = {"long": set(long), "short": set(short)}, []
        past = sorted(k[0] for k in self.open.keys() if k[0] * DAY <= expiredTimerInfo.getExpiryTimeInMs())
        for day in past:
            names, s = self.open.getValue((day,))
            s = [None if v is None or v != v else v for v in s]
            best = [e for _, _, e in sorted((v is None, -(v or 0.0), e) for e, v in zip(names, s, strict=True))]
            for side, ranked in (("long", best), ("short", best[::-1])):
                held[side] = set(rule(held[side], ranked, dates))
                out += [(key[0], pd.Timestamp(day, unit="D").date(), side, e) for e in sorted(held[side])]
            settled, dates = day, dates + 1
            self.open.removeKey((day,))
        if past:
            self.held.update((sorted(held["long"]), sorted(held["short"]), settled, dates))
        yield pd.DataFrame(out, columns=["setting", "date", "side", "entity"])

    def close(self) -> None:
        pass


def held(stream: DataFrame, settings: list[tuple[str, object, int]], late: str = "0 days") -> DataFrame:
    """Rows (setting, date, side, entity) of a stream (date, entity, y_pred), once a date is past by `late`."""
    timed = stream.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    each = timed.withColumn("setting", F.explode(F.array(*(F.lit(i) for i in range(len(settings))))))
    return each.groupBy("setting").transformWithStateInPandas(statefulProcessor=Holder(settings), outputStructType=HELD, outputMode="Append", timeMode="EventTime")
