"""Results that are whole or not there: bundles of a run's tables, and stages that are read again instead of built again.

Tables are written aside, under names of their own; the last thing is a row in the manifest, a folder of small JSON files
that is only appended to. Readers follow the manifest, so a run that breaks leaves nothing that they see, and a second
attempt stands beside the first.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import clean

MANIFEST = "key string, attempt string, name string, path string, at timestamp, about string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Rows (key, attempt, name, path, at, about) of what is whole; none where nothing has been written yet."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def commit(spark: SparkSession, root: str, key: str, paths: dict[str, str], about: dict) -> None:
    """One file with a row for each table: all of them appear at once."""
    attempt, told = uuid.uuid4().hex, json.dumps(about, sort_keys=True)
    rows = [(key, attempt, name, path, told) for name, path in sorted(paths.items())]
    df = spark.createDataFrame(rows, "key string, attempt string, name string, path string, about string").withColumn("at", F.current_timestamp())
    df.select("key", "attempt", "name", "path", "at", "about").coalesce(1).write.mode("append").json(f"{root}/manifest")


def bundle(spark: SparkSession, root: str, run: str, tables: dict[str, DataFrame], about: dict) -> None:
    """A run's tables (metrics, series, regimes ...) under one run id; about: strategy, parameters, highlights."""
    attempt, paths = uuid.uuid4().hex, {}
    for name, df in tables.items():
        paths[name] = f"{root}/runs/{run}/{attempt}/{name}"
        df.write.parquet(paths[name])
    commit(spark, root, run, paths, about)


def whole_runs(spark: SparkSession, root: str) -> DataFrame:
    """Rows (key, name, path, at, about) of the attempt that was committed last, for each key."""
    of_key = Window.partitionBy("key")
    attempt = F.struct("at", "attempt")
    rows = manifest(spark, root).withColumn("last", F.max(attempt).over(of_key))
    return rows.where(attempt == F.col("last")).select("key", "name", "path", "at", "about")


def of_runs(spark: SparkSession, root: str, name: str, runs: list[str] | None = None) -> DataFrame | None:
    """A table of all whole runs (or those named) with their run_id; None if no whole run has it."""
    rows = whole_runs(spark, root).where(F.col("name") == name)
    if runs is not None:
        rows = rows.where(F.col("key").isin(runs))
    out = None
    for r in rows.orderBy("key").collect():  # a row a run
        part = spark.read.parquet(r["path"]).withColumn("run_id", F.lit(r["key"]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def newest_run(spark: SparkSession, root: str, run: str | None = None) -> str | None:
    """The run asked for if it is whole, else the newest by id."""
    found = whole_runs(spark, root).agg(F.max(F.when(F.col("key") == run, F.col("key"))).alias("asked"), F.max("key").alias("newest")).first()
    return found["asked"] or found["newest"]


def summaries(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """Rows (run_id, highlight, value) from what runs tell about themselves; NaN is null."""
    about = F.from_json("about", "map<string,double>", {"allowNonNumericNumbers": "true"})
    rows = whole_runs(spark, root).select(F.col("key").alias("run_id"), "about").distinct().withColumn("m", about)
    return rows.select("run_id", F.explode(F.map_filter("m", lambda k, _: k.isin(*names))).alias("highlight", "value")).withColumn("value", clean(F.col("value")))


def metrics_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metrics as JSON in which NaN may stand for a number; NaN and infinities are null, in structs too."""
    df = spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)

    def fixed(c, kind):  # noqa: ANN001, ANN202
        if kind.typeName() in ("double", "float"):
            return clean(c)
        if kind.typeName() == "struct":
            return F.when(c.isNotNull(), F.struct(*(fixed(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return df.select(*(fixed(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """What tells whether files have changed: their names, lengths and times; their contents aren't read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return f"{total['n']}:{total['h']}"


@dataclass
class Artefact:
    """A stage's result: its key, the table, and whether it was there already."""

    key: str
    table: DataFrame
    reused: bool


@dataclass
class Stages:
    """Stages whose results are addressed by what goes into them.

    A key is the hash of the stage's name and version, its settings and the keys of its inputs. What is whole under that key
    is read, anything else is built and written. A changed setting changes the keys of all that depends on it, and nothing else.
    """

    spark: SparkSession
    root: str
    log: list[tuple[str, str, bool]] = field(default_factory=list)

    def run(self, name: str, settings: dict, inputs: list[Artefact | str], build: Callable[[], DataFrame], version: int = 1) -> Artefact:
        """inputs: artefacts, or fingerprints of sources."""
        told = [name, version, settings, [x.key if isinstance(x, Artefact) else x for x in inputs]]
        key = hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()
        there = whole_runs(self.spark, self.root).where((F.col("key") == key) & (F.col("name") == name)).first()
        if there is None:
            path = f"{self.root}/stages/{name}/{key}-{uuid.uuid4().hex}"
            build().write.parquet(path)
            commit(self.spark, self.root, key, {name: path}, {})
        else:
            path = there["path"]
        self.log.append((name, key, there is not None))
        return Artefact(key, self.spark.read.parquet(path), there is not None)


STATUS = "key string, status string, at timestamp"


def record_status(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Appends rows (key, status, at); the latest of a key counts."""
    rows.select("key", "status", F.col("at").cast("timestamp").alias("at")).write.mode("append").parquet(f"{root}/status")


def statuses(spark: SparkSession, root: str) -> DataFrame:
    """Rows (key, status), the latest of each key; of those at one time the greater."""
    try:
        found = spark.read.schema(STATUS).parquet(f"{root}/status")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], STATUS)
    return found.groupBy("key").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
