"""Files: bars as CSV, mappings and settings as JSON, lists as text; results by run."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BARS, REGIME_LABELS, pad_code, rename_known, with_columns_of


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """All `<digits>.csv` files of a folder as one table; the entity is the file's stem cut to six characters.

    The reader drops a byte-order mark and splits large files; values that don't parse become null.
    """
    raw = spark.read.csv(folder, header=True, pathGlobFilter="*.csv").withColumn("_file", F.input_file_name())
    stem = F.regexp_extract("_file", r"([^/]+)\.csv$", 1)
    raw = rename_known(raw.where(stem.rlike("^[0-9]{6,7}$")).withColumn("entity", F.substring(stem, 1, 6)).drop("code"))
    return with_columns_of(raw, BARS.fields).where("date is not null").withColumn("entity", pad_code(F.col("entity")))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct entities that a folder has files for; file names only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    return files.where(stem.rlike("^[0-9]{6,7}$")).select(F.substring(stem, 1, 6).alias("entity")).distinct()


def csv(spark: SparkSession, path: str, schema: T.StructType, rows: int | None = None) -> DataFrame:
    """A CSV of a known layout; a select() on it reaches the scan. rows: a look at the first ones only."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.limit(rows) if rows else df


def regime_factors(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of lists as rows (regime, pos, factor)."""
    kind = "map<string,array<string>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    rows = doc.select(F.explode("m").alias("regime", "factors")).select("regime", F.posexplode("factors").alias("pos", "factor"))
    return rows.withColumn("regime", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in REGIME_LABELS.items() for x in kv)), F.col("regime")), "regime"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file, trimmed, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item != ''")


def newest(files: DataFrame, by: str = "kind", at: str = "modified") -> DataFrame:
    """The newest file of each kind."""
    return files.groupBy(by).agg(F.max_by("path", at).alias("path"), F.max(at).alias(at))


def to_archive(files: DataFrame, keep: int, days: int, now: Column, by: str = "kind", at: str = "modified") -> DataFrame:
    """Files beyond the newest `keep` of their kind that are older than `days`."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), "path"))
    return files.withColumn("n", n).where((F.col("n") > keep) & (F.date_diff(now, F.col(at)) > days)).drop("n")


def parameters(text: str, cast: callable = float) -> list:
    """A comma list of parameters."""
    return [cast(x.strip()) for x in text.split(",") if x.strip()]


def snapshot(spark: SparkSession, settings: dict, run: str) -> DataFrame:
    """One row (run, settings as JSON); what was saved can be read back with from_json."""
    return spark.createDataFrame([(run, json.dumps(settings, sort_keys=True))], "run string, settings string")


def save(df: DataFrame, path: str, kind: str = "parquet", run: str | None = None) -> None:
    """Writes a result, under run=... if a run is named, so that runs stand side by side."""
    target = f"{path}/run={run}" if run else path
    out = df.write.mode("overwrite")
    {"parquet": out.parquet, "csv": lambda p: out.option("header", True).csv(p), "json": out.json, "orc": out.orc}[kind](target)


def checked(df: DataFrame, needed: tuple[str, ...] = ("date", "close")) -> DataFrame:
    """An imported table: an error where a column is missing; rows without a date or value are dropped."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.dropna(subset=list(needed))
