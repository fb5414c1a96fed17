"""Bar files of any known layout, rows that don't fit going to a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BAR_ALIASES, BARS, pad_code

#: Between cells; commas within quotes don't count.
COMMA = r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
NUMBERS = [f.name for f in BARS.fields if f.name not in ("date", "entity")]


def cells(line: Column) -> Column:
    # Only a line with quotes needs the pattern, which looks ahead to the line's end at each comma.
    parts = F.when(F.contains(line, F.lit('"')), F.split(line, COMMA, -1)).otherwise(F.split(line, ",", -1))
    return F.transform(parts, lambda c: F.trim(F.regexp_replace(F.trim(c), r'^"|"$', "")))


def canonical(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in BAR_ALIASES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, name), F.lower(name))


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (file, line) without byte-order marks, carriage returns and blank lines."""
    raw = spark.read.text(folder, pathGlobFilter="*.csv").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿|\r$", "").alias("line"))
    return raw.where(F.trim("line") != "")


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a folder's files but the headers: (file, line, reason, row); row has the layout of bars.

    A header is a line with a date column's name in it; each file may have its own order and names of columns (known other
    names count). Reasons: `no header` (a file without one), `cells` (another number than the header's), `date` (none, or not
    one), `close` (none), or the name of a column whose cell is no number. The entity is the file's stem if it is of digits
    (cut to six), else the cell of that name, padded to six. Lines of a file that repeat its header are left out.
    """
    split = lines_of(spark, folder).withColumn("cells", cells(F.col("line"))).withColumn("names", F.transform("cells", canonical))
    # Few lines have a date column's name anywhere; only their cells' names are looked up.
    dates = [k for k, v in BAR_ALIASES.items() if v == "date"]
    near = F.contains(F.lower("line"), F.lit("date"))
    for k in dates:
        near = near | F.contains(F.col("line"), F.lit(k))
    is_header = F.when(near, F.array_contains("names", "date")).otherwise(F.lit(False))
    # Of several headers in a file the smallest counts, which is the same whatever the order of lines.
    headers = split.where(is_header).groupBy("file").agg(F.min("names").alias("header"))
    rows = split.where(~is_header).drop("names").join(headers, "file", "left")
    fits = F.size("cells") == F.size("header")
    got = F.when(F.col("header").isNotNull() & fits, F.map_from_entries(F.array_distinct(F.arrays_zip(F.col("header").alias("k"), F.col("cells").alias("v")))))
    rows = rows.withColumn("got", F.when(F.size(F.array_distinct("header")) == F.size("header"), got))
    names = F.array(*map(F.lit, NUMBERS))
    full = lambda c: F.nullif(c, F.lit(""))
    number = lambda c: F.when(~F.upper(full(c)).isin("NAN", "NULL", "NONE", "-"), full(c))
    # Each step is bound once a row: a lambda would work its outer expressions out again for each element.
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    text = once(F.col("got"), lambda g: F.struct(
        full(F.try_element_at(g, F.lit("date"))).try_cast("date").alias("day"), full(F.try_element_at(g, F.lit("entity"))).alias("entity"),
        F.transform(names, lambda c: number(F.try_element_at(g, c))).alias("text")))
    value = once(text, lambda r: F.struct(r["day"].alias("day"), r["entity"].alias("entity"), r["text"].alias("text"), F.transform(r["text"], lambda x: x.try_cast("double")).alias("value")))
    odd = lambda r: F.filter(names, lambda c, k: F.get(r["text"], k).isNotNull() & F.get(r["value"], k).isNull())
    parsed = once(value, lambda r: F.struct(r["day"].alias("day"), r["entity"].alias("entity"), r["value"].alias("value"), F.get(odd(r), F.lit(0)).alias("odd")))
    rows = rows.withColumn("x", parsed)
    reason = (
        F.when(F.col("header").isNull(), "no header").when(~fits | F.col("got").isNull(), "cells").when(F.col("x.day").isNull(), "date")
        .when(F.col("x.odd").isNotNull(), F.col("x.odd")).when(F.get("x.value", F.lit(NUMBERS.index("close"))).isNull(), "close")
    )
    stem = full(F.substring(F.regexp_extract("file", r"/([0-9]+)\.csv$", 1), 1, 6))
    row = F.struct(F.col("x.day").alias("date"), pad_code(F.coalesce(stem, "x.entity")).alias("entity"), *(F.get("x.value", F.lit(k)).alias(c) for k, c in enumerate(NUMBERS)))
    return rows.select("file", "line", reason.alias("reason"), row.alias("row"))


def imported(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good bars, quarantine): quarantine has (file, line, reason)."""
    found = judged(spark, folder)
    return found.where("reason is null").select("row.*"), found.where("reason is not null").select("file", "line", "reason")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """By file how many lines are good and bad, and by reason how many of the bad."""
    by = judged(spark, folder).groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("file").agg(
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("bad"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons"),
    )
