"""Host-level quality rules.

Per document: counts of words, symbols, repeated lines and repeated words, and four rules on them. Per host (the column
`source`): how many documents fail each rule, shrunk toward the other hosts by an empirical beta prior (fitted by the
method of moments over hosts). A host whose shrunk rate passes `host_limit` for any rule is rejected with all its
documents. A document is kept if it passes the base rules and its host isn't rejected. The prior weighs as many documents
as its moments say, but at least one and at most MAX_STRENGTH.

Defined cases: null or empty text has no words and fails the base; a null source is a host of its own; repeated rows are
each judged and each count for their host; an empty table gives an empty result; texts are judged whole, however long; a rate at
the very limit is no failure; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, durable, each_text

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("short", "repeats", "symbols", "dup_lines")
#: A host's prior counts as so many documents at most, and at least one.
MAX_STRENGTH = 10_000.0


def counts(text: str) -> tuple[int, int, int, int, int, int]:
    """The values of COUNTS for a text; n_lines counts lines with a word."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if HAS_WORD.search(x)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
    )


def repeated(words: list[str]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, until = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 3 - max(at, until)
            until = at + 3
    return covered


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def measured_text(text: pa.Array) -> pa.Array:
    found = list(zip(*map(counts, each_text(text)), strict=True)) or [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=COUNTS)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (row: struct of the columns to keep, host, COUNTS). Only texts go to Python, and only counts come back."""
    found = docs.select(
        F.struct(*keep).alias("row"), F.col("source").cast("string").alias("host"), measured_text(F.col("text").cast("string")).alias("found")
    )
    return found.select("row", "host", *(F.col(f"found.{c}").alias(c) for c in COUNTS))


def failures(words_least: int = 50) -> dict[str, Column]:
    """Each rule as a condition that holds where it fails."""
    c = F.col
    return {
        "short": c("n_words") < words_least,
        "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 10 * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
    }


def host_verdicts(measured: DataFrame, host_limit: float) -> DataFrame:
    """Rows (host, n, for each rule its shrunk rate, rejected). Only one row of moments reaches the driver."""
    bad = failures()
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *(F.sum(bad[r].cast("double")).alias(r) for r in RULES),
    )
    n = F.col("n")
    moments = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"),
        *(F.sum(r).alias(r) for r in RULES), *(F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_kk") for r in RULES),
    ).first()
    total, shrunk = moments["n"] or 0.0, []
    for r in RULES:
        mean = (moments[r] or 0.0) / total if total else 0.0
        strength = MAX_STRENGTH
        spread = total - (moments["nn"] or 0.0) / total if total else 0.0
        if spread > 0 and 0 < mean < 1:
            between = (moments[f"{r}_kk"] - total * mean * mean - (moments["hosts"] - 1) * mean * (1 - mean)) / spread
            if between > 0:
                strength = min(MAX_STRENGTH, max(1.0, mean * (1 - mean) / between - 1))
        shrunk.append(((F.col(r) + strength * mean) / (n + strength)).alias(r))
    rates = hosts.select("host", "n", *shrunk)
    return rates.withColumn("rejected", F.greatest(*(F.col(r) for r in RULES)) > host_limit)


def judge(docs: DataFrame, keep: list[str] | None = None, host_limit: float = 0.5) -> DataFrame:
    """Rows (row, host, COUNTS, base_failed, host_rejected, kept), one for each of docs.

    Texts are read once: counts go to a durable table, host totals come from it, and the few columns of a host's verdict
    are joined back. The verdicts are a durable table too, so that the planner knows their size before it deals out rows:
    while they are small, no row moves; beyond that AQE splits a hot host.
    """
    measured = durable(measure(docs, keep or docs.columns), "rules")
    hosts = host_verdicts(measured, host_limit).select(F.col("host").alias("h"), F.col("rejected").alias("host_rejected"))
    hosts = durable(hosts, "hosts")
    bad = failures()
    return (
        measured.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
        .withColumn("base_failed", bad["short"] | bad["repeats"])
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def kept_documents(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns they had."""
    return judge(docs, host_limit=host_limit).where("kept").select("row.*")
