"""Lines that many documents share, in DataFrame functions only.

A line's key is the line without ASCII blanks at its ends, A-Z lower-cased. Keys of at least `least_chars` code points
found in at least `least_docs` documents lose all their lines except in the largest doc_id that holds them.

Each long line becomes (hash, document, position), without text. Hashes are range-partitioned, each split in SALTS parts
by its documents so that one very common line isn't one task's work, and sorted by document (largest first) and position:
in a sorted part a line that follows another document's is that document's first occurrence, and the first of all is the
part's largest document. The parts' counts make the keys' verdicts, which go back to parts, never to all rows of a key.
What comes out is a bitmap of kept lines for each document with a dropped line: words of 64 lines, of which only those
with a dropped line are stored. Texts meet their bitmaps where they are needed; those without a dropped line don't move.
Joins are merge joins at every size, as neither side of any is bounded.

Defined cases: null and empty texts are one empty line; rows that share a doc_id are one document (it counts once; their
lines go or stay alike); lines of a row with a null doc_id neither count nor go; equal lines within a document count once and
go or stay together; an empty table gives none; long texts are split like others; other columns pass through.

Keys are compared by 96 bits of hash: of 10^12 different lines two share it with a probability of about 10^-5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_name, marked_by

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 1024
DOC, ROW, KEEP = "doc_id", "text_hash", "keep"


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case. In ASCII texts that is what lower() does, which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """Rows (h, h2, doc_id, text_hash, pos) of all lines whose key is long enough."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias(DOC), F.xxhash64(whole(F.col("text"))).alias(ROW), F.posexplode(F.split(lowered(whole(F.col("text"))), "\n", -1)).alias("pos", "line")
    )
    keyed = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= least_chars)
    return keyed.select(F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), DOC, ROW, "pos")


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Rows (doc_id, text_hash, n_dropped, keep) of the documents with a dropped line.

    keep: structs (word, bits), by word; bit i of a word says whether line 64 * word + i stays. Words that aren't there
    keep all their lines. text_hash is xxhash64 of the text, as rows may share a doc_id.
    """
    part = ["h", "h2", "part"]
    lines = durable(long_lines(docs, least_chars), "lines")
    lines = lines.withColumn("part", F.pmod(F.xxhash64(DOC), F.lit(SALTS)))
    in_order = Window.partitionBy(*part).orderBy(F.desc(DOC), "pos")
    first = F.coalesce(F.lag(DOC).over(in_order) != F.col(DOC), F.lit(True))
    # The range partitioning serves the window and the count.
    streamed = lines.select(*part, DOC, "pos").repartitionByRange(*part).withColumn("first", first)
    counts = durable(streamed.groupBy(*part).agg(F.sum(F.col("first").cast("long")).alias("n"), F.max(DOC).alias("largest")), "line-counts")
    shared = counts.groupBy("h", "h2").agg(F.sum("n").alias("n"), F.max("largest").alias("keeper")).where(F.col("n") >= least_docs)
    verdicts = counts.select(*part).join(shared.select("h", "h2", "keeper").hint("merge"), ["h", "h2"])
    dropped = lines.join(verdicts.hint("merge"), part).where(F.col(DOC) != F.col("keeper")).select(DOC, ROW, "pos")
    # Rows that are equal have the same bitmap: bits are or-ed, then counted.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))
    words = dropped.groupBy(DOC, ROW, F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy(DOC, ROW).agg(
        F.sum(F.bit_count("gone").cast("long")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias(KEEP),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined."""

    def dense(words: Column) -> Column:
        before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get(words, j - 1)["word"])
        filled = lambda w, j: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(j) - 1), F.array(w["bits"]))
        return F.flatten(F.transform(words, filled))

    def kept(words: Column) -> Column:
        bits = lambda i: F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(-1).cast("long"))
        stays = lambda _, i: F.call_function("shiftright", bits(i), i.bitwiseAND(63)).bitwiseAND(1) == 1
        return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")

    # Arrays of one let each inner value be computed once a row.
    bound = F.transform(F.array(keep), dense)
    return F.get(F.transform(bound, kept), F.lit(0))


def dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the lines dropped from their texts, and the columns n_lines (before) and n_dropped."""
    taken = list(docs.columns)
    n_lines, n_dropped = free_name(taken, n_lines), free_name([*taken, n_lines], n_dropped)
    inner = {c: free_name([*taken, n_lines, n_dropped], f"_{c}") for c in (DOC, ROW, KEEP)}
    maps = durable(keep_bitmaps(docs, least_chars, least_docs), "keep-bitmaps")
    maps = maps.select(F.col(DOC).alias(inner[DOC]), F.col(ROW).alias(inner[ROW]), F.col("n_dropped").alias(n_dropped), F.col(KEEP).alias(inner[KEEP]))
    marked, flag = marked_by(docs, DOC, maps.select(inner[DOC]), bits=26)
    count = (F.char_length(whole(F.col("text"))) - F.char_length(F.replace(whole(F.col("text")), F.lit("\n"), F.lit(""))) + 1).cast("long")
    still = marked.where(~F.col(flag)).drop(flag).withColumns({n_lines: count, n_dropped: F.lit(0).cast("long"), "text": whole(F.col("text"))})
    on = (F.col(DOC) == F.col(inner[DOC])) & (F.xxhash64(whole(F.col("text"))) == F.col(inner[ROW]))
    moved = marked.where(flag).drop(flag).join(maps.hint("merge"), on, "left")
    text = F.when(F.col(inner[KEEP]).isNull(), whole(F.col("text"))).otherwise(kept_text(whole(F.col("text")), F.col(inner[KEEP])))
    moved = moved.withColumns({n_lines: count, n_dropped: F.coalesce(n_dropped, F.lit(0).cast("long")), "text": text})
    return still.unionByName(moved.select(*taken, n_lines, n_dropped))
