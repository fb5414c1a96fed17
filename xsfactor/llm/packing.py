"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Each document becomes its ids and an end id. It is cut by itself: full sequences first, then what is left goes to a
reciprocal class k (lengths above capacity/(k+1), up to capacity/k), whose bins hold k pieces each. Where a piece would
leave more than `slack` of its share of a bin empty, the part that fits class k+1 exactly is cut off and the rest looked
at again, so bins are nearly full. Bins are filled by counting: a piece's place in its class is its place in its own task
plus what earlier tasks hold of that class, so tasks work independently and no class meets in one task. Of each class
fewer than k pieces are left over; those of all classes (a fixed number at most, whatever the input) are packed together
by first fit decreasing.

Ids are those of the library `tokenizers`. The same vocabulary is read by `tiktoken`, which is several times as fast;
texts with characters for which the two split words differently go to `tokenizers`.

Defined cases: null text is empty, and an empty document is its end id alone; repeated rows are packed each; very long
texts are many pieces; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, texts

CAPACITY = 2048
END_ID = 1
#: Characters that were not letters, marks or digits in every version of Unicode the two libraries may know.
BEYOND = re.compile("[^\u0000-ɏͰ-ϿЀ-ӿ‐-‧‰-⁞₠-₿]")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, k int, task int, nth long"


@functools.cache
def encoders(json_path: str, rank_path: str | None) -> tuple:
    """(the tokenizer, the fast encoder or None), once a worker."""
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(json_path), None
    if rank_path:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(rank_path, "rb"))}
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return slow, fast


def ids_of(text: str, json_path: str, rank_path: str | None) -> np.ndarray:
    slow, fast = encoders(json_path, rank_path)
    if fast is not None and not BEYOND.search(text) and not re.search(r"\s{200}", text):
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
    return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, capacity: int = CAPACITY, slack: float = 0.03) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n ids, in order. Class 0: a full sequence."""
    out = [(capacity, 0)] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left
        share, less = capacity // k, capacity // (k + 1)
        if share - left <= slack * share or less == 0:
            out.append((left, k))
            break
        out.append((less, capacity // less))
        left -= less
    return out


def cut_documents(docs: DataFrame, json_path: str, rank_path: str | None, capacity: int, slack: float) -> DataFrame:
    """Rows (doc_id, PIECE): the pieces of every document, each with its task and its place in its class there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            for at, text in enumerate(texts(b)):
                ids = np.append(ids_of(text, json_path, rank_path), np.uint32(END_ID)).astype("<u4")
                start = 0
                for length, k in cuts(len(ids), capacity, slack):
                    rows.append((at, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), k, task, nth[k]))
                    nth[k] += 1
                    start += length
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "task", "nth"],
            )

    few = docs.select("doc_id", "text")
    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def first_fit(pieces: DataFrame, capacity: int, first: int) -> DataFrame:
    """Packs the pieces in one task, by falling length; for a bounded number of them only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=shape)
        order = sorted(range(len(rows)), key=lambda i, c=[x.to_pylist() for x in rows.select(["length", "task", "k", "nth"]).columns]: (-c[0][i], c[1][i], c[2][i], c[3][i]))
        room: list[int] = []
        seq, off = [0] * len(rows), [0] * len(rows)
        lengths = rows["length"].to_pylist()
        for i in order:
            bin_ = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
            if bin_ == len(room):
                room.append(capacity)
            seq[i], off[i] = first + bin_, capacity - room[bin_]
            room[bin_] -= lengths[i]
        out = rows.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))
        yield from out.to_batches()

    shape = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.dataType.simpleString()]) for f in pieces.schema])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(1).mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def pack(docs: DataFrame, json_path: str, rank_path: str | None = None, capacity: int = CAPACITY, slack: float = 0.03) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece."""
    pieces = durable(cut_documents(docs, json_path, rank_path, capacity, slack), "pieces")
    held = pieces.groupBy("k", "task").agg((F.max("nth") + 1).alias("n"))
    held = durable(
        held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))),
        "held",
    )
    # One row a class: at most capacity classes, about twice its square root with this rule.
    base, full = 0, {}
    for r in held.groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect():
        per = max(r["k"], 1)
        full[r["k"]] = (base, r["n"] // per * per)
        base += r["n"] // per
    if not full:
        return pieces.drop("k", "task", "nth").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    of = lambda j: F.element_at(F.create_map(*(F.lit(x) for k, v in full.items() for x in (k, v[j]))), F.col("k"))
    placed = (
        pieces.join(held.select("k", "task", "before"), ["k", "task"])
        .withColumn("at", F.col("before") + F.col("nth")).withColumn("base", of(0).cast("long")).withColumn("filled", of(1).cast("long"))
    )
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "task", "nth"]
    binned = placed.where("at < filled").withColumn("sequence_id", F.col("base") + F.floor(F.col("at") / F.greatest("k", F.lit(1))))
    whole = binned.where("k <= 1").withColumn("offset", F.lit(0).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    shared = binned.where("k > 1").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rest = first_fit(placed.where("at >= filled").select(*own), capacity, base)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*names).unionByName(shared.select(*names)).unionByName(rest.select(*names))
