"""What the operators of this package share: words, durable tables, batch helpers, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
UPPER_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder (removed at exit); a cluster gets an error, as a
    machine-local folder would not be seen by the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="xsfactor-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, and any executor can be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def each_text(column: pa.Array, step: int = 256) -> Iterator[str]:
    """The texts of a column, null as empty; few are Python strings at a time."""
    for at in range(0, len(column), step):
        for x in column.slice(at, step).to_pylist():
            yield x or ""


def added(batch: pa.RecordBatch, new: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    """The batch with new columns behind its own."""
    arrays = [*batch.columns, *(pa.array(v, t) for t, v in new.values())]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *new])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by keys; holds one group and a batch at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
        cut = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1
        if held and tuple(cols[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cut.tolist(), b.num_rows]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(b.slice(s, e - s))
            if e < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(cols[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def sample(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` of the different ids (one column, id), those of smallest hash; most of the others go before any is sorted.

    How many go comes from an approximate count of different ids, as rows may repeat; a fifth more than needed stays.
    """
    n = ids.agg(F.approx_count_distinct("id", 0.02)).first()[0]
    share = min(1.0, 1.2 * most / max(n, 1))
    near = ids.where(F.xxhash64("id") <= F.lit(min(int((2 * share - 1) * 2**63), 2**63 - 1)))
    return near.distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, text, the other columns of ids) of a sample that is small enough to be broadcast."""
    found = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), F.col("_id") == F.col("id"))
    others = [F.first(c).alias(c) for c in ids.columns if c != "id"]
    return found.groupBy("id").agg(F.min("text").alias("text"), *others)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """A column name near the wanted one that df doesn't have (names are compared without case, as Spark does)."""
    have = {x.lower() for x in taken}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def schema_ddl(df: DataFrame, extra: str) -> str:
    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {extra}" if own else extra


def marked_by(df: DataFrame, key: str, ids: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """df with a flag that holds for every row whose key is among ids (one column of longs), and for few others.

    ids become a bitmap of 2^bits hash values, a row for each 64 of them: its size is fixed, so it may be broadcast.
    """
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` & 63 as int))")
    id_ = ids.columns[0]
    flag, at, word, mask = (free_name(df.columns, x) for x in ("_marked", "_at", "_word", "_mask"))
    spots = ids.where(F.col(id_).isNotNull()).select(spot(id_).alias(at)).groupBy(F.shiftright(at, 6).alias(word))
    words = F.broadcast(spots.agg(F.bit_or(bit(at)).alias(mask)))
    found = df.withColumn(at, spot(key)).join(words, F.shiftright(at, 6) == F.col(word), "left")
    hit = F.coalesce(F.col(mask).bitwiseAND(bit(at)) != 0, F.lit(False))
    return found.withColumn(flag, hit).select(*df.columns, flag), flag


def with_ids(df: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of df whose key is among ids. A bitmap lets the others go first, so only candidates move to the exact join."""
    marked, flag = marked_by(df, key, ids, bits)
    id_ = ids.columns[0]
    return marked.where(flag).drop(flag).join(ids.withColumnRenamed(id_, key), key, "left_semi").select(*df.columns)


def without_ids(df: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of df whose key isn't among ids, or null. Only rows that the bitmap can't clear move to the exact join."""
    marked, flag = marked_by(df, key, ids, bits)
    rest = marked.where(flag).drop(flag).join(ids.withColumnRenamed(ids.columns[0], key), key, "left_anti")
    return marked.where(~F.col(flag)).drop(flag).unionByName(rest.select(*df.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (v, root), root the smallest vertex; only vertices with an edge.

    Contraction: every vertex points to its smallest neighbour if that is below it, pointers are followed twice, edges
    move to the roots, until none is left. Minima combine before the shuffle; joins on a hub are for AQE to split.
    """
    spark = edges.sparkSession
    edges = durable(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("p"))
        up = durable(up, "up")
        for _ in range(2):
            q = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            up = up.join(q, "p").select("v", F.col("pp").alias("p"))
        up = durable(up, "up")
        to = lambda x, y: up.select(F.col("v").alias(x), F.col("p").alias(y))
        edges = durable(
            edges.join(to("a", "ra"), "a").join(to("b", "rb"), "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a < b").distinct(),
            "edges",
        )
        if roots is None:
            roots = up.select("v", F.col("p").alias("root"))
        else:
            q = up.select(F.col("v").alias("root"), F.col("p").alias("next"))
            roots = durable(
                roots.join(q, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "roots"
            )
    return roots if roots is not None else spark.createDataFrame([], "v long, root long")
