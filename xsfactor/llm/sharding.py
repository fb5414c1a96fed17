"""Resharding by minimum-cost flow.

Old shards are counted in blocks (a fixed number for each, dealt by a hash of the row), so that what reaches the driver is
bounded: a block's rows and bytes. A flow network has the old shards as sources with their bytes as supply, the new shards
as sinks with their capacities, and an edge between each two that costs 1 a byte, or nothing where a shard keeps its own
bytes. The cheapest flow (successive shortest paths) says how many bytes go from where to where. Blocks then follow the
flow, largest first, each to the shard that its old shard still owes the most; what blocks can't meet exactly is evened out
by the smallest ones. Rows get their slots from their block's start and their place in it. Only shards that win or lose
rows are written anew.

Defined cases: null text has no bytes; a null doc_id or source is a value like others; repeated rows are placed each;
texts of any length stay whole, so a shard can miss its size by part of a block; an empty table gives empty shards; other
columns are written along, but for those named size, old_shard, shard or slot, which are replaced.
"""

from __future__ import annotations

import heapq
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, shared_dir

BLOCKS = 2048


def cheapest_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that sends all supply within room; successive shortest paths with potentials."""
    n, m = len(supply), len(room)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, cap: int, c: int) -> None:
        graph[a].append([b, cap, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, r in enumerate(room):
        edge(n + j, sink, r, 0)
    if sum(supply) > sum(room):
        raise ValueError("the new shards don't hold the old ones")
    height = [0] * len(graph)
    left = sum(supply)
    while left:
        far = [float("inf")] * len(graph)
        far[source], via, heap = 0, [None] * len(graph), [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, cap, c, _) in enumerate(graph[a]):
                if cap and (e := d + c + height[a] - height[b]) < far[b]:
                    far[b], via[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        height = [h + (f if f < float("inf") else 0) for h, f in zip(height, far, strict=True)]
        path, at = [], sink
        while at != source:
            a, k = via[at]
            path.append(graph[a][k])
            at = a
        push = min(left, *(e[1] for e in path))
        for e in path:
            e[1] -= push
            graph[e[0]][e[3]][1] += push
        left -= push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, _, _, back in graph[i]:
            if n <= b < n + m:
                flow[i][b - n] = graph[b][back][1]
    return flow


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def assign(blocks: pd.DataFrame, old: int, new: int, room: list[int] | None = None) -> pd.DataFrame:
    """blocks (old, block, n, bytes) with their shard and first slot there."""
    blocks = blocks.sort_values(["bytes", "old", "block"], ascending=[False, True, True]).reset_index(drop=True)
    supply = [int(blocks.loc[blocks["old"] == i, "bytes"].sum()) for i in range(old)]
    room = room or capacities(sum(supply), new)
    owed = cheapest_flow(supply, room, [[int(i != j) for j in range(new)] for i in range(old)])
    short = list(room)  # bytes that a shard is short of its capacity
    shard = []
    for i, size in zip(blocks["old"].tolist(), blocks["bytes"].tolist(), strict=True):
        due = owed[i]
        j = max(range(new), key=lambda j: (min(due[j], short[j]) >= size, min(due[j], short[j]), j == i))
        if min(due[j], short[j]) * 2 < size:  # no debt is near this block's size: where most room is
            j = max(range(new), key=lambda j: (short[j], j == i))
        due[j] -= size
        short[j] -= size
        shard.append(j)
    blocks["shard"] = shard
    blocks = blocks.sort_values(["shard", "old", "block"]).reset_index(drop=True)
    blocks["first"] = blocks.groupby("shard")["n"].cumsum() - blocks["n"]
    return blocks


def row_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def reshard(docs: DataFrame, old_shard: Column, old: int, new: int, room: list[int] | None = None, blocks: int = BLOCKS) -> tuple[DataFrame, set[int]]:
    """(docs with columns size, old_shard, shard, slot; the shards that must be written). old_shard: a condition on docs.

    The counts of blocks and the plan have `old * blocks` rows at most, so the plan may be broadcast. Rows move once, to
    where their shard's part is written.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("size", "old_shard", "shard", "slot")))
    o, b, s, at, start = (free_name(docs.columns, x) for x in ("_old", "_block", "_size", "_part", "_first"))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.withColumns({o: old_shard.cast("int"), b: block, s: row_bytes()})
    counted = rows.groupBy(o, b).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("bytes")).collect()
    plan = assign(pd.DataFrame([tuple(r) for r in counted], columns=["old", "block", "n", "bytes"]).astype("int64"), old, new, room)
    moved = plan[plan["old"] != plan["shard"]]
    touched = set(moved["shard"].tolist()) | set(moved["old"].tolist())
    frame = docs.sparkSession.createDataFrame(plan[["old", "block", "shard", "first"]].itertuples(index=False, name=None), f"{o} int, {b} int, shard int, {start} long") if len(plan) else docs.sparkSession.createDataFrame([], f"{o} int, {b} int, shard int, {start} long")
    placed = rows.join(F.broadcast(frame), [o, b]).withColumn(at, F.col(b) % 64)
    place = Window.partitionBy("shard", at, o, b).orderBy("doc_id", F.xxhash64("text"))
    placed = placed.repartition("shard", at).withColumn("slot", F.col(start) + F.row_number().over(place) - 1)
    return placed.select(*docs.columns, F.col(s).alias("size"), F.col(o).alias("old_shard"), "shard", F.col("slot").cast("long").alias("slot")), touched


def rewrite(placed: DataFrame, touched: set[int], shards: int, folder: str | None = None) -> DataFrame:
    """Writes the touched shards as folders shard=N and returns all rows: those from the files, the others as they are."""
    folder = folder or f"{shared_dir(placed.sparkSession)}/shards-{uuid.uuid4().hex}"
    dirty = F.col("shard").isin(*touched) if touched else F.lit(False)
    own = placed.columns
    placed.where(dirty).write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    if not touched:
        return placed
    # The schema is given: an empty table leaves no file to take it from.
    back = placed.sparkSession.read.schema(placed.schema).parquet(folder).select(*own)
    return back if len(touched) == shards else back.unionByName(placed.where(~dirty))
