"""Exact cosine join of vectors by dual traversal of cover trees.

Vectors of length 1 have cosine c or more where their distance is sqrt(2 - 2c) at most. A cover tree has nested levels:
the centres of a level stand for all points within its radius, which halves from level to level. A dual traversal takes
two nodes: if their centres are farther apart than the limit and both covering radii, no pair below can link; if the
centres' distance and both radii stay within the limit, every pair links and is counted without being looked at; else the
wider node is opened, and two leaves are compared by one matrix product.

A tree over a bounded sample cuts the space into cells. A cell's radius is measured over all its vectors; large cells are
cut into blocks, and two blocks meet in a task unless the bound on their cells rules it out. So no task holds more than
two blocks, a hot cell becomes many tasks, and links are only counted and joined into a forest, never listed.

In spaces of high intrinsic dimension, distances between unlike vectors hardly differ and the bounds rule out little:
the work then grows with the square of the number of different vectors.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a
null vec_id, nor vectors of different lengths; rows that share a vec_id are one vector, the smallest; equal vectors are
compared once and count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, grouped

SAMPLE, CELLS, BLOCK, LEAST_BLOCKS, LEAF, FAN = 2048, 512, 16384, 12, 256, 48
#: Bounds by distances are used where they hold with this much to spare; matrix products decide the rest.
SPARE = 1e-6


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """From each row of x to each row of c, all of length 1 (or 0)."""
    square = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
    return np.sqrt(np.maximum(square, 0))


def net(x: np.ndarray, radius: float, most: int) -> np.ndarray:
    """Rows of x that are centres: each row is within radius of one, unless `most` were taken before."""
    gap = np.full(len(x), np.inf)
    out = []
    while len(out) < most and len(far := np.flatnonzero(gap > radius)):
        out.append(int(far[0]) if not out else int(far[np.argmax(gap[far])]))
        gap = np.minimum(gap, distances(x, x[out[-1:]])[:, 0])
    return np.array(out)


def build(x: np.ndarray, rows: np.ndarray | None = None, radius: float = 1.0, leaf: int = LEAF) -> Node:
    """The tree over rows of x; radius: that of the children's level."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows[0]]
    node = Node(rows, centre, float(distances(x[rows], centre[None]).max()) if len(rows) else 0.0)
    if len(rows) <= leaf or node.radius < SPARE or radius < 1e-4:
        return node
    centres = net(x[rows], radius, FAN)
    near = distances(x[rows], x[rows[centres]]).argmin(1)
    for k in range(len(centres)):
        own = rows[near == k]
        own = np.concatenate([rows[centres[k : k + 1]], own[own != rows[centres[k]]]])
        if len(own) == len(rows):  # one centre covers all: on to a level of half the radius
            return build(x, own, radius / 2, leaf)
        node.children.append(build(x, own, radius / 2, leaf))
    return merged(node, x, leaf)


def merged(node: Node, x: np.ndarray, leaf: int) -> Node:
    """Small leaves side by side become one, so that products stay large; its radius is measured anew."""
    small = [c for c in node.children if not c.children and len(c.rows) < leaf // 4 and c.radius > 0.25]
    rest = [c for c in node.children if not any(c is s for s in small)]
    group: list[np.ndarray] = []
    for c in small:
        if group and sum(map(len, group)) + len(c.rows) > leaf:
            rest.append(leaf_of(np.concatenate(group), x))
            group = []
        group.append(c.rows)
    if group:
        rest.append(leaf_of(np.concatenate(group), x))
    node.children = rest
    return node


def leaf_of(rows: np.ndarray, x: np.ndarray) -> Node:
    return Node(rows, x[rows[0]], float(distances(x[rows], x[rows[:1]]).max()))


class Links:
    """What a traversal finds: for each vector the weight it links with, and a forest of links."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, dim: np.ndarray, least: float):
        self.x, self.weight, self.least = x, weight, least
        self.limit = float(np.sqrt(2 - 2 * least))
        self.dim = dim if len(set(dim.tolist())) > 1 else None
        self.n, self.up, self.edges = np.zeros(len(x), np.int64), np.arange(len(x)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return int(i)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:  # pointers are followed to the end, so equal roots show at once
            flat = self.up[self.up]
            if (flat == self.up).all():
                break
            self.up = flat
        ra, rb = self.up[a], self.up[b]
        at = np.flatnonzero(ra != rb)
        if len(at):
            _, first = np.unique(ra[at] * len(self.up) + rb[at], return_index=True)
            for i in at[first].tolist():
                x, y = self.root(int(a[i])), self.root(int(b[i]))
                if x != y:
                    self.up[x] = y
                    self.edges.append((int(a[i]), int(b[i])))

    def all_of(self, r: np.ndarray, s: np.ndarray, same: bool) -> None:
        """Every pair between the rows links."""
        w = self.weight
        if same:
            self.n[r] += w[r].sum() - w[r]
            self.union(np.repeat(r[:1], len(r) - 1), r[1:])
        else:
            self.n[r] += w[s].sum()
            self.n[s] += w[r].sum()
            self.union(np.repeat(r[:1], len(s)), s)
            self.union(r[1:], np.repeat(s[:1], len(r) - 1))

    def compare(self, r: np.ndarray, s: np.ndarray, same: bool) -> None:
        ok = self.x[r] @ self.x[s].T >= self.least
        if self.dim is not None:
            ok &= self.dim[r][:, None] == self.dim[s][None]
        if same:
            np.fill_diagonal(ok, False)
        if not ok.any():
            return
        self.n[r] += ok @ self.weight[s]
        if same:
            ok = np.triu(ok)
        else:
            self.n[s] += ok.T @ self.weight[r]
        i, j = np.nonzero(ok)
        self.union(r[i], s[j])

    def meet(self, first: Node, second: Node) -> None:
        todo = [(first, second)]
        while todo:
            a, b = todo.pop()
            same = a is b
            gap = 0.0 if same else float(np.sqrt(max(0.0, ((a.centre - b.centre) ** 2).sum())))
            reach = a.radius + b.radius
            if gap - reach > self.limit + SPARE:
                continue
            if gap + reach < self.limit - SPARE and self.dim is None:
                self.all_of(a.rows, b.rows, same)
            elif not a.children and not b.children:
                self.compare(a.rows, b.rows, same)
            elif same:
                kids = a.children
                todo += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
            elif b.children and (not a.children or b.radius > a.radius):
                todo += [(a, k) for k in b.children]
            else:
                todo += [(k, b) for k in a.children]


def unit(rows: pa.Array | pa.ChunkedArray | list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors at length 1, short ones filled with zeros; their numbers of components)."""
    if isinstance(rows, list):
        rows = pa.array(rows, pa.list_(pa.float64()))
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    flat, dim = rows.flatten().to_numpy(zero_copy_only=False), rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(set(dim.tolist())) > 1:
        x = np.zeros((len(dim), dim.max()))
        x[np.arange(dim.max())[None] < dim[:, None]] = flat
    else:
        x = flat.reshape(len(dim), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True)), dim


def cells_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the sample's levels, radii halving, until there are `cells`."""
    radius, out = 1.0, np.empty(0, int)
    while len(out) < min(cells, len(sample)) and radius > 1e-3:
        out = net(sample, radius, cells)
        radius /= 2
    return sample[out]


def join(vectors: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each of vectors: links at cosine `least` or more."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0)
    ones = durable(v.where(usable).groupBy("vec_id").agg(F.min("e").alias("e")), "vectors")
    same = ones.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    same = durable(same, "different")
    total = same.count()
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    lone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if not total:
        return every.select("vec_id", *lone)
    sample = same.select("e", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(SAMPLE).select("e").toArrow()["e"].to_pylist()
    width = max(map(len, sample))
    blocks = max(LEAST_BLOCKS, -(-total // block))
    centres = cells_of(unit([r + [0.0] * (width - len(r)) for r in sample])[0], min(CELLS, max(1, blocks // 2)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, _ = unit([r[:width] if any(r[:width]) else [1.0] for r in b.column(1).to_pylist()])
            x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))
            gap = distances(x, centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(gap.argmin(1), pa.int32()), pa.array(gap.min(1))], names=["rep", "e", "w", "cell", "gap"])

    celled = durable(same.select("rep", "e", "w").mapInArrow(place, "rep long, e array<double>, w long, cell int, gap double"), "cells")
    # A row a cell, CELLS at most. Components beyond the sample's width would make gaps too small: then no cell is ruled out.
    plain = not celled.where(F.size("e") != width).isEmpty()
    stats = {r["cell"]: (r["n"], r["r"]) for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect()}
    size, starts, at = -(-total // blocks), {}, 0
    for c, (n, _) in sorted(stats.items()):
        starts[c] = (at, max(1, round(n / size)))
        at += starts[c][1]
    limit = float(np.sqrt(2 - 2 * least))
    apart = distances(centres, centres)
    near = [(c, d) for c in stats for d in stats if plain or apart[c, d] - stats[c][1] - stats[d][1] <= limit + SPARE]
    partners = spark.createDataFrame([(c, starts[c][0], starts[c][1], starts[d][0], starts[d][1]) for c, d in near], "cell int, s int, k int, s2 int, k2 int")
    mine = (F.col("s") + F.pmod(F.xxhash64("rep"), F.col("k"))).cast("int")
    met = (
        celled.select("rep", "e", "w", "cell").join(partners, "cell").withColumn("own", mine)
        .withColumn("other", F.explode(F.sequence(F.col("s2"), F.col("s2") + F.col("k2") - 1)))
        .select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "w", "e")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["lo", "hi"]):
            x, dim = unit(g["e"])
            rep, own = g["rep"].to_numpy(), g["own"].to_numpy()
            links = Links(x, g["w"].to_numpy(), dim, least)
            parts = [build(x, r) for k in np.unique(own) if len(r := np.flatnonzero(own == k))]
            if g["lo"][0] == g["hi"][0]:
                links.meet(parts[0], parts[0])
            elif len(parts) == 2:
                links.meet(*parts)
            some = np.flatnonzero(links.n)
            a, b = np.array(links.edges, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[some], rep[a]])), pa.array([None] * len(some) + rep[b].tolist(), pa.int64()), pa.array(np.concatenate([links.n[some], np.zeros(len(a), np.int64)]))],
                names=["a", "b", "n"],
            )

    found = met.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "rep").mapInArrow(compare, "a long, b long, n long")
    found = durable(found, "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("v").alias("rep"), "root")
    copies = same.where("w > 1").select("e", F.col("rep").alias("r"), "w")
    named = ones.join(copies, "e", "left").select("vec_id", F.coalesce("r", "vec_id").alias("rep"), F.coalesce("w", F.lit(1)).alias("w"))
    told = (
        named.join(counts, "rep", "left").join(roots, "rep", "left")
        .select(F.col("vec_id").alias("id"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("root", "rep").alias("c"))
    )
    told = told.where("n > 0")  # those without a link need no row
    out = every.join(told, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
