"""Exact n-gram Jaccard join with count-vector R-trees.

A document is the set of its word shingles (64-bit hashes). Shingles are hashed into 256 groups; a document's counts by
group are a point, and for two points the sum of the coordinates' minima bounds the overlap from above. R-trees over such
points find the pairs whose bound reaches the threshold; the surviving pairs are verified on the sets themselves.

One tree over a corpus would compare nearly every page with every other, so the points get one more axis, and every task
has a tree over its stretch of it. Two sets that reach the threshold differ in at most d shingles. Cut the hash range into
m > d bands: at least m - d bands hold the same shingles in both. Of its m (band, content) tokens a set offers the d + 1
fullest ones, an order that all sets share, so a qualifying pair has one in common. The tokens that two different sets
offer are the axis (tokens with the same members are one): a tree holds some ten thousand points, sorted by token, size and
counts, and is traversed against itself from the root, level by level; two nodes are dropped where their tokens don't meet,
their sizes are too far apart, or the sum of the minima of their largest counts is below the threshold for their smallest
sizes. A token with many members is cut into tiles, and each pair of tiles is dealt out by itself.

Only connectivity is kept: equal sets are one vertex; a token gives a spanning forest of its surviving pairs, strongest
first. After verification and components, tokens that still hold several components are looked at again: each document
gives its strongest surviving pairs with other components, a few at first and eight times as many in every next round, until
a token has given all that it has. So no link between components is missed, pairs within a component are never listed, and
more pairs than a few a document are given only where the ones before were no links.

Defined cases: null or empty text has no shingles and links with nothing; fewer words than a shingle are one shingle;
rows that share a doc_id are one vertex; a null doc_id links with nothing and has a null component; an empty table gives
an empty result; texts are shingled whole, however long; pairs at the very threshold link, and of a group the smallest doc_id
names the class; other columns are ignored (and kept by one_of_each()).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER_ASCII, WORDS, components, durable, each_text, free_name, marked_by, with_ids, without_ids

GROUPS, COARSE, FAN, TILE, LISTED = 256, 16, 8, 256, 64
#: A token is hot if so many of one in HOT_OF documents offer it; its members aren't gathered to be named.
HOT_SEEN, HOT_OF = 32, 1024
U = np.uint64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> U(32))) * ODD[3]
    x = (x ^ (x >> U(29))) * ODD[0]
    return x ^ (x >> U(32))


class Shingles:
    """Sets of shingle hashes of texts; remembers words' hashes, up to 50,000."""

    def __init__(self, k: int):
        self.k, self.seen = k, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes. Letters A-Z count as a-z."""
        words, seen = WORDS.findall(text), self.seen
        if not words:
            return np.empty(0, U)
        if len(seen) > 50_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w.translate(UPPER_ASCII).encode("utf-8", "surrogatepass"))
        h = np.array([seen[w] for w in words], dtype=U)
        n = max(1, len(h) - self.k + 1)
        total = np.full(n, min(len(h), self.k), dtype=U)
        for j in range(min(self.k, len(h))):
            total += mix(h[j : j + n] + ODD[j % 8]) * ODD[(j + 1) % 8]
        return np.unique(mix(total))


class Threshold:
    """Jaccard similarity of p / q at least, and the size classes and bands that follow."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.tops = p, q, [0]

    def class_of(self, n: int) -> int:
        """Classes reach to their `tops`; each spans sizes of the ratio (q / p) squared about."""
        while self.tops[-1] < n:
            low = self.tops[-1] + 1
            self.tops.append(max(low, low * self.q * self.q // (self.p * self.p)))
        return int(np.searchsorted(self.tops, n))

    def differ(self, c: int) -> int:
        """By how many shingles two linked sets can differ whose smaller one is in class c."""
        top = self.tops[c]
        return (self.q - self.p) * (top + top * self.q // self.p) // (self.q + self.p)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """The keys that a set offers, for each class that its smaller or equal partners can be in."""
        n, out = len(h), []
        if not n:
            return np.empty(0, U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + ODD[2]))])
        for c in range(self.class_of(-(-n * self.p // self.q)), self.class_of(n) + 1):
            d = self.differ(c)
            if not d:
                continue  # different sets can't link; equal ones are one vertex
            m = d + 1 + d // 3
            edges = np.searchsorted((h >> U(32)) * U(m) >> U(32), np.arange(m + 1, dtype=U))
            size = np.diff(edges)
            keys = mix((sums[edges[1:]] - sums[edges[:-1]]) + mix(np.arange(m, dtype=U) * ODD[4] + np.full(1, c, U) * ODD[5]))
            out.append(keys[np.lexsort((keys, -size))[: d + 1]])
        return np.concatenate(out) if out else np.empty(0, U)

    def enough(self, overlap: np.ndarray, total: np.ndarray) -> np.ndarray:
        """overlap / (total - overlap) >= p / q, total being the two sizes' sum."""
        return overlap * (self.p + self.q) >= self.p * total


def point(h: np.ndarray) -> bytes:
    return np.bincount((h & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype("<u2" if len(h) < 65536 else "<u4").tobytes()


def features(docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Rows (doc_id, n, fp, vec, keys): set size, fingerprint of the set, count vector, and the tokens that it offers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, limit = Shingles(k), Threshold(p, q)
        for b in batches:
            n, fp, vec, keys = [], [], [], []
            for t in each_text(b.column(1)):
                h = make(t)
                n.append(len(h))
                fp.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                vec.append(point(h))
                keys.append(limit.tokens(h).view(np.int64))
            cols = [pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(vec, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n", "fp", "vec", "keys"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(run, "doc_id long, n long, fp binary, vec binary, keys array<long>")


def shared(offered: DataFrame) -> DataFrame:
    """Rows (bucket, doc) for keys that two documents offer at least. Keys with the same few members have one bucket.

    offered: rows (key, doc). Hot keys are found on a sample of the documents, and their rows stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        keys, docs, hot = none, none, None

        def ended(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Buckets and members of whole groups."""
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs = keys[new], docs[new]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else none
            size = np.diff(np.r_[first, len(keys)])
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(docs.view(U) + ODD[6]))])
            name = mix(sums[first + size] - sums[first] + size.astype(U) * ODD[7]).view(np.int64)
            name = np.where(size > LISTED, keys[first] if len(keys) else none, name)
            many = np.repeat(size > 1, size)
            return np.repeat(name, size)[many], docs[many]

        def table(bucket: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(docs)], names=["bucket", "doc"])

        for b in batches:
            k, d = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if hot is not None:  # more members of a group that was passed on already
                same = int(np.searchsorted(k != hot, True))
                yield table(k[:same], d[:same])
                k, d = k[same:], d[same:]
            if not len(k):
                continue
            hot = None
            keys, docs = np.concatenate([keys, k]), np.concatenate([docs, d])
            last = int(np.searchsorted(keys == keys[-1], True))
            yield table(*ended(keys[:last], docs[:last]))
            keys, docs = keys[last:], docs[last:]
            if len(np.unique(docs)) > LISTED:
                yield table(keys, docs)
                keys, docs, hot = none, none, keys[-1]
        yield table(*ended(keys, docs))

    few = offered.where(F.pmod(F.xxhash64("doc"), F.lit(HOT_OF)) == 0).groupBy("key").count().where(F.col("count") >= HOT_SEEN)
    hot_keys = durable(few.select("key", F.lit(True).alias("hot")), "hot")
    marked = offered.join(hot_keys, "key", "left") if not hot_keys.isEmpty() else offered.withColumn("hot", F.lit(None).cast("boolean"))
    rest = marked.where("hot is null").select("key", "doc").repartition("key").sortWithinPartitions("key", "doc")
    named = rest.mapInArrow(run, "bucket long, doc long")
    return named.unionByName(marked.where("hot").select(F.col("key").alias("bucket"), "doc")).distinct()


class Tree:
    """R-tree over the points of a task, packed by sorting; finds the pairs of one token whose bound reaches the threshold.

    token: dense numbers, ascending; vec: counts by group; n: set sizes; tile, across: where across holds, only pairs of
    different tiles count. visited and pruned count the pairs of nodes that the traversal came to and dropped.
    """

    def __init__(self, token: np.ndarray, n: np.ndarray, vec: np.ndarray, tile: np.ndarray, across: np.ndarray, limit: Threshold):
        self.vec, self.n, self.tile, self.across, self.limit = vec, n, tile, across, limit
        self.visited = self.pruned = 0
        coarse = vec.reshape(len(vec), GROUPS // COARSE, COARSE).sum(1, dtype=np.int64)
        self.order = np.lexsort((n, tile, token))
        first = np.flatnonzero(np.r_[True, np.diff(token[self.order]) > 0, True])
        for s, e in zip(first[:-1], first[1:], strict=True):
            if e - s > FAN:  # large ones are cut by size, then by the counts that vary most
                rows = self.order[s:e]
                self.order[s:e] = self.cut(rows, coarse, np.argsort(-coarse[rows].var(0), kind="stable"), 0)
        o = self.order
        self.levels = [(token[o], token[o], n[o], n[o], coarse[o])]
        while len(self.levels[-1][0]) > 1:
            low = self.levels[-1]
            at = np.arange(0, len(low[0]), FAN)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.maximum), low, strict=True)))

    def cut(self, rows: np.ndarray, coarse: np.ndarray, axes: np.ndarray, depth: int) -> np.ndarray:
        """The rows in an order in which neighbours are alike."""
        if len(rows) <= FAN:
            return rows
        by = self.n[rows] if depth == 0 else coarse[rows, axes[(depth - 1) % COARSE]]
        rows = rows[np.argsort(by, kind="stable")]
        half = -(-len(rows) // 2 // FAN) * FAN
        return np.concatenate([self.cut(rows[:half], coarse, axes, depth + 1), self.cut(rows[half:], coarse, axes, depth + 1)])

    def may(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes can hold a pair that reaches the threshold."""
        lo, hi, least, most, top = self.levels[level]
        limit = self.limit
        ok = (lo[a] <= hi[b]) & (lo[b] <= hi[a]) & (most[a] * limit.q >= limit.p * least[b]) & (most[b] * limit.q >= limit.p * least[a])
        at = np.flatnonzero(ok)
        for s in range(0, len(at), 1 << 15):
            x = at[s : s + (1 << 15)]
            ok[x] = limit.enough(np.minimum(top[a[x]], top[b[x]]).sum(1), least[a[x]] + least[b[x]])
        self.visited += len(ok)
        self.pruned += len(ok) - int(ok.sum())
        return ok

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound on the similarity), i != j, each pair once, as positions in the arrays given."""
        found = [[], [], []]
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        fan = np.arange(FAN)
        while todo:
            level, a, b = todo.pop()
            if len(a) > 4096:
                todo += [(level, a[s : s + 4096], b[s : s + 4096]) for s in range(0, len(a), 4096)]
                continue
            if level:
                x = (a[:, None, None] * FAN + fan[None, :, None] + 0 * fan[None, None, :]).ravel()
                y = (b[:, None, None] * FAN + 0 * fan[None, :, None] + fan[None, None, :]).ravel()
                ok = (x <= y) & (y < len(self.levels[level - 1][0]))
                ok &= (x < y) if level == 1 else True
                x, y = x[ok], y[ok]
                ok = self.may(level - 1, x, y)
                if ok.any():
                    todo.append((level - 1, x[ok], y[ok]))
                continue
            i, j = self.order[a], self.order[b]
            ok = (i != j) & (~self.across[i] | (self.tile[i] != self.tile[j]))
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 1 << 14):
                r, c = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
                over = np.minimum(self.vec[r], self.vec[c]).sum(1, dtype=np.int64)
                total = self.n[r] + self.n[c]
                ok = self.limit.enough(over, total)
                for got, part in zip(found, (r, c, over / np.maximum(total - over, 1)), strict=True):
                    got.append(part[ok])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


class Joined:
    """Union-find over numbers."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of batches that are sorted by keys, many at a time, with each row's group number."""

    def out(t: pa.Table, cols: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        return t, np.cumsum(np.r_[0, (cols[:, 1:] != cols[:, :-1]).any(0)])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if b.num_rows else []
        if sum(x.num_rows for x in held) < least:
            continue
        t = pa.Table.from_batches(held)
        cols = np.stack([t[k].to_numpy() for k in keys])
        whole = int((cols != cols[:, -1:]).any(0).sum())  # the last group may go on
        if whole:
            yield out(t.slice(0, whole), cols[:, :whole])
        held = t.slice(whole).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield out(t, np.stack([t[k].to_numpy() for k in keys]))


def candidates(members: DataFrame, found: DataFrame, p: int, q: int, each: int = 0) -> DataFrame:
    """Pairs (a, b), a < b, from the trees over members (bucket, doc[, comp]): a spanning forest of the surviving pairs.

    each: instead, that many pairs of a document with other comps; rows (null, bucket) tell of tokens that have more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = Threshold(p, q)
        for t, token in stretches(batches, ["bucket", "ti", "tj"]):
            n, doc, tile, bucket = (t[c].to_numpy() for c in ("n", "doc", "tile", "bucket"))
            raw = t["vec"].to_pylist()
            wide = max(map(len, raw)) > 2 * GROUPS
            vec = np.array([np.frombuffer(x, "<u2" if len(x) == 2 * GROUPS else "<u4") for x in raw], dtype=np.int32 if wide else np.uint16)
            i, j, strength = Tree(token, n, vec, tile, t["ti"].to_numpy() != t["tj"].to_numpy(), limit).pairs()
            order = np.lexsort((doc[j], doc[i], -strength))
            more: set[int] = set()
            if each:
                comp = t["comp"].to_numpy()
                order = order[comp[i[order]] != comp[j[order]]]
                given, keep = Counter(), []
                for at, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
                    if given[x] < each or given[y] < each:
                        given[x] += 1
                        given[y] += 1
                        keep.append(at)
                    else:
                        more.add(int(bucket[x]))
            else:
                joined = Joined(len(n))
                keep = [at for at, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True) if joined.join(x, y)]
            keep = np.array(keep, dtype=np.int64)
            x, y = doc[i[keep]], doc[j[keep]]
            rest = sorted(more)
            first, second = [*np.minimum(x, y).tolist(), *[None] * len(rest)], [*np.maximum(x, y).tolist(), *rest]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    # Only tokens with many members are cut into tiles: a short list, which the planner may broadcast by its size.
    large = durable(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > TILE), "large")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    cells = members.withColumns({"tile": F.lit(0), "ti": F.lit(0), "tj": F.lit(0)})
    if not large.isEmpty():
        cut = members.join(large, "bucket").withColumn("tile", F.pmod(F.xxhash64("doc"), tiles).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        cut = cut.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")}).select(*cells.columns)
        cells = cells.join(large.select("bucket"), "bucket", "left_anti").unionByName(cut)
    # Most documents share no token: a bitmap keeps their points where they are.
    points, near = marked_by(found.select(F.col("doc_id").alias("doc"), "n", "vec"), "doc", members.select("doc"), 24)
    cells = cells.join(points.where(near).drop(near), "doc")
    placed = cells.repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj", "doc")
    return placed.mapInArrow(run, "a long, b long").distinct()


def set_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Rows (id, set) for the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(k)
        for b in batches:
            sets = [make(t).view(np.int64) for t in each_text(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    few = with_ids(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), "id", ids)
    return few.mapInArrow(run, "id long, set array<long>")


def sets_of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that pairs (a, b) need, and few others."""
    kept, flag = marked_by(sets, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")), 24)
    return kept.where(flag).drop(flag)


def verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - overlap
    return both.where(F.lit(q).cast("long") * overlap >= F.lit(p).cast("long") * union).select("a", "b").distinct()


def join(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): documents linked at Jaccard similarity p / q or more on k-word shingles.

    Texts are read once for all features, and those of candidates once more for their sets.
    """
    found = durable(features(docs, k, p, q), "features")
    sets_of = (
        found.where("fp is not null and doc_id is not null").groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep < top").select("fp", "rep")
    )
    copies = durable(sets_of, "copies")
    named = found.select("doc_id", "n", "fp").join(copies, "fp", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    named = durable(named, "named")
    extra = named.where("doc_id != rep").select(F.col("doc_id").alias("doc"))
    offered = without_ids(found.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "keys"), "doc", extra)
    members = durable(shared(offered.select(F.explode("keys").alias("key"), "doc")), "members")
    first = durable(candidates(members, found, p, q), "pairs")
    ids = first.select(F.col("a").alias("id")).union(first.select(F.col("b").alias("id"))).distinct()
    if first.isEmpty():
        return named.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    sets = durable(set_table(docs, ids, k), "sets")
    links = durable(verified(first, sets, p, q), "links")
    roots = durable(components(links), "roots")
    # Tokens that still hold several components: only documents that a pair of survivors holds matter.
    left = durable(members.join(ids.withColumnRenamed("id", "doc"), "doc", "left_semi"), "left")
    each = 2
    while True:
        held = left.join(roots.withColumnRenamed("v", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("root", "doc").alias("comp"))
        torn = held.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
        held = durable(held.join(torn, "bucket", "left_semi"), "torn")
        if held.isEmpty():
            break
        given = durable(candidates(held, found, p, q, each), "given")
        new = durable(given.where("a is not null").join(first, ["a", "b"], "left_anti"), "new")
        if not new.isEmpty():
            first = first.unionByName(new)
            more = durable(verified(new, sets_of_pairs(sets, new), p, q), "more")
            if not more.isEmpty():
                links = links.unionByName(more)
                roots = durable(components(links), "roots")
        rest = given.where("a is null").select(F.col("b").alias("bucket")).distinct()
        left, each = durable(held.join(rest, "bucket", "left_semi").select("bucket", "doc"), "left"), each * 8
    roots = roots.select(F.col("v").alias("rep"), "root")
    return named.join(roots, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id.

    Rows that repeat a doc_id are documents of their own here: those with other texts than the rest stay, unless they are
    near copies of something. Rows with a null doc_id stay.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        classes = durable(join(docs, k, p, q), "classes")
        return without_ids(docs, "doc_id", classes.where("doc_id != component_id").select("doc_id"))
    row, id_ = free_name(docs.columns, "_row"), free_name(docs.columns, "_id")
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # numbers hold once they are written
    keys = F.when(F.col("doc_id").isNotNull(), F.col(row)).alias("doc_id")
    classes = join(rows.select(keys, "text"), k, p, q).where("doc_id is not null").select(F.col("doc_id").alias(row), "component_id")
    classes = durable(rows.select(row, F.col("doc_id").alias(id_)).join(classes, row), "classes")
    first = classes.groupBy("component_id").agg(F.min_by(row, F.struct(id_, row)).alias("first"))
    gone = classes.join(first, "component_id").where(F.col(row) != F.col("first")).select(row)
    return without_ids(rows, row, gone).drop(row)
