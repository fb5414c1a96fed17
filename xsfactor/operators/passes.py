"""Robust models of windows in passes over rows that stay where they are: no task holds a window.

A Huber fit weighs each row by its error, round after round, and needs the median of the errors each time. In a pass each
window that isn't settled asks for one thing: its means, its deviations, the weighted sums of a round, or how many errors
lie below, in 256 cells between, and above two bounds, which close in on the median until the few errors left can be named.
A task holds a batch of rows and what its windows ask for, answers are combined by window, and the driver gets some numbers
a window. The median is exact, as the bounds are on the errors' bits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

CELLS, NAMED = 256, 1024
#: Above the bits of infinity, the largest error.
TOP = int(np.float64(np.inf).view(np.int64)) + 1
ANSWER = "id long, part int, sums array<double>, counts array<long>, above long, near array<long>"


def numbers(t: pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([t[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]) if columns else np.zeros((len(t), 0))


def ordinals(t: pa.Table) -> np.ndarray:
    return t["date"].cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)


def bits(x: float) -> int:
    """Errors are never negative, so their bits are in their order."""
    return int(np.float64(x).view(np.int64))


@dataclass
class Window:
    """A window's fit: the same steps as walk.Huber.fit() on its rows."""

    id: int
    group: object
    day: int
    xs: list[str]
    least: int
    scaled: bool
    wants: str | None = "means"
    n: int = 0
    round: int = 0
    cut: float = np.inf
    medians: list[float] = field(default_factory=list)
    line: tuple[float, np.ndarray] | None = None

    def asked(self) -> tuple:
        return self.id, self.day, self.wants, getattr(self, "mean", None), getattr(self, "level", None), self.line, self.cut, getattr(self, "bounds", None), self.n

    def told(self, model: object, sums: list[float], bounds: list[int] | None) -> None:
        s, p = np.array(sums or [], dtype=np.float64), len(self.xs)
        if self.wants == "means":
            self.n = int(s[0])
            if self.n < self.least:
                self.wants = None
                return
            self.mean, self.level, self.sd, self.before = s[1:-1] / self.n, s[-1] / self.n, np.ones(p), np.full(p, np.inf)
            self.line = (self.level, np.zeros(p))
            self.wants = "spread" if self.scaled else "fit"
        elif self.wants == "spread":
            sd = np.sqrt(s / self.n)
            self.sd, self.wants = np.where(sd > 0, sd, 1.0), "fit"
        elif self.wants == "fit":
            self.fit(model, s, p)
        elif bounds:
            self.bounds = tuple(bounds)
        else:
            self.medians.append(float(s[0]))
            self.cut, self.wants = model.width * (self.medians[-1] / 0.6745 + 1e-12), "fit"

    def fit(self, model: object, s: np.ndarray, p: int) -> None:
        w, x, y, xy = s[0], s[1 : p + 1] / self.sd, s[p + 1], s[p + 2 : 2 * p + 2] / self.sd
        xx, yy = s[2 * p + 2 : -1].reshape(p, p) / np.outer(self.sd, self.sd), s[-1]
        mx, my = x / w, y / w
        xx, xy = xx - w * np.outer(mx, mx), xy - w * mx * my
        beta = np.linalg.solve(xx + model.alpha * np.eye(p), xy)
        slopes = beta / self.sd
        self.line = (self.level + my - mx @ beta - self.mean @ slopes, slopes)
        self.round += 1
        settled = np.abs(beta - self.before).max(initial=0.0) < model.tol
        self.before, self.wants = beta, None if settled or self.round == model.rounds else "median"
        if self.wants and not self.medians:
            size = np.sqrt(max(yy - w * my * my - beta @ xy, 0.0) / self.n)
            self.bounds = bits(size / 64), bits(1.5 * size) + 1
        elif self.wants:
            last = self.medians[-1]
            near = max(8 * abs(last - self.medians[-2]), 1e-12 * last) if len(self.medians) > 1 else last / 10
            self.bounds = bits(max(last - near, 0.0)), bits(last + near) + 1


def step(lo: int, hi: int) -> int:
    """By how many bits CELLS cells fill the bounds."""
    return max(0, (hi - lo - 1).bit_length() - CELLS.bit_length() + 1)


class Tally:
    """What a task has for one window."""

    def __init__(self, asked: tuple):
        self.id, self.day, self.wants, self.mean, self.level, self.line, self.cut, self.bounds, self.n = asked
        self.sums, self.counts, self.above, self.near, self.some = 0.0, np.zeros(CELLS + 1, np.int64), TOP, [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """x has a row a factor."""
        if self.wants == "means":
            self.sums = self.sums + np.r_[len(y), x.sum(1), y.sum()]
            return
        if self.wants == "spread":
            c = x - self.mean[:, None]
            self.sums = self.sums + (c * c).sum(1)
            return
        off = np.abs(y - self.line[0] - self.line[1] @ x)
        if self.wants == "fit":
            w, v, c = np.minimum(1.0, self.cut / np.maximum(off, 1e-12)), y - self.level, x - self.mean[:, None]
            cw, vw = c * w, v * w
            self.sums = self.sums + np.r_[w.sum(), cw.sum(1), vw.sum(), cw @ v, (cw @ c.T).ravel(), vw @ v]
            return
        key, (lo, hi) = off.view(np.int64), self.bounds
        # What lies below wraps to the largest numbers.
        past_lo, past_hi = (key - lo).view(np.uint64), (key - hi).view(np.uint64)
        inside = past_lo[past_lo < np.uint64(hi - lo)].view(np.int64)
        least = int(past_hi.min())
        self.above = min(self.above, least + hi) if least < TOP else self.above
        self.counts[0] += np.count_nonzero(key < lo)
        self.counts[1:] += np.bincount(inside >> step(lo, hi), minlength=CELLS)
        self.some += len(inside)
        self.near = [*self.near, inside + lo] if self.some <= NAMED else []

    def row(self) -> tuple:
        if self.wants == "median":
            return self.id, None, self.counts, self.above, np.concatenate([np.zeros(0, np.int64), *self.near]) if self.some <= NAMED else None
        return (self.id, self.sums, None, None, None) if np.ndim(self.sums) else (self.id, None, None, None, None)


def middle(n: int, bounds: tuple[int, int], counts: np.ndarray, above: int, near: np.ndarray | None) -> tuple[float | None, list[int] | None]:
    """The median of n errors, or closer bounds; counts has those below the bounds, then those of the cells."""
    (lo, hi), rank, below, size = bounds, (n - 1) // 2, int(counts[0]), step(*bounds)
    upto = below + np.cumsum(counts[1:])
    if rank < below:
        return None, [0, lo]
    if rank >= upto[-1]:
        return (np.nan, None) if hi == TOP else (None, [hi, TOP])

    def at(k: int) -> int:
        if k >= upto[-1]:
            return above
        return int(near[k - below]) if near is not None else lo + int(np.searchsorted(upto, k, "right"))

    if near is not None or not size:
        near = None if near is None else np.sort(near)
        return float(np.mean(np.array([at(rank), at(n // 2)], dtype=np.int64).view(np.float64))), None
    cell = int(np.searchsorted(upto, rank, "right"))
    return None, [lo + (cell << size), min(hi, lo + ((cell + 1) << size))]


def answers(rows: DataFrame, by: str | None, windows: list[Window], days: int, y: str) -> dict[int, tuple]:
    """One pass: by window what it asked for."""
    groups: dict[object, tuple[list[str], list[tuple]]] = {}
    for w in windows:
        groups.setdefault(w.group, (w.xs, []))[1].append(w.asked())
    asked = {w.id: (w.wants, w.n, getattr(w, "bounds", None)) for w in windows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {g: (xs, [Tally(a) for a in each]) for g, (xs, each) in groups.items()}
        for b in batches:
            t = pa.Table.from_batches([b])
            for g, (xs, tallies) in own.items():
                mine = t if by is None else t.filter(pc.is_null(t[by]) if g is None else pc.fill_null(pc.equal(t[by], g), False))
                x, z, have = numbers(mine, xs), numbers(mine, [y])[:, 0], ordinals(mine)
                full = np.flatnonzero(np.isfinite(x).all(1) & np.isfinite(z))
                full = full[np.argsort(have[full], kind="stable")]
                x, z, have = np.ascontiguousarray(x[full].T), z[full], have[full]
                for tally in tallies:
                    s = slice(*np.searchsorted(have, [tally.day - days, tally.day]))
                    if s.stop > s.start:
                        tally.add(x[:, s], z[s])
        done = [tally.row() for _, tallies in own.values() for tally in tallies]
        part = TaskContext.get().partitionId()
        lists = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        id_, sums, counts, above, near = (pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), lists, strict=True))
        yield pa.RecordBatch.from_arrays([id_, pa.array([part] * len(done), pa.int32()), sums, counts, above, near], names=["id", "part", "sums", "counts", "above", "near"])

    def combine(t: pa.Table) -> pa.Table:
        t, id_ = t.sort_by([("part", "ascending")]), t["id"][0].as_py()
        wants, n, bounds = asked[id_]
        if wants == "median":
            near = [x for x in t["near"].to_pylist()]
            near = None if any(x is None for x in near) or sum(map(len, near)) > NAMED else np.concatenate([np.array(x, np.int64) for x in near])
            found, closer = middle(n, bounds, np.array(t["counts"].to_pylist(), np.int64).sum(0), min(t["above"].to_pylist()), near)
            sums = None if found is None else [found]
        else:
            sums, closer = [x for x in t["sums"].to_pylist() if x is not None], None
            sums = np.array(sums).sum(0).tolist() if sums else None
        return pa.table({"id": pa.array([id_], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64())), "bounds": pa.array([closer], pa.list_(pa.int64()))})

    parts = rows.mapInArrow(run, ANSWER)
    return {r["id"]: (r["sums"], r["bounds"]) for r in parts.groupBy("id").applyInArrow(combine, "id long, sums array<double>, bounds array<long>").collect()}


def fitted(rows: DataFrame, wanted: list[tuple[object, dt.date, list[str], int]], by: str | None, y: str, days: int, model: object, scaled: bool) -> list[tuple]:
    """(group, date, n, [intercept, slopes]) for each (group, date, factors, least) whose window has enough complete rows.

    A window is the calendar days before its date; windows settle one by one, and passes end with the last.
    """
    epoch = dt.date(1970, 1, 1)
    windows = [Window(k, g, (d - epoch).days, xs, max(least, 1), scaled) for k, (g, d, xs, least) in enumerate(wanted)]
    while open_ := [w for w in windows if w.wants]:
        got = answers(rows, by, open_, days, y)
        for w in open_:
            sums, bounds = got.get(w.id, (None, None))
            if w.wants == "means" and sums is None:
                w.wants = None  # no rows
            else:
                w.told(model, sums, bounds)
    return [(w.group, wanted[w.id][1], w.n, [float(w.line[0]), *map(float, w.line[1])]) for w in windows if w.line is not None]
