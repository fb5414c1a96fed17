"""Text quality by naive Bayes support vectors.

A text is the set of its n-grams: words and word pairs, and runs of up to three word shapes (case, digits, marks, and
whether a word repeats the one before), hashed into a fixed number of features. Each indicator is scaled by the log ratio
of its smoothed counts in good and in poor texts; a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent; its margins become probabilities by a logistic fit on rows that were kept apart.

Fitting uses at most `max_fit` labelled rows (those of smallest hash), so what reaches the driver is bounded. Scoring
reads whole texts.

Defined cases: null text is empty and has no n-grams, so it gets the score of the bias; rows without a label or with a
null id don't teach; repeated rows are scored alike; with labels of one class only, every score is that class's share;
an empty table gives no scores; texts are scored whole, however long; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_text_each, sample, texts

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
BITS = 18
SIZE = 1 << BITS
U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass
class Model:
    """Weights by feature (ratio times weight), and the logistic fit a * margin + b."""

    weights: np.ndarray
    bias: float
    a: float
    b: float


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def shape(token: str) -> int:
    """A number for how a token looks."""
    if not token[0].isalnum():
        return 16 + zlib.crc32(token[:3].encode("utf-8", "surrogatepass")) % 4080
    if token.isdigit():
        return 1
    if token.isupper():
        return 2 if len(token) > 1 else 3
    if token.istitle():
        return 4
    return 5 if token.islower() else 6


class Grams:
    """The features of texts; remembers tokens, up to 50,000."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct feature numbers."""
        tokens, seen = TOKEN.findall(text), self.seen
        if not tokens:
            return np.empty(0, np.int64)
        if len(seen) > 50_000:
            seen.clear()
        for w in set(tokens).difference(seen):
            low = w.lower().encode("utf-8", "surrogatepass")
            seen[w] = (zlib.crc32(low) | zlib.crc32(low, 1) << 32, shape(w))
        h, s = np.array([seen[w] for w in tokens], dtype=U).T
        again = h[1:] == h[:-1]
        s = s.copy()
        s[1:][again] += U(1 << 13)
        pairs = np.where(again, U(7), h[:-1] * ODD[0] + h[1:] * ODD[1])
        runs = [h, pairs, s * ODD[2] + U(1), (s[:-1] * ODD[3] + s[1:]) * ODD[2] + U(2)]
        if len(s) > 2:
            runs.append(((s[:-2] * ODD[3] + s[1:-1]) * ODD[1] + s[2:]) * ODD[2] + U(3))
        return np.unique((np.concatenate(runs) * ODD[0] >> U(64 - BITS)).astype(np.int64))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; c: each row's cost. Rows have length 1, and a constant."""
    w, bias, rng = np.zeros(len(scale)), 0.0, np.random.default_rng(seed)
    value = [scale[r] for r in rows]
    value = [v / max(np.sqrt(v @ v), 1e-9) for v in value]
    square = np.array([v @ v + 1.0 for v in value])
    alpha = np.zeros(len(rows))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ value[i] + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), c[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += step * value[i]
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve through margins, on softened labels, by Newton steps."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * (w - [1, 0]))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def margins(rows: list[np.ndarray], scale: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[r].sum() / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) + bias for r in rows])


def fit(docs: DataFrame, labels: DataFrame, teach: Column, max_fit: int = 12_000, cost: float = 1.0) -> tuple[Model, np.ndarray]:
    """(a model from the labelled rows for which `teach` holds, the scale of the features)."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(teach)
    few = sample(marked.select(F.col("doc_id").alias("id")), max_fit)
    marks = marked.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Grams()
        for b in batches:
            found = [make(t).astype(np.int32) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "grams"])

    rows = one_text_each(docs, marks.join(F.broadcast(few), "id")).select(F.col("id").cast("long").alias("id"), "y", "text")
    data = rows.mapInArrow(run, "id long, y int, grams array<int>").toArrow()
    order = np.argsort(data["id"].to_numpy(), kind="stable") if len(data) else np.empty(0, int)
    y = data["y"].to_numpy()[order] if len(data) else np.empty(0, int)
    grams = data["grams"].combine_chunks() if len(data) else None
    ends, flat = (grams.offsets.to_numpy(), grams.values.to_numpy()) if grams is not None else (np.zeros(1, int), None)
    rows_of = [flat[ends[i] : ends[i + 1]] for i in order]
    ones = np.ones(SIZE)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share)))), ones
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    counts = []
    for k in (1, 0):
        got = [rows_of[i] for i in np.flatnonzero(~apart & (y == k))]
        counts.append(np.bincount(np.concatenate(got), minlength=SIZE) + 1.0)
    # Ratios of the shares of texts that hold a feature; features of few texts stay near 0.
    n1, n0 = (y[~apart] == 1).sum(), (y[~apart] == 0).sum()
    ratio = np.log(counts[0] / (n1 + 2)) - np.log(counts[1] / (n0 + 2))
    ratio[counts[0] + counts[1] < 5] = 0
    at = np.flatnonzero(~apart)
    balance = np.where(y[at] == 1, len(at) / (2 * n1), len(at) / (2 * n0))
    w, bias = descend([rows_of[i] for i in at], ratio, np.where(y[at] == 1, 1, -1), cost * balance)
    weights = w * ratio
    test = np.flatnonzero(apart) if apart.any() else at
    a, b = platt(margins([rows_of[i] for i in test], ratio, weights, bias), y[test])
    return Model(weights.astype(np.float32), bias, max(a, 1e-3), b), ratio.astype(np.float32)


def score(docs: DataFrame, model: Model, scale: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Rows (row: struct of the columns to keep, score). Per row, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model, scale))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (m, s), make = sent.value, Grams()
        for b in batches:
            z = m.a * margins([make(t) for t in texts(b)], s, m.weights, m.bias) + m.b
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())], names=["row", "score"])

    packed = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col("text").alias("text"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, score double")
