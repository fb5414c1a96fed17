"""Toxicity by weak supervision.

Voters look at a text: given word lists, lists induced from labelled rows (a list for each family of words of one stem),
and patterns. A list votes for one, for two and for four different words of its. Voters that never vote on the fitted rows,
or always together with another, are left out. A generative label model estimates, over labelled and unlabelled rows at
once (EM), how often each voter votes on toxic and on clean texts, its correlations with the others in each class, and how
reliable the annotators' mark is; rows without a mark weigh 0.3 of one with, so that they refine what marks anchor. A vote
depends on the class and on one other voter: the pairs with most in common given the class make a tree (maximum spanning
tree of conditional mutual information). Directions are anchored too: whatever its neighbour in the tree says, a vote is
never likelier on clean texts. The posterior labels, which the marks take part in as one voter of estimated reliability,
train the classifier: logistic on tokens and votes. It scores every text.

Labels induce the lists and are the mark. Fitting takes `max_fit` labelled documents at most and as many unlabelled ones
(those of smallest hash); lists and classifier know the tokens that tell the classes apart with a likelihood gain of GAIN,
`n_tokens` at most, so what reaches the driver is bounded. Scoring reads whole texts.

Defined cases: null text is empty and scored like one; long texts are scored whole; of rows that share a doc_id the smallest
text is fitted on, and rows with a null id aren't; repeated rows are scored alike; without labelled rows of both classes, or
tokens that tell them apart, the given word lists alone decide; an empty table gives no scores; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, one_text_each, sample, texts

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7, 8)
#: Insults by language.
INSULTS = {
    "en": "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile bastard dumb filth vermin",
    "de": "idiot dumm dummkopf abschaum trottel versager arschloch schwein widerlich wertlos drecksack",
    "fr": "idiot imbécile connard salaud ordure crétin abruti pathétique dégoûtant minable raclure",
    "es": "idiota imbécil estúpido basura escoria payaso patético asqueroso inútil cabrón perdedor",
}
#: Patterns whose hits vote for toxic.
PATTERNS = {
    "second_person": r"(?i)\b(?:you|ur|u)\s+(?:are\s+)?(?:such\s+)?(?:an?\s+)?(?:" + "|".join(INSULTS["en"].split()) + r")\b",
    "masked": r"\b\w[*@#]{2,}\w*\b",
    "shouted": r"(?:\b[^\W\d_a-zß-öø-ÿ]{3,}\b[ ,]*){3}!",
    "hate": r"(?i)\b(?:shut\s+up|go\s+to\s+hell|hate\s+you|kill\s+yourself)\b",
}
#: A list votes for so many different words of its.
LEVELS = (1, 2, 4)
#: Natural log of how much likelier a token makes the labels, at least: among millions of tokens, hardly one has it by chance.
GAIN = 14.0


@dataclass
class Model:
    """Weights by token (words, and stems written with a leading ^), of the voters in `live`, and the bias."""

    tokens: dict[str, int]
    weights: np.ndarray
    bias: float
    voters: list[tuple[list[int], list[int]]] = field(default_factory=list)
    live: list[int] = field(default_factory=list)
    label_model: LabelModel | None = field(default=None, repr=False, compare=False)


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def parts(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


class Seen:
    """How many different words of a text are of each token; remembers 50,000 words' tokens."""

    def __init__(self, tokens: dict[str, int]):
        self.tokens, self.cache = tokens, {}

    def __call__(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        cache, tokens = self.cache, self.tokens
        for w in set(LETTERS.findall(text.lower())):
            at = cache.get(w)
            if at is None:
                if len(cache) > 50_000:
                    cache.clear()
                at = cache[w] = tuple(tokens[p] for p in parts(w) if p in tokens)
            for i in at:
                out[i] = out.get(i, 0) + 1
        return out


def pattern_votes(text: str) -> list[int]:
    return [int(re.search(p, text) is not None) for p in PATTERNS.values()]


def labelled(docs: DataFrame, labels: DataFrame, teach: Column, most: int) -> DataFrame:
    """Rows (id, text, y)."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(teach)
    few = sample(marked.select(F.col("doc_id").alias("id")), most)
    marks = marked.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    return one_text_each(docs, marks.join(F.broadcast(few), "id"))


def unlabelled(docs: DataFrame, labels: DataFrame, teach: Column, most: int) -> DataFrame:
    """Rows (id, text, y), y null. They come from a sample four times as large, in case that most have a label."""
    ids = docs.where(F.col("doc_id").isNotNull()).where(teach).select(F.col("doc_id").alias("id"))
    few = sample(ids, 4 * most).join(labels.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return one_text_each(docs, few.orderBy(F.xxhash64("id"), "id").limit(most)).withColumn("y", F.lit(None).cast("int"))


def mine(rows: DataFrame, n_tokens: int, least: int) -> list[tuple[str, float]]:
    """The n_tokens tokens that tell the classes apart best (by log-likelihood ratio), with their log odds; equal texts count once."""
    rows = rows.groupBy("text").agg(F.max("y").alias("y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), texts(b), strict=True):
                of[y].update({p for w in set(LETTERS.findall(t.lower())) for p in parts(w)})
            names = list(of[0].keys() | of[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([of[1][x] for x in names], pa.int64()), pa.array([of[0][x] for x in names], pa.int64())],
                names=["token", "a", "b"],
            )

    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    na, nb = total.get(1, 0), total.get(0, 0)
    if not na or not nb:
        return []
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (na + 1.0)) - F.log(b / (nb + 1.0))
    n, share = F.col("a") + F.col("b") + 1.0, na / (na + nb)
    gain = a * F.log(a / (n * share)) + b * F.log(b / (n * (1 - share)))
    top = (
        rows.select("y", "text").mapInArrow(count, "token string, a long, b long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where(F.col("a") + F.col("b") >= least)
        .select("token", odds.alias("odds"), gain.alias("gain")).where(F.col("gain") >= GAIN)
        .orderBy(F.desc("gain"), "token").limit(n_tokens).collect()
    )
    return [(r["token"], r["odds"]) for r in top]


def build_voters(mined: list[tuple[str, float]], tokens: dict[str, int]) -> list[tuple[list[int], list[int]]]:
    """(stems, words) by number: the given lists, then one for each family of induced toxic tokens."""
    families: dict[str, list[str]] = {}
    for t, odds in mined:
        if odds > 1.0:
            families.setdefault(t.lstrip("^")[: STEMS[0]], []).append(t)
    lists = [words.split() for words in INSULTS.values()] + list(families.values())
    return [([tokens[t] for t in x if t[0] == "^"], [tokens[t] for t in x if t[0] != "^"]) for x in lists]


def votes_of(counts: dict[int, int], text: str, voters: list[tuple[list[int], list[int]]]) -> list[int]:
    """For each list whether it has so many words as a level asks for, then the patterns."""
    hits = [0] * len(voters)
    if counts:
        for k, (stems, words) in enumerate(voters):
            hits[k] = max([sum(i in counts for i in words), *(counts.get(i, 0) for i in stems)])
    return [int(h >= n) for h in hits for n in LEVELS] + pattern_votes(text)


class LabelModel:
    """Voters that depend on the class and, in a tree, on one another; fitted to votes (0 or 1) and marks (1, 0, or -1) by EM.

    share: of toxic texts; rate: by class and voter, how often it votes; parent: by voter its neighbour towards the root,
    -1 at a root; given: by class and neighbour's vote, how often it votes; mark: how often a clean and a toxic text is
    marked; accuracy: by voter, of the texts it votes for how many are toxic; alone, post: by row the probability of toxic
    by the voters, and with the mark.
    """

    def __init__(self, votes: np.ndarray, marks: np.ndarray, rounds: int = 60, weight: float = 4.0, least: float = 3.0, unmarked: float = 0.3):
        # Rows with the same votes and mark are one case, which counts so many times: few cases are held as floats.
        cases, case, times = np.unique(np.c_[votes.astype(np.int8), marks.astype(np.int8)], axis=0, return_inverse=True, return_counts=True)
        v, marks = cases[:, :-1].astype(np.float32), cases[:, -1].astype(np.int64)
        has = marks >= 0
        self.post = np.choose(marks + 1, [0.02 + 0.28 * v.any(1), 0.02, 0.9])
        for k in range(rounds):
            by_class = np.stack([1 - self.post, self.post]) * np.where(has, 1.0, unmarked) * times
            if k in (0, 5):  # then it stays, so that EM converges
                self.parent = self.tree(v, by_class, least)
                neighbour = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], np.float32(0))
                both = v * neighbour
            size = by_class.sum(1)
            self.share = float((size[1] + 1) / (size.sum() + 2))
            said = [by_class @ m for m in (v, neighbour, both)]
            self.rate = (said[0] + 0.5) / (size[:, None] + 1)
            self.rate[1] = np.maximum(*self.rate)
            # How often a voter votes while its neighbour doesn't, and does; a rare case falls back on the voter's rate.
            hits, of = (said[0] - said[2], said[2]), (size[:, None] - said[1], said[1])
            self.given = np.stack([(h + weight * self.rate) / (n + weight) for h, n in zip(hits, of, strict=True)], axis=1)
            self.given[:, 1][:, self.parent < 0] = self.given[:, 0][:, self.parent < 0]
            self.given[1] = np.maximum(*self.given)
            self.given = self.given.clip(1e-6, 1 - 1e-6)
            self.mark = [float((w[has] @ (marks[has] == 1) + 1) / (w[has].sum() + 2)) for w in by_class]
            # Log-likelihood ratios, in terms of votes, neighbours' votes and both.
            yes, no = np.log(self.given[1]) - np.log(self.given[0]), np.log1p(-self.given[1]) - np.log1p(-self.given[0])
            z = np.log(self.share / (1 - self.share)) + no[0].sum() + v @ (yes[0] - no[0]) + neighbour @ (no[1] - no[0]) + both @ (yes[1] - no[1] - yes[0] + no[0])
            b, a = self.mark
            self.alone = 1 / (1 + np.exp(-z.clip(-40, 40)))
            self.post = 1 / (1 + np.exp(-(z + np.choose(marks + 1, [0.0, np.log((1 - a) / (1 - b)), np.log(a / b)])).clip(-40, 40)))
        self.accuracy = (times * self.post) @ v / np.maximum(times @ v, 1e-9)
        self.correlation = np.array([self.correlated(v, times * w) for w in (1 - self.post, self.post)])
        self.alone, self.post = self.alone[case.ravel()], self.post[case.ravel()]

    @staticmethod
    def correlated(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Pairwise, within the class that w weighs the rows for."""
        mean = w @ v / w.sum()
        cov = (v * w[:, None].astype(np.float32)).T @ v / w.sum() - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
        return cov / np.outer(sd, sd)

    @staticmethod
    def tree(v: np.ndarray, by_class: np.ndarray, least: float) -> np.ndarray:
        """Parents in the maximum spanning tree of the voters' mutual information given the class (edges below least: none)."""
        n = v.shape[1]
        shared = np.zeros((n, n))
        for w in by_class:
            size = w.sum()
            one, both = (w @ v + 0.5) / (size + 1), ((v * w[:, None].astype(np.float32)).T @ v + 0.25) / (size + 1)
            for p, q, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one - both), (1 - one, 1 - one, 1 - one[:, None] - one + both)):
                joint = joint.clip(1e-9)
                shared += size * joint * np.log(joint / np.outer(p, q))
        parent, inside, best = np.full(n, -1), np.zeros(n, dtype=bool), np.full(n, -1e18)
        for _ in range(n):
            j = int(np.argmax(np.where(inside, -np.inf, best)))
            inside[j] = True
            if best[j] < least:
                parent[j] = -1
            nearer = ~inside & (shared[j] > best)
            best[nearer], parent[nearer] = shared[j][nearer], j
        return parent


class Features:
    """The rows that the classifier is fitted on: by row the tokens seen with a value each, and the votes; dense a block at a time."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, values: np.ndarray, n_tokens: int, votes: np.ndarray):
        self.start, self.tokens, self.values, self.n_tokens, self.votes = np.r_[0, np.cumsum(sizes)], tokens, values, n_tokens, votes
        self.shape = (len(sizes), n_tokens + votes.shape[1])

    def __getitem__(self, rows: slice) -> np.ndarray:
        first, last, _ = rows.indices(len(self.start) - 1)
        start = self.start[first : last + 1]
        out = np.zeros((last - first, self.shape[1]), dtype=np.float32)
        out[np.repeat(np.arange(last - first), np.diff(start)), self.tokens[start[0] : start[-1]]] = self.values[start[0] : start[-1]]
        out[:, self.n_tokens :] = self.votes[first:last]
        return out


def logistic(x: np.ndarray | Features, y: np.ndarray, ridge: float = 1.0, rounds: int = 25, block: int = 500) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on soft labels by Newton steps; the bias is free. Sums go block by block."""
    n, p = x.shape
    w, pen = np.zeros(p + 1), np.r_[np.full(p, ridge), 1e-6]
    for _ in range(rounds):
        gram, slope = np.diag(pen), -pen * w
        for at in range(0, n, block):
            own = x[at : at + block]
            a = np.ones((len(own), p + 1))
            a[:, :p] = own
            q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope += a.T @ (y[at : at + block] - q)
            a *= np.sqrt(np.maximum(q * (1 - q), 1e-6))[:, None]
            gram += a.T @ a
        step = np.linalg.solve(gram, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, teach: Column, max_fit: int = 10_000, n_tokens: int = 400, least: int = 4) -> Model:
    """A model from the rows for which `teach` holds (a condition on doc_id)."""
    marked = labelled(docs, labels, teach, max_fit)
    mined = mine(marked, n_tokens, least)
    names = dict.fromkeys([*(w for ws in INSULTS.values() for w in ws.split()), *(t for t, _ in mined)])
    tokens = {t: i for i, t in enumerate(names)}
    voters = build_voters(mined, tokens)
    if not mined:
        live = [k * len(LEVELS) for k in range(len(INSULTS))]
        return Model(tokens, np.r_[np.zeros(len(tokens)), np.full(len(live), 4.0)], -3.0, voters, live)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(tokens)
        for b in batches:
            got = [(seen(t), t) for t in texts(b)]
            lists = ([list(s) for s, _ in got], [[min(n, 32_767) for n in s.values()] for s, _ in got], [[k for k, v in enumerate(votes_of(s, t, voters)) if v] for s, t in got])
            kinds = (pa.int16(), pa.int16(), pa.int16())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], names=["id", "y", "tokens", "times", "votes"])

    rows = marked.select("id", "y", "text").unionByName(unlabelled(docs, labels, teach, max_fit).select("id", "y", "text"))
    rows = rows.withColumn("id", F.col("id").cast("string"))
    data = rows.mapInArrow(look, "id string, y int, tokens array<smallint>, times array<smallint>, votes array<smallint>").toArrow()
    data = data.sort_by("id")  # results don't hang on the order in which tasks end
    marks = data["y"].fill_null(-1).to_numpy().astype(np.int64)
    whole = lambda c: data[c].combine_chunks()
    votes = np.zeros((len(data), len(voters) * len(LEVELS) + len(PATTERNS)), dtype=np.int8)
    votes[np.repeat(np.arange(len(data)), whole("votes").value_lengths().to_numpy()), whole("votes").flatten().to_numpy()] = 1
    different = np.unique(votes, axis=0)
    _, first = np.unique(different, axis=1, return_index=True)
    live = sorted(int(k) for k in first if different[:, k].any())
    votes = votes[:, live]
    seen = np.log2(whole("times").flatten().to_numpy().astype(np.float32) + 1)
    x = Features(whole("tokens").value_lengths().to_numpy(), whole("tokens").flatten().to_numpy(), seen, len(tokens), votes)
    del data
    model = LabelModel(votes, marks)
    weights, bias = logistic(x, model.post)
    return Model(tokens, weights, bias, voters, live, model)


def score_text(text: str, model: Model, seen: Seen) -> float:
    counts = seen(text)
    z = model.bias + sum(model.weights[i] * np.log2(n + 1) for i, n in counts.items())
    votes = votes_of(counts, text, model.voters)
    z += float(np.dot(model.weights[len(model.tokens) :], [votes[k] for k in model.live]))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def scored(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1. Only texts go to Python, and only scores come back."""
    tokens, weights, bias, voters, live = model.tokens, model.weights, model.bias, model.voters, model.live

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(tokens, weights, bias, voters, live)
        seen = Seen(tokens)
        for b in batches:
            yield pa.array((score_text(t, own, seen) for t in each_text(b)), pa.float64(), size=len(b))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text.cast("string"))


def clean_documents(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, with the columns they had."""
    return docs.where(scored(F.col("text"), model) < limit)
