"""Words grouped with the spelling that they probably stand for.

A text's words are its runs of letters, A-Z lower-cased, after a planted slip: where a checksum of document and run is a
multiple of SLIP, one code point is left out. Words long and frequent enough form the vocabulary. Two words are near if
they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word with the most
occurrences, if those are at least `times` its own; its root is where forms lead in the end.

Near words are found by a rare-first prefix filter. Bigrams are ordered by how many there are in the vocabulary (at most
a bigram for each pair of letters, so their counts are a table of fixed size), then by themselves, then by position. One
edit spoils at most two bigrams of a word and keeps the others in order, so the first bigram that both words keep is among
the three rarest of each. Where they share it, positions are equal, or one more in the longer word if the edit is before
it. And as there is one edit, everything on the other side of the bigram is the same, and of the edited side one half: a
key is the bigram's place with both of these. So only words that already agree in most of their letters meet, in an
equi-join on hashes of keys; edit distances verify the pairs.

Defined cases: null and empty texts have no words; a null doc_id is written as an empty string; rows that repeat are
counted each; an empty table gives no rows; runs may be as long as a text; ties go to the word that is smallest in code
point order; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER_ASCII, durable, each_text

SLIP = 31
#: A task's own counts leave it when there are so many different words.
HELD = 200_000
RAREST = 3


def slipped(doc: str, run: str) -> str:
    h = crc32(f"{doc}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_chars: int = 7, least_n: int = 2) -> DataFrame:
    """Rows (word, n)."""
    # Shorter runs have no word that is long enough.
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), each_text(b.column(1)), strict=True):
                doc = doc or ""
                for run, n in Counter(runs.findall(text)).items():
                    word = slipped(doc, run.lower() if run.isascii() else run.translate(UPPER_ASCII))
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    # Tasks have counted already, and the words' keys are work for more tasks than their bytes would make.
    spread = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return spread.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How often each bigram is in the vocabulary: at most 90 * 90 of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for w in each_text(b.column(0)):
                held.update(map("".join, zip(w, w[1:], strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    return {r["gram"]: r["n"] for r in words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def keys_at(w: str, p: int, size: int, edit: str) -> list[tuple]:
    """The keys of a word whose bigram is at p in the shorter of two words, which has that size; edit: on which side it is.

    In the longer word everything behind the edit is one further.
    """
    more = len(w) - size
    if edit == "after":
        if p + 2 > size:
            return []
        m = p + 2 + (size - p - 2) // 2
        return [(1, size, w[:m], ""), (2, size, w[: p + 2], w[m + more :])]
    if p < 0:
        return []
    m = p // 2
    return [(3, size, w[m + more :], ""), (4, size, w[:m], w[p + more :])]


def keys_of(w: str, counts: dict[str, int]) -> tuple[set[tuple], set[tuple]]:
    """A word's keys among words of its own length or as the shorter of two, and those as the longer one."""
    grams = sorted((counts[w[i : i + 2]], w[i : i + 2], i) for i in range(len(w) - 1))[:RAREST]
    own, longer = set(), set()
    for _, _, p in grams:
        own.update(keys_at(w, p, len(w), "after"), keys_at(w, p, len(w), "before"))
        longer.update(keys_at(w, p, len(w) - 1, "after"), keys_at(w, p - 1, len(w) - 1, "before"))
    return own, longer


def near_pairs(words: DataFrame) -> DataFrame:
    """Distinct pairs (a, a_n, b, b_n) of near words of a table (word, n), each once."""
    counts = bigram_counts(words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = lambda k: xxhash.xxh64_intdigest("\0".join(map(str, k))) - (1 << 63)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                rows: tuple[list, ...] = ([], [], [], [])
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for longer, keys in enumerate(keys_of(w, counts)):
                        new = [mark(k) for k in keys]
                        for column, values in zip(rows, (new, [bool(longer)] * len(new), [w] * len(new), [n] * len(new)), strict=True):
                            column.extend(values)
                types = (pa.int64(), pa.bool_(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["key", "longer", "word", "n"])

    keyed = durable(words.mapInArrow(emit, "key long, longer boolean, word string, n long"), "spelling-keys")
    one = keyed.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    two = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = one.join(two, "key").where(F.col("longer") | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """Rows (word, root) of rows (word, form); most is the largest count of a word.

    Each step has at least ten times the occurrences, so chains are short, and following them twice as far each round
    takes a few rounds that the largest count bounds.
    """
    steps = max(1, math.ceil(math.log10(max(most, 10))))
    for _ in range(math.ceil(math.log2(steps))):
        then = forms.select(F.col("word").alias("form"), F.col("form").alias("next"))
        forms = durable(forms.join(then, "form", "left").select("word", F.coalesce("next", "form").alias("form")), "spelling-roots")
    return forms.select("word", F.col("form").alias("root"))


def group(docs: DataFrame, least_chars: int = 7, least_n: int = 2, times: int = 10) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of the vocabulary."""
    words = durable(vocabulary(docs, least_chars, least_n), "vocabulary")
    pairs = near_pairs(words)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("form"), F.col(f"{y}_n").alias("form_n"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"), F.first("n").alias("own"))
    strong = -F.col("best.less") >= times * F.col("own")
    near = durable(best.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "near-words")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(near.where(F.col("form").isNotNull()).select("word", "form"), most)
    found = words.join(near, "word", "left").join(ends, "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
