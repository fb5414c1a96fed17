"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type encoder joins, again and again, the neighbours whose union has the best score. Its result is the one
sequence of pieces that covers the text and in which every two neighbours are compatible: merged anew from characters,
the two together come out as these two. So the encoder walks the text by the longest piece that begins at a position (an
Aho-Corasick automaton of the pieces finds it), checks each new piece against the one before it, and where no piece is
compatible steps back and tries the next shorter one. A bit field marks positions from which the walk has failed, so no
position is tried twice. Two pieces are checked by their own merges, which are known: they are compatible unless their
neighbouring ends would join before the next merge of either.

Text is first cut where no piece of the vocabulary spans (between two characters that never stand together in a piece),
and the ids of the parts are remembered, up to a fixed number of parts. A chunk of the text (a run of blanks and what
follows up to the next) is remembered with its ids as text and with what they decode to, so that a text's ids and its
decoded form are each one join over its chunks.

Defined cases: null text is empty and has the end id alone; characters without a piece become bytes; repeated rows get
equal results; texts of any length are encoded whole; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

SPACE = "▁"
REMEMBERED = 250_000
NEVER = float("inf")


class Remembered(dict):
    """Results of f by argument. When it holds REMEMBERED it starts anew, and takes over what is asked for again of the last ones."""

    def __init__(self, f: Callable[[str], tuple]):
        self.f, self.last = f, {}

    def __missing__(self, key: str) -> tuple:
        out = self.last.get(key)
        if out is None:
            out = self.f(key)
            if len(key) > 64:
                return out
        if len(self) >= REMEMBERED:
            self.last = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """A merge-type model, read through the sentencepiece library's vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in every]
        self.end = model.eos_id()
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: Merge order: a smaller rank goes first; equal scores go by position, as all of one score are of one rank.
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -model.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        if model.normalize(" a  b ") != SPACE * 2 + "a" + SPACE * 2 + "b" + SPACE:
            raise ValueError("only models that keep blanks and add one in front are read")
        self.automaton = ahocorasick.Automaton()
        self.merges: dict[str, tuple[list[float], list[str], list[str]]] = {}
        for p in self.ids:
            pieces, *merges = self.history(p)
            if pieces == [p]:  # a piece that merging never ends in can't be in a result
                self.automaton.add_word(p, p)
                self.merges[p] = tuple(merges)
        self.automaton.make_automaton()
        self.size = max(map(len, self.merges), default=1)
        #: By beginning of a piece the longest piece that it begins with, and by piece the next shorter one.
        self.longest = {p[:k]: self.longest_in(p[:k]) for p in self.merges for k in range(1, len(p) + 1)}
        self.shorter = {p: self.longest_in(p[:-1]) for p in self.merges}
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.compatible = functools.lru_cache(500_000)(self._compatible)
        self.text_of = [self.decoded(i) for i in every]
        self.names = [str(i) for i in every]
        self.parts = Remembered(self.encode_part)
        self.chunks = Remembered(self.chunk)

    def longest_in(self, text: str) -> str | None:
        return next((text[:k] for k in range(len(text), 0, -1) if text[:k] in self.merges), None)

    def history(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The pieces of a short text by merging, the leftmost of the best first; the merges' ranks, then NEVER; and the first
        and the last symbol before each merge and at the end.
        """
        sym, rank = list(text), self.rank.get
        cost = [rank(a + b, NEVER) for a, b in zip(sym, sym[1:], strict=False)]
        ranks, first, last = [], sym[:1], sym[-1:]
        while cost and (best := min(cost)) < NEVER:
            i = cost.index(best)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = rank(sym[i - 1] + sym[i], NEVER)
            if i < len(cost):
                cost[i] = rank(sym[i] + sym[i + 1], NEVER)
            ranks.append(best)
            first.append(sym[0])
            last.append(sym[-1])
        return sym, [*ranks, NEVER], first, last

    def merged(self, text: str) -> list[str]:
        return self.history(text)[0]

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b ends in a, b: each merges as it does alone unless the symbols at the boundary join first."""
        (left, _, ends), (right, begins, _) = self.merges[a], self.merges[b]
        rank, i, j = self.rank.get, 0, 0
        while True:
            across, x, y = rank(ends[i] + begins[j], NEVER), left[i], right[j]
            if across < x and across <= y:
                return False
            if x > y:
                j += 1
            elif x < NEVER:
                i += 1
            else:
                return True

    def backtrack(self, text: str) -> list[str] | None:
        """The pieces of a text all of whose characters have a piece."""
        compatible, longest, shorter, prefix, most = self.compatible, self.longest, self.shorter, self.automaton.longest_prefix, self.size
        out, at, size, last = [], 0, len(text), None
        failed = bytearray(size // 8 + 1)  # a bit for each position
        ahead = text[:most]
        p = longest.get(ahead[: prefix(ahead)])
        while at < size:
            while p is not None:
                to = at + len(p)
                if not failed[to >> 3] >> (to & 7) & 1 and (last is None or compatible(last, p)):
                    break
                p = shorter[p]
            if p is not None:
                out.append(p)
                at, last = to, p
                ahead = text[at : at + most]
                p = longest.get(ahead[: prefix(ahead)])
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    return None
                p = out.pop()
                at -= len(p)
                last = out[-1] if out else None
                p = shorter[p]
        return out

    def encode_part(self, text: str) -> tuple[int, ...]:
        """Ids of a text within which pieces may span any two neighbours."""
        if text in self.merges:
            return (self.ids[text],)
        if len(text) == 1:
            return tuple(self.bytes.get(x, self.unknown) for x in text.encode("utf-8", "surrogatepass"))
        out = self.backtrack(text)
        return tuple(self.ids[p] for p in (out if out is not None else self.merged(text)))

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        beside, parts = self.beside, self.parts
        if beside.issuperset(map(operator.add, chunk, chunk[1:])):
            return parts[chunk]
        out: list[int] = []
        start = 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in beside:
                out += parts[chunk[start:i]]
                start = i
        return tuple(out)

    def chunk(self, chunk: str) -> tuple[str, str]:
        """A chunk's ids as text, and what they decode to with the blank in front: no byte of a character is in another chunk."""
        ids = self.encode_chunk(chunk)
        return " ".join([self.names[i] for i in ids]), self.whole(ids)

    def encoded(self, text: str) -> tuple[str, str]:
        """All ids of a text joined by blanks, the end id last, and the decoded text."""
        if not text:
            return self.names[self.end], ""
        got = list(map(self.chunks.__getitem__, CHUNK.findall(SPACE + text.replace(" ", SPACE))))
        return " ".join([x for x, _ in got]) + " " + self.names[self.end], "".join([x for _, x in got])[1:]

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return list(map(int, self.encoded(text)[0].split(" ")))

    def decoded(self, i: int) -> str:
        """A piece's text; control ids have none, bytes beyond ASCII stand as lone surrogates until decode() joins them."""
        if self.model.is_control(i):
            return ""
        if self.model.is_byte(i):
            return bytes([int(self.pieces[i][1:-1], 16)]).decode("ascii", "surrogateescape")
        return self.pieces[i].replace(SPACE, " ")

    def whole(self, ids: tuple[int, ...] | list[int]) -> str:
        text = "".join([self.text_of[i] for i in ids])
        return text if text.isascii() else RAW.sub(lambda m: utf8(m[0].encode("ascii", "surrogateescape")), text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, bytes read as UTF-8 (each wrong one as U+FFFD), the blank in front taken off."""
        text = self.whole(ids)
        first = next((i for i in ids if not self.model.is_control(i)), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


#: Pieces never hold a blank behind another character, so a new part begins there.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
RAW = re.compile("[\udc80-\udcff]+")
CHARACTER = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|[\x80-\xff]")


def utf8(raw: bytes) -> str:
    """Whole characters as they are, each byte that is in none as U+FFFD."""
    return "".join(x.decode() if len(x) > 1 or x < b"\x80" else "�" for x in CHARACTER.findall(raw))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]). Per row, without a shuffle."""
    extra = ", ids array<int>, decoded string" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = [[], [], [], [], []]
            for t in texts(b):
                got, back = model.encoded(t)
                row = (got.count(" ") + 1, sha(got), sha(back), list(map(int, got.split(" "))) if ids else None, back if ids else None)
                for to, x in zip(rows, row, strict=True):
                    to.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if ids else 3]
            arrays = [pa.array(x, k) for x, k in zip(rows, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if ids else 4])

    few = docs.select("doc_id", "text")
    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
