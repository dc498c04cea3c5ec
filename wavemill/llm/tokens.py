"""Encoding of texts with a public byte-level BPE vocabulary, by a streaming transducer of bounded lookahead.

For a merge list in which every token can be built, a token sequence is the encoding of its text exactly if each two
neighbouring tokens, taken alone, are the encoding of theirs. So each prefix of a text has one last token, found among
the tokens that end there, and the encodings of all prefixes form a tree. Text still to come can only continue from a
prefix that ends less than one longest token back; where the branches of these open prefixes meet, everything before is
final and is emitted. The state is the open part of the tree, whatever the length of the text.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that splits text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of text whose ids a worker remembers, and the longest piece worth it.
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 64
#: Ids after which a batch of rows is handed on.
MOST_IDS = 1 << 22


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge list of a vocabulary file: tokens, how each is built, and which tokens may stand side by side."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        names = model["vocab"]
        special = {s for s in names if any(c not in letters for c in s)}
        self.ids: dict[bytes, int] = {}
        self.bytes: dict[int, bytes] = {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b for a, b in pairs}
        for s, i in names.items():
            if s not in special and (len(s) == 1 or s in made):
                self.ids[as_bytes(s)] = i
                self.bytes[i] = as_bytes(s)
        self.rank = {i: -1 for b, i in self.ids.items() if len(b) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs):
            left, right, whole = names[a], names[b], names[a + b]
            self.merged[left, right] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), r
        #: No token is longer, so text to come can't reach further back: the lookahead after which a token can be final.
        self.lookahead = max(map(len, self.ids))
        #: Every ending of a token: what isn't one, no longer token ends with.
        self.tails = {b[k:] for b in self.ids for k in range(len(b))}
        self._neighbours: dict[tuple[int, int], bool] = {}

    def sound(self) -> bool:
        """Whether every token is the encoding of its own text, as the transducer takes for granted."""
        return all(self.merge(b) == [i] for i, b in self.bytes.items())

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens together are the encoding of their text."""
        key = (left, right)
        known = self._neighbours.get(key)
        if known is None:
            if len(self._neighbours) > REMEMBERED:
                self._neighbours.clear()
            known = self._neighbours[key] = self.merge(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def merge_long(self, text: bytes) -> list[int]:
        """The encoding of any text by the merge list: neighbours in a heap by rank and place, joined in a linked list."""
        ids = [self.ids[bytes([b])] for b in text]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank[w], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (w := self.merged.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = self.merged[left, right], -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (w := self.merged.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (self.rank[w], k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]

    def merge(self, text: bytes) -> list[int]:
        """The encoding of a text no longer than two tokens, straight from the merge list."""
        ids = [self.ids[bytes([b])] for b in text]
        while len(ids) > 1:
            best = min(((self.rank[w], i) for i, p in enumerate(zip(ids, ids[1:])) if (w := self.merged.get(p)) is not None), default=None)
            if best is None:
                return ids
            i = best[1]
            ids[i : i + 2] = [self.merged[ids[i], ids[i + 1]]]
        return ids


class Transducer:
    """Reads bytes, emits the ids that are final. ``feed`` any number of times, then ``close``."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.tail = b""  # text since the last final boundary
        self.last: list[int] = [-1]  # for each boundary in the tail: the last token of the prefix that ends there
        self.before: list[int] = [0]  # and the boundary where this token begins

    def _step(self, end: int) -> None:
        m, tail = self.m, self.tail
        starts, start = [], end - 1
        while start >= 0 and (piece := tail[start:end]) in m.tails:
            if piece in m.ids:
                starts.append(start)
            start -= 1
        for start in reversed(starts):
            token = m.ids[tail[start:end]]
            if self.last[start] < 0 or m.fit(self.last[start], token):
                self.last.append(token)
                self.before.append(start)
                return
        raise ValueError("the vocabulary can't encode this text")

    def _emit(self, upto: int) -> list[int]:
        out, at = [], upto
        while at > 0:
            out.append(self.last[at])
            at = self.before[at]
        return out[::-1]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 4 * self.m.lookahead
        for k in range(0, len(data), step):
            done = len(self.tail)
            self.tail += data[k : k + step]
            for end in range(done + 1, len(self.tail) + 1):
                self._step(end)
            open_ = set(range(max(0, len(self.tail) - self.m.lookahead + 1), len(self.tail) + 1))
            while len(open_) > 1:
                far = max(open_)
                open_.remove(far)
                open_.add(self.before[far])
            (final,) = open_
            if final > 0:
                out += self._emit(final)
                self._forget(final)
        return out

    def _forget(self, final: int) -> None:
        """Boundaries before the final one are gone; the last final token stays to judge its neighbour."""
        token = self.last[final]
        self.tail = self.tail[final:]
        self.last = [token, *self.last[final + 1 :]]
        self.before = [0, *(b - final for b in self.before[final + 1 :])]

    def close(self) -> list[int]:
        out = self._emit(len(self.tail))
        self.tail, self.last, self.before = b"", [-1], [0]
        return out


class Encoder(dict):
    """Ids of pieces of text; a dict of those met before."""

    def __init__(self, data: bytes, sound: bool | None = None):
        super().__init__()
        self.merges = Merges(data)
        self.sound = self.merges.sound() if sound is None else sound
        self.find = regex.compile(SPLIT).finditer

    def __missing__(self, piece: str) -> list[int]:
        if self.sound:
            t = Transducer(self.merges)
            ids = t.feed(piece.encode()) + t.close()
        else:  # a vocabulary with tokens that their own merges don't reach has no neighbours to judge by
            ids = self.merges.merge_long(piece.encode())
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def stream(self, text: str) -> Iterator[int]:
        return chain.from_iterable(self[m.group()] for m in self.find(text))


class Decoder:
    """Byte-to-text state machine: text comes out as soon as its bytes are complete; broken bytes give U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes = merges.bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.machine.decode(self.bytes[i]) for i in ids) + self.machine.decode(b"", True)


_ENCODERS: dict[int, Encoder] = {}


def encoder(data: bytes, sound: bool | None = None) -> Encoder:
    """The encoder of a vocabulary file's content, built once in each process."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data, sound)
    return _ENCODERS[key]


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary for the workers; that its tokens are sound is found out once, on the driver."""
    data = Path(vocabulary).read_bytes()
    return df.sparkSession.sparkContext.broadcast((data, encoder(data).sound))


def _batches(shared, text_at: str, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(*shared.value)
        for batch in batches:
            yield from make(e, batch)

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, ids)``: each row's text as the list of its token ids, without special tokens; their strings in a text
    are ordinary text. Nothing is shuffled.

    Empty and null texts give an empty list; null ids and repeated rows stay; other columns are ignored. The
    vocabulary file (some MB, of fixed size) is read on the driver and sent to the workers.
    """
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    shared = _shared(df, vocabulary)

    def make(e: Encoder, batch: pa.RecordBatch):
        ids: list[int] = []
        ends, first = [0], 0

        def done(last: int) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(ids, np.int32)))
            return pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), lists], names=["id", "ids"])

        for i, text in enumerate(batch.column("text")):
            if text.is_valid:
                ids.extend(e.stream(text.as_py()))
            ends.append(len(ids))
            if len(ids) > MOST_IDS:
                yield done(i + 1)
                ids, ends, first = [], [0], i + 1
        yield done(len(batch))

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_batches(shared, "text", make), out)


def decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, text)``: the text of each list of ids; an empty or null list gives an empty text."""
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    shared = _shared(df, vocabulary)

    def make(e: Encoder, batch: pa.RecordBatch):
        texts = [Decoder(e.merges).decode(x.as_py() or ()) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_batches(shared, "ids", make), out)


def count_tokens(df: DataFrame, text_col: str = "text", *, vocabulary: str = VOCABULARY, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row; 0 for empty and null texts."""
    out = T.StructType([*(df.schema[k] for k in keep), T.StructField("n_tokens", T.LongType())])
    shared = _shared(df, vocabulary)

    def make(e: Encoder, batch: pa.RecordBatch):
        n = [sum(1 for _ in e.stream(x.as_py())) if x.is_valid else 0 for x in batch.column(len(keep))]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(_batches(shared, "text", make), out)
