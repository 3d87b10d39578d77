"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Self-attention over a document of n tokens costs about LINEAR * n + QUADRATIC * n^2.
Within a block of documents the pieces are taken in descending order and each goes
to the sequence with the lowest cost so far that still has room; a piece that fits
nowhere is cut. Blocks are consecutive rows of one input partition, so nothing is
shuffled and memory is bounded by the block. What does not fill a sequence is
carried into the next block; only the end of a partition leaves a rest, which is
written as sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SEQUENCE = 2048
BLOCK_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
WORDS_KEPT = 400_000
# ASCII marks that are pre-tokens of their own after a letter (the apostrophe may start a contraction).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
END = 1
_NONE = (float("inf"), -1)

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


class WordIds(dict):
    """Ids of a word between blanks as little-endian uint32 bytes, filled from the library.

    The tokenizer lower-cases, drops white space and no pre-token crosses it, so a
    text's ids are the ids of its words, and a word of ASCII letters is one pre-token
    that the model can be asked for directly. The table is emptied when full.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        letters = word.rstrip(MARKS)
        plain = letters.isascii() and letters.isalpha()
        if plain and not letters.islower():
            return self[letters.lower()] + (self[word[len(letters) :]] if len(letters) < len(word) else b"")
        if len(letters) < len(word) and letters.isalpha() and letters.lower().isalpha():
            return self[letters] + self[word[len(letters) :]]
        found = [t.id for t in self.model.tokenize(word)] if plain else self.tokenizer.encode(word, add_special_tokens=False).ids
        ids = np.asarray(found, dtype="<u4").tobytes()
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(Tokenizer.from_file(path))
    return _LOADED[path]


@dataclass(slots=True)
class Piece:
    doc: int
    start: int
    length: int


@dataclass(slots=True)
class Sequence:
    room: int
    cost: float = 0.0
    pieces: list[Piece] = field(default_factory=list)

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.room -= piece.length
        self.cost += LINEAR * piece.length + QUADRATIC * piece.length**2


class _CheapestWithRoom:
    """Open sequences by room: a heap of (cost, number) each, under a tree of their least."""

    def __init__(self, size: int, count: int) -> None:
        self.base = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        self.least: list[tuple[float, int]] = [_NONE] * (2 * self.base)
        self.heaps[size] = [(0.0, i) for i in range(count)]
        self._update(size)

    def _update(self, room: int) -> None:
        least, at = self.least, self.base + room
        least[at] = self.heaps[room][0] if self.heaps[room] else _NONE
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def add(self, room: int, cost: float, i: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, i))
            self._update(room)

    def take(self, length: int) -> int | None:
        """The cheapest sequence with at least `length` room, which leaves; None without one."""
        at, found, place = self.base + length, _NONE, 0
        if self.least[at] < found:
            found, place = self.least[at], at
        while at > 1:
            if not at & 1 and self.least[at + 1] < found:
                found, place = self.least[at + 1], at + 1
            at >>= 1
        if not place:
            return None
        while place < self.base:
            place = 2 * place if self.least[2 * place] == found else 2 * place + 1
        heapq.heappop(self.heaps[place - self.base])
        self._update(place - self.base)
        return found[1]


def pack(pieces: Iterable[Piece], size: int, close: bool) -> tuple[list[Sequence], list[Piece]]:
    """Fill whole sequences of `size`; the second list holds what is left over.

    With `close` the rest is written as sequences of power-of-two lengths instead.
    """
    done: list[Sequence] = []
    small: list[Piece] = []
    for p in pieces:
        while p.length >= size:
            full = Sequence(size)
            full.put(Piece(p.doc, p.start, size))
            done.append(full)
            p = Piece(p.doc, p.start + size, p.length - size)
        if p.length:
            small.append(p)
    small.sort(key=lambda p: (-p.length, p.doc, p.start))
    total = sum(p.length for p in small)
    count = total // size
    bins = [Sequence(size) for _ in range(count)]
    rest: list[Piece] = []
    open_ = _CheapestWithRoom(size, count)
    for p in small:
        i = open_.take(p.length)
        if i is None:
            rest.append(p)
            continue
        bins[i].put(p)
        open_.add(bins[i].room, bins[i].cost, i)
    heap = [(b.cost, i) for i, b in enumerate(bins) if b.room]
    heapq.heapify(heap)
    # What fitted nowhere is cut to fill the open sequences, cheapest first.
    left: list[Piece] = []
    for p in rest:
        while p.length and heap:
            _, i = heapq.heappop(heap)
            take = min(p.length, bins[i].room)
            bins[i].put(Piece(p.doc, p.start, take))
            p = Piece(p.doc, p.start + take, p.length - take)
            if bins[i].room:
                heapq.heappush(heap, (bins[i].cost, i))
        if p.length:
            left.append(p)
    done += bins
    if close:
        for power in _powers(sum(p.length for p in left)):
            last = Sequence(power)
            while last.room:
                p = left.pop()
                take = min(p.length, last.room)
                last.put(Piece(p.doc, p.start, take))
                if p.length > take:
                    left.append(Piece(p.doc, p.start + take, p.length - take))
            done.append(last)
    return done, left


def _powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class _Packer:
    """One input partition: documents in, packed pieces out, one block at a time."""

    def __init__(self, partition: int, size: int) -> None:
        self.size = size
        self.next_sequence = partition << 32
        self.ids: list[bytes] = []
        self.doc_ids: list = []
        self.left: list[Piece] = []
        self.new: list[Piece] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        self.new.append(Piece(len(self.ids), 0, n))
        self.ids.append(ids)
        self.doc_ids.append(doc_id)
        self.tokens += n

    def flush(self, close: bool = False) -> Iterator[tuple]:
        done, left = pack([*self.left, *self.new], self.size, close)
        for s in done:
            at, length = 0, sum(p.length for p in s.pieces)
            for p in s.pieces:
                ids = self.ids[p.doc]
                yield (
                    self.doc_ids[p.doc], p.start, p.length, ids[4 * p.start : 4 * (p.start + p.length)], len(ids) // 4,
                    self.next_sequence, at, length, s.cost,
                )
                at += p.length
            self.next_sequence += 1
        # Only documents with tokens left stay.
        kept = sorted({p.doc for p in left})
        place = {d: i for i, d in enumerate(kept)}
        self.ids = [self.ids[d] for d in kept]
        self.doc_ids = [self.doc_ids[d] for d in kept]
        self.left = [Piece(place[p.doc], p.start, p.length) for p in left]
        self.new, self.tokens = [], 0


def pack_documents(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, end: int | None = END
) -> DataFrame:
    """One row per piece of a packed sequence, with its ids (little-endian uint32).

    A document is its ids plus `end`. Null and empty texts are the end id alone.
    Repeated rows are packed as often as they occur. A null id stays null. Other
    columns are ignored. `sequence_id` is unique over all partitions; `offset` runs
    without a gap from 0. Texts are tokenised once and whole; a document longer than
    a sequence fills sequences of its own and only its remainder is balanced.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = SCHEMA.format(id=id_type.simpleString())
    closing = np.asarray([end] if end is not None else [], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        packer = _Packer(TaskContext.get().partitionId(), size)
        types = None
        for batch in batches:
            types = types or _arrow_types(batch.schema.field(0).type)
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(d, words.of(t.as_py()) + closing)
                if packer.tokens >= BLOCK_TOKENS:
                    yield from _batches(packer.flush(), types)
        if types:
            yield from _batches(packer.flush(close=True), types)

    return rows.mapInArrow(run, schema)


def _arrow_types(id_type: pa.DataType) -> pa.Schema:
    names = "start length ids doc_tokens sequence_id offset sequence_length".split()
    fields = [pa.field(n, pa.binary() if n == "ids" else pa.int64()) for n in names]
    return pa.schema([pa.field("doc_id", id_type), *fields, pa.field("sequence_cost", pa.float64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_most: int = 2000) -> Iterator[pa.RecordBatch]:
    chunk: list[tuple] = []
    for r in rows:
        chunk.append(r)
        if len(chunk) == at_most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), schema)], schema=schema)
            chunk = []
    if chunk:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), schema)], schema=schema)
