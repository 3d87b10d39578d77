"""Repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A byte is removed if a string of `length` bytes that covers it also starts elsewhere.

Which suffixes are sorted. Of each window of `length` bytes one position is its
anchor: the leftmost of the smallest hashes of the window's `seed_bytes`-byte strings.
The choice depends on the window's bytes alone, so equal windows have the same anchor,
and only suffixes that start at anchors (about 1 in 180 positions) need sorting. Seeds
that would be the anchor of very many windows (a line in most documents) are counted
first and passed over wherever a window has another; they are at most SEEDS_AVOIDED. An
anchor whose seed occurs once cannot lie in a repeated window; it is dropped by
counting hashes, as distinguishing prefixes are found in distributed string sorting.
Anchors with the same bytes on both sides (one class) decide each other at once, and
one of them stands for the class.

How they are sorted. Each task sorts its suffixes into runs, front-codes them (length
of the prefix shared with the one before, then the rest), one run for each range of
mixed seed hashes. A range's runs meet in one task and are combined by a loser tree whose nodes
keep the common prefix with the last string put out, so known prefixes are never
compared again and the merged order comes with its common-prefix lengths.

What follows from the order. Neighbours in the order that share `r` bytes, and `l`
bytes to the left of the anchor, share l + r bytes; where that is `length` or more, all
of them are removed. Small groups are compared pair by pair; for larger ones what any two
share to the right is the least of what lies between them in the merged order, and
likewise to the left in the order of the reversed left sides. Groups too large for one
task (a line or passage in very many documents) are narrowed instead: the windows of an
anchor are split into ranges; a range whose common core is unique holds no repeat, one
whose whole span occurs elsewhere is all repeat, and only what is left is split again,
down to single windows, by counting hashes over the cluster.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_light, keep, stored

LENGTH = 400
SEED_BYTES = 48
# Bytes scanned at a time, and their place in a window key.
SCAN = 1 << 18
_PLACE_BITS = 22
# Suffixes of one sorted run, and of one range of the exchange.
RUN_SUFFIXES, RANGE_SUFFIXES = 20_000, 4_000
# Classes of one seed that one task refines.
GROUP_LIMIT = 6_000
# A seed is passed over if it anchors more often than this, or than its even share of
# SEEDS_AVOIDED seeds; so no more than SEEDS_AVOIDED are sent to the executors.
OFTEN, SEEDS_AVOIDED = 3_000, 100_000
PAIRWISE = 6
# A range of windows is split into so many at a time.
SPLIT = 4
# Sides up to this measured size are broadcast; beyond it the join shuffles.
LIGHT = 16_000_000
# Rows of a batch handled at a time in Python.
SLICE = 256
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HEAD = struct.Struct("<HHHQ")


class _Hasher:
    """Hashes of all `width`-byte strings of a block, by differences of weighted sums."""

    def __init__(self, width: int, longest: int) -> None:
        self.width = width
        self.table = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = np.multiply.accumulate(np.full(longest, _BASE, dtype=np.uint64))
        self.down = np.multiply.accumulate(np.full(longest, pow(_BASE, -1, 1 << 64), dtype=np.uint64))

    def __call__(self, block: np.ndarray) -> np.ndarray:
        n = len(block)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[block] * self.up[:n], dtype=np.uint64, out=sums[1:])
        h = (sums[self.width :] - sums[: n + 1 - self.width]) * self.down[: n + 1 - self.width]
        h ^= h >> np.uint64(29)
        h *= _MIX
        return h ^ (h >> np.uint64(32))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from prefix and suffix minima of blocks."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


class Scanner:
    """Anchors of texts; blocks of many short texts or of parts of a long one."""

    def __init__(self, length: int, seed_bytes: int, avoided: np.ndarray | None = None) -> None:
        self.length, self.seed_bytes = length, seed_bytes
        self.avoided = np.sort(avoided) if avoided is not None and len(avoided) else None
        self.hasher = _Hasher(seed_bytes, SCAN + length)

    def block(self, block: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, seed hashes) of the anchors of the windows that begin at `starts`."""
        h = self.hasher(block)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = self.length - self.seed_bytes + 1
        places = np.unique((_sliding_least(keys, width)[starts] & low).astype(np.int64))
        if self.avoided is not None and self._avoid(h[places]).any():
            often = self._avoid(h)
            keys[often] |= ~low  # last choice of any window
            places = np.unique((_sliding_least(keys, width)[starts] & low).astype(np.int64))
        return places, h[places]

    def _avoid(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.avoided, h)
        at[at == len(self.avoided)] = 0
        return self.avoided[at] == h

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text number, places, seed hashes); a long text comes in several parts."""
        batch: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) < self.length:
                continue
            if len(t) > SCAN:
                last = -1
                for at in range(0, len(t) - self.length + 1, SCAN):
                    part = np.frombuffer(t, np.uint8)[at : at + SCAN + self.length - 1]
                    places, h = self.block(part, np.arange(len(part) - self.length + 1))
                    new = places + at > last  # a part may repeat the last anchor of the part before
                    last = max(last, int(places[-1]) + at)
                    yield i, places[new] + at, h[new]
                continue
            if size + len(t) > SCAN:
                yield from self._batch(texts, batch)
                batch, size = [], 0
            batch.append(i)
            size += len(t)
        yield from self._batch(texts, batch)

    def _batch(self, texts: list[bytes], batch: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if not batch:
            return
        block = np.frombuffer(b"".join(texts[i] for i in batch), np.uint8)
        sizes = np.array([len(texts[i]) for i in batch])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = np.arange(len(block)) - np.repeat(begins, sizes) + self.length <= np.repeat(sizes, sizes)
        places, h = self.block(block, np.flatnonzero(inside))
        cuts = np.searchsorted(places, begins[1:])
        for i, p, g, b in zip(batch, np.split(places, cuts), np.split(h, cuts), begins):
            yield i, p - b, g


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short batches, so that few texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _seeds(length: int, seed_bytes: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Seed hashes of all anchors, with how often a few texts have them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(length, seed_bytes)
        for batch in _slices(batches):
            found = [h for _, _, h in scanner.texts([t.encode() for t in batch.column(0).to_pylist()])]
            if found:
                seeds, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(counts.astype(np.int64))], names=["seed", "n"])

    return run


def frequent_seeds(rows: DataFrame, length: int, seed_bytes: int, often: int) -> np.ndarray:
    """Seeds to pass over; their number is bounded by SEEDS_AVOIDED."""
    counts = keep(rows.select("text").mapInArrow(_seeds(length, seed_bytes), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") > often))
    # An even share of all counted: no more than SEEDS_AVOIDED seeds can be above it.
    share = (counts.agg(F.sum("n")).first()[0] or 0) / SEEDS_AVOIDED
    found = [r.seed for r in counts.where(F.col("n") > share).select("seed").collect()]
    return np.array(found, dtype=np.int64).view(np.uint64)


def _anchors(length: int, seed_bytes: int, avoided: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    left_reach = length - seed_bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(length, seed_bytes, avoided)
        for batch in _slices(batches):
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            rows, places, seeds, contexts, reaches = [], [], [], [], []
            for i, pos, h in scanner.texts(texts):
                t = texts[i]
                rows.append(np.full(len(pos), i))
                places.append(pos)
                seeds.append(h)
                lefts = np.minimum(pos, left_reach)
                rights = np.minimum(len(t) - pos, length)
                reaches.append(lefts * 65_536 + rights)
                contexts += [xxhash.xxh3_64_intdigest(t[p - a : p + b], a) for p, a, b in zip(pos.tolist(), lefts.tolist(), rights.tolist())]
            if not rows:
                continue
            r = np.concatenate(rows)
            columns = [k1[r], k2[r], np.concatenate(places), np.concatenate(seeds).view(np.int64), np.array(contexts, dtype=np.uint64).view(np.int64), np.concatenate(reaches)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "pos", "seed", "context", "reach"])

    return run


# --- sorted runs, front coding and the loser tree ---------------------------------------


class Suffix(NamedTuple):
    """`text` is the seed hash (big endian) and the bytes from the anchor on; `left` runs backwards."""

    text: bytes
    left: bytes
    context: int


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, if `known` bytes are known to agree."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            m = min(len(x), len(y))
            diff = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + (8 * m - diff.bit_length()) // 8
        known += len(x)
    return n


def encode_run(suffixes: list[Suffix]) -> bytes:
    """Front-code sorted suffixes: shared prefix length, then the rest."""
    out, before = [], b""
    for s in suffixes:
        shared = common_prefix(before, s.text)
        out += (_HEAD.pack(shared, len(s.text) - shared, len(s.left), s.context & (1 << 64) - 1), s.text[shared:], s.left)
        before = s.text
    return b"".join(out)


def decode_run(blob: bytes) -> Iterator[tuple[int, Suffix]]:
    """(prefix shared with the one before, suffix) in order."""
    at, text = 0, b""
    while at < len(blob):
        shared, rest, left, context = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        text = text[:shared] + blob[at : at + rest]
        at += rest
        yield shared, Suffix(text, blob[at : at + left], context)
        at += left


def merge_runs(blobs: Iterable[bytes]) -> Iterator[tuple[int, Suffix]]:
    """Merge front-coded runs: (prefix shared with the last suffix put out, suffix).

    A node of the loser tree holds a run whose head lost there. `known[i]` is what the
    head of run i shares with the last output. Of two heads the one that shares more is
    smaller; only if they share the same are bytes compared, and only from there on.
    """
    runs = [decode_run(b) for b in blobs]
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[Suffix | None] = [None] * size
    known = [0] * size
    for i, r in enumerate(runs):
        known[i], heads[i] = next(r, (0, None))

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser learns what it shares with the winner."""
        a, b = heads[i], heads[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        if known[i] > known[j]:
            return i, j
        if known[j] > known[i]:
            return j, i
        shared = common_prefix(a.text, b.text, known[i])
        if a.text[shared : shared + 1] <= b.text[shared : shared + 1]:
            known[j] = shared
            return i, j
        known[i] = shared
        return j, i

    losers = [0] * size
    winners = [*([0] * size), *range(size)]
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while heads[best] is not None:
        yield known[best], heads[best]
        known[best], heads[best] = next(runs[best], (0, None))
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


# --- groups of the merged order ----------------------------------------------------------


def shared_spans(group: list[Suffix], shared: list[int], length: int) -> list[tuple[int, int] | None]:
    """For each suffix of a sorted group: (l, r) bytes around the anchor to remove, if any.

    `shared[i]` is the number of bytes that i has in common with i - 1. All repeated
    strings found here hold the anchor, so together they are one span.
    """
    if len(group) > PAIRWISE:
        return _spans_of_many(group, shared, length)
    best: list[tuple[int, int] | None] = [None] * len(group)
    for i in range(len(group)):
        right = length
        for j in range(i + 1, len(group)):
            right = min(right, shared[j])
            left = common_prefix(group[i].left, group[j].left)
            if left + right >= length:
                for k in (i, j):
                    l, r = best[k] or (0, 0)
                    best[k] = (max(l, left), max(r, right))
    return best


def _common(adjacent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What each of `rows` shares with all of an order: the least of what all between share."""
    n = len(adjacent)
    far = np.iinfo(adjacent.dtype).max
    place = np.arange(n)[None, :]
    after = np.where(place > rows[:, None], adjacent[None, :], far).astype(adjacent.dtype)
    np.minimum.accumulate(after, axis=1, out=after)
    # Backwards, the value between two neighbours belongs to the later one.
    ahead = np.append(adjacent[1:], far)
    before = np.where(place < rows[:, None], ahead[None, :], far).astype(adjacent.dtype)[:, ::-1]
    before = np.minimum.accumulate(before, axis=1)[:, ::-1]
    return np.where(place > rows[:, None], after, before)


def _spans_of_many(group: list[Suffix], shared: list[int], length: int) -> list[tuple[int, int] | None]:
    """The same for a group of bounded size, by tables of shared bytes, some rows at a time."""
    n = len(group)
    kind = np.int16 if length < 16_000 else np.int32
    right_adjacent = np.array(shared, dtype=kind)
    order = sorted(range(n), key=lambda i: group[i].left)
    left_adjacent = np.array([0, *(common_prefix(group[i].left, group[j].left) for i, j in zip(order, order[1:]))], dtype=kind)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out: list[tuple[int, int] | None] = []
    for start in range(0, n, 256):
        rows = np.arange(start, min(n, start + 256))
        right = _common(right_adjacent, rows)
        left = _common(left_adjacent, place[rows])[:, place]
        own = (np.arange(len(rows)), rows)
        left[own] = right[own] = -1
        hit = left + right >= length
        most_left, most_right = np.where(hit, left, -1).max(axis=1), np.where(hit, right, -1).max(axis=1)
        out += [(int(l), int(r)) if l >= 0 else None for l, r in zip(most_left, most_right)]
    return out


def decided(merged: Iterable[tuple[int, Suffix]], length: int, seed_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """(seed, context, l, r) from suffixes in order with their common prefixes."""
    group: list[Suffix] = []
    shared: list[int] = []

    def close() -> Iterator[tuple[int, int, int, int]]:
        if len(group) > 1:
            for s, span in zip(group, shared_spans(group, shared, length)):
                if span:
                    yield int.from_bytes(s.text[:8], "big", signed=True), s.context - (1 << 64) * (s.context >> 63), *span

    for known, s in merged:
        if known < 8 + seed_bytes:
            yield from close()
            group, shared = [], []
        group.append(s)
        shared.append(known - 8)
    yield from close()


def _suffixes(batches: Iterable[pa.RecordBatch], length: int, seed_bytes: int) -> Iterator[Suffix]:
    for batch in _slices(batches):
        for text, wanted in zip(batch.column(2), batch.column(3).to_pylist()):
            t = text.as_py().encode()
            for w in wanted:
                p = w["pos"]
                yield Suffix(
                    w["seed"].to_bytes(8, "big", signed=True) + t[p : p + length], t[max(0, p - length + seed_bytes) : p][::-1], w["context"] & (1 << 64) - 1
                )


def range_of(seed: int, ranges: int) -> int:
    """The range of the exchange that takes a seed.

    Anchors are least hashes, so their seeds crowd at the small end; multiplied they spread evenly.
    """
    return ((seed * _BASE & (1 << 64) - 1) * ranges) >> 64


def _runs(length: int, seed_bytes: int, ranges: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[Suffix]] = {}
        held = 0

        def flushed() -> pa.RecordBatch:
            pieces = [(r, encode_run(sorted(part))) for r, part in parts.items()]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.binary())], names=["range", "run"])

        for s in _suffixes(batches, length, seed_bytes):
            parts.setdefault(range_of(int.from_bytes(s.text[:8], "big"), ranges), []).append(s)
            held += 1
            if held >= RUN_SUFFIXES:
                yield flushed()
                held = 0
        if parts:
            yield flushed()

    return run


def _cores(length: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the ranges of `width` windows within each wanted range.

    Windows are named by the bytes they take left of the anchor. The core of a range is
    in all its windows; its span (two longs, null if the text ends within it) holds them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "pos", "seed", "context", "p", "q", "core", "s1", "s2"]
        for batch in _slices(batches):
            rows: list[tuple] = []
            for k1, k2, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                t = text.encode()
                for w in wanted:
                    at = w["pos"]
                    least, most = max(0, length - (len(t) - at)), at
                    for p in range(w["p"], w["q"] + 1, width):
                        q = min(p + width - 1, w["q"])
                        if p > most or q < least:
                            continue
                        core = xxhash.xxh3_64_intdigest(t[at - p : at - q + length], p * 1024 + q) - (1 << 63)
                        s1 = s2 = None
                        if q <= most and p >= least:
                            whole = xxhash.xxh3_128_intdigest(t[at - q : at - p + length], p * 1024 + q)
                            s1, s2 = (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)
                        rows.append((k1, k2, at, w["seed"], w["context"], p, q, core, s1, s2))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


# --- the operator -------------------------------------------------------------------------


def repeated_spans(rows: DataFrame, length: int, seed_bytes: int, group_limit: int, often: int) -> DataFrame:
    """(k1, k2, spans) for texts (k1, k2, text) that hold repeated windows: maximal spans in order."""
    avoided = frequent_seeds(rows, length, seed_bytes, often)
    anchors = stored(rows.mapInArrow(_anchors(length, seed_bytes, avoided), "k1 long, k2 long, pos long, seed long, context long, reach long"))
    twice = keep(anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"))
    members = stored(anchors.join(_light(twice, F.lit(8)), "seed"))
    classes = keep(
        members.groupBy("seed", "context", "reach").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("first"))
    )
    sizes = keep(classes.groupBy("seed").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"))
    unequal = keep(classes.join(sizes, "seed").select("seed", "context", "classes", "first.*"))
    left, right = F.shiftright("reach", 16), F.col("reach").bitwiseAND(65_535)
    found = classes.where("n > 1").select("seed", "context", left.alias("l"), right.alias("r"))
    sorted_, large = (unequal.where(c).drop("classes") for c in (F.col("classes") <= group_limit, F.col("classes") > group_limit))
    n_sorted, n_large = (
        unequal.agg(F.count_if(F.col("classes") <= group_limit), F.count_if(F.col("classes") > group_limit)).first()
    )
    if n_sorted:
        ranges = max(min(64, n_sorted // 500), n_sorted // RANGE_SUFFIXES, 1)
        runs = _texts_of(rows, sorted_, limit=0).mapInArrow(_runs(length, seed_bytes, ranges), "range long, run binary")

        def merged(group: pa.Table) -> pa.Table:
            rows = list(decided(merge_runs(group.column("run").to_pylist()), length, seed_bytes))
            columns = list(zip(*rows)) or [()] * 4
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=["seed", "context", "l", "r"])

        in_order = runs.repartition(ranges, "range").groupBy("range").applyInArrow(merged, "seed long, context long, l long, r long")
        found = found.unionByName(in_order)
    if n_large:
        found = found.unionByName(narrowed(rows, large, length, seed_bytes))
    # All spans of a class hold its anchor, so the farthest ends are their union.
    found = keep(found.groupBy("seed", "context").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    spans = members.join(found, ["seed", "context"]).select(
        "k1", "k2", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b")
    )
    # Spans that touch are joined within each text, so that one text has few.
    along = Window.partitionBy("k1", "k2").orderBy("a", "b")
    before = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.distinct().withColumn("_new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(along))
    joined = parts.groupBy("k1", "k2", "_part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return keep(joined.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")))


def _light(df: DataFrame, row_bytes: Column) -> DataFrame:
    return broadcast_if_light(df, row_bytes, LIGHT)


def _texts_of(rows: DataFrame, chosen: DataFrame, limit: int = LIGHT) -> DataFrame:
    """(k1, k2, text, wanted): texts with the rows of `chosen` in them; the list is bounded by the text.

    The list of all suffixes to sort follows the data and is joined by a shuffle at
    every size (limit 0); the lists of the few large groups are broadcast if light.
    """
    columns = [c for c in chosen.columns if c not in ("k1", "k2")]
    wanted = keep(chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct(*columns)).alias("wanted")))
    listed = broadcast_if_light(wanted, 16 + 8 * len(columns) * F.size("wanted"), limit) if limit else wanted.hint("shuffle_hash")
    return rows.join(listed, ["k1", "k2"]).select("k1", "k2", "text", "wanted")


def narrowed(rows: DataFrame, large: DataFrame, length: int, seed_bytes: int) -> DataFrame:
    """(seed, context, l, r) of the classes of large groups, by ranges of windows.

    Each level has at most a few rows per class, whatever the size of its group.
    """
    reach = length - seed_bytes
    width = -(-(reach + 1) // 2)
    todo = large.select("seed", "context", "k1", "k2", "pos", F.lit(0).cast("long").alias("p"), F.lit(reach).cast("long").alias("q"))
    found: DataFrame | None = None
    while True:
        hashed = keep(
            _texts_of(rows, todo).mapInArrow(
                _cores(length, width), "k1 long, k2 long, pos long, seed long, context long, p long, q long, core long, s1 long, s2 long"
            )
        )
        cores = keep(hashed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
        live = keep(hashed.join(_light(cores, F.lit(8)), "core"))
        whole = keep(live.where("s1 is not null").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s1", "s2", F.lit(True).alias("whole")))
        judged = keep(live.join(_light(whole, F.lit(16)), ["s1", "s2"], "left"))
        done = judged.where("whole").select("seed", "context", F.col("q").alias("l"), (length - F.col("p")).alias("r"))
        found = done if found is None else found.unionByName(done)
        if width == 1:
            return found
        undecided = judged.where("whole is null")
        # What is decided may still be the other place of what is not: one of each span stays.
        open_cores = keep(undecided.select("core").distinct())
        row = ("seed", "context", "k1", "k2", "pos", "p", "q")
        partners = judged.where("whole").groupBy("s1", "s2", "core").agg(F.min(F.struct(*row)).alias("one"))
        partners = partners.join(_light(open_cores, F.lit(8)), "core", "left_semi").select("one.*")
        todo = undecided.select(*row).unionByName(partners)
        width = max(1, width // SPLIT)


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Shrink spans so that no character of a UTF-8 text is cut."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = LENGTH,
    seed_bytes: int = SEED_BYTES,
    group_limit: int = GROUP_LIMIT,
    often: int = OFTEN,
    carry: tuple[str, ...] = (),
    words: int = 0,
) -> DataFrame:
    """(doc_id, carry..., n_bytes, spans, kept, kept_text): one row per input row.

    `spans` are the maximal removed byte ranges (a, b); `kept` the remaining bytes;
    `kept_text` the remaining text, in which a character on a border stays whole. All
    windows of the input count, those of the same document and of repeated rows
    included. Null texts count as empty; texts shorter than `length` stay as they are.
    With `words`, of the spans under LENGTH bytes only those that touch so many words
    are removed. A null id stays null. Columns named in `carry` are passed on; other columns are
    ignored. An empty table gives an empty result.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"carry_{c}") for c in carry], value.alias("text"),
        F.xxhash64(F.col(doc_id), F.lit("id")).alias("k1"), F.xxhash64(value).alias("k2"),
    )
    found = repeated_spans(rows.select("k1", "k2", "text"), length, seed_bytes, group_limit, often)

    names = ["doc_id", *(f"carry_{c}" for c in carry)]
    light = _light(found, 16 + 16 * F.size("spans"))
    joined = rows.join(light, ["k1", "k2"], "left").select(*names, "text", "spans")
    kinds = ", ".join(f"`{n}` {joined.schema[n].dataType.simpleString()}" for n in names)
    done = joined.mapInArrow(_cut(len(names), words), f"{kinds}, n_bytes long, spans array<struct<a:long,b:long>>, kept binary, kept_text string")
    return done.select("doc_id", *[F.col(f"carry_{c}").alias(c) for c in carry], "n_bytes", "spans", "kept", "kept_text")


def _cut(passed: int, words: int = 0) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Remove the spans of each text; the first `passed` columns go through."""
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, spans, kept, texts = [], [], [], []
            for t, s in zip(batch.column(passed).to_pylist(), batch.column(passed + 1).to_pylist()):
                data = t.encode()
                found = [(x["a"], x["b"]) for x in s or () if x["b"] - x["a"] >= LENGTH or len(data[x["a"] : x["b"]].split()) >= words]
                sizes.append(len(data))
                spans.append([{"a": a, "b": b} for a, b in found])
                kept.append(without(data, found) if found else data)
                texts.append(without(data, whole_characters(data, found)).decode() if found else t)
            columns = [*batch.columns[:passed], pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:passed], "n_bytes", "spans", "kept", "kept_text"])

    return run
