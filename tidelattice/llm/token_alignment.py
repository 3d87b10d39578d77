"""Alignment of two tokenizers by diagonal run skipping, and links of their tokens.

Both tokenizations of a text are arrays of end offsets in bytes. While both emit the
same tokens, ends agree at a constant shift of the two indexes (a diagonal). A probe
of doubling length compares the arrays at that shift and skips the whole one-to-one
stretch; where it fails, halving finds the last agreement, the irregular group that
follows is walked token by token until both end at one byte, and the shift is updated.

Each group yields its links (tokens whose bytes overlap). A document keeps its
distinct id pairs with their numbers of occurrences, sorted and coded as differences.
Pairs are counted per task before the shuffle. Counts go back to the documents by
slices of the first vocabulary: pairs of one A id are in one slice, so its highest
count is known there. A slice's counts come first in a sorted stream and blocks of
documents follow, so a task holds one slice of counts and one batch of blocks; many
blocks are dealt over several copies of a slice. No pair is a join key, so a pair that
stands in every document makes no hot group.

Defined results: a text that is null, empty, or whose tokens do not spell it out (the
second library may normalise) has no tokens and zeros; very long texts are tokenised
whole, one text at a time; repeated rows are documents of their own and count as such;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import keep, stored

# Slices of the first vocabulary.
SLICES = 16
# Documents whose pairs travel together, and blocks that one copy of a slice meets.
BLOCK_DOCS, BLOCKS_A_COPY = 256, 512
# Characters tokenised at once (at least one text).
PART_CHARS = 500_000
# Pairs counted in a task before its counts are passed on.
COUNTED = 4_000_000


class Vocabularies:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, first: str, second: str) -> None:
        with open(first, encoding="utf-8") as f:
            spelled = json.load(f)["model"]["vocab"]
        # Byte-level vocabularies write each byte as one printable character.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(letters[c] for c in t): i for t, i in spelled.items() if not t.startswith("<|")}
        # The ids of this vocabulary are its merge ranks.
        self.first = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        by_id = {i: b for b, i in ranks.items()}
        self.first_bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.second_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.first_size, self.second_size = ([len(b) for b in x] for x in (self.first_bytes, self.second_bytes))
        self.width = len(self.second_bytes)
        # Ids as text, with what follows the last token of a group and any other.
        self.last_a, self.more_a = ([f"{i}{c}" for i in range(len(self.first_bytes))] for c in "|,")
        self.last_b, self.more_b = ([f"{i}{c}" for i in range(self.width)] for c in ";,")

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        if self.second.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of blank and text in both; none where they do not spell the text.

        The first library cuts the bytes as they are, so its tokens spell the text if
        their sizes add up; the second may change characters. One library after the
        other reads all texts, which keeps its tables in the processor's cache.
        """
        wanted = [b" " + t.encode() for t in texts]
        second = [self.second.encode(t) for t in texts]
        spelled = [b"".join(map(self.second_bytes.__getitem__, b)) == w for b, w in zip(second, wanted, strict=True)]
        first = [self.first.encode_ordinary(" " + t) if s else [] for t, s in zip(texts, spelled, strict=True)]
        whole = [s and sum(map(self.first_size.__getitem__, a)) == len(w) for s, a, w in zip(spelled, first, wanted, strict=True)]
        return [(a, b) if w else ([], []) for a, b, w in zip(first, second, whole, strict=True)]


@lru_cache(maxsize=2)
def vocabularies(first: str, second: str) -> Vocabularies:
    return Vocabularies(first, second)


class Alignment(NamedTuple):
    """Group borders, flat: after each entry the token numbers reached in both, and whether it is a stretch of one-to-one groups."""

    left_ends: list[int]
    right_ends: list[int]
    straight: list[bool]
    left: list[int]  # links of irregular groups: token numbers in the first
    right: list[int]  # and in the second


def align(ends_a: list[int], ends_b: list[int]) -> Alignment:
    """Groups of two arrays of end offsets whose last entries agree, and the links of irregular groups."""
    found = Alignment([], [], [], [], [])
    reach_a, reach_b, straight, left, right = (x.append for x in found)
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    while i < n:
        a, b = ends_a[i], ends_b[j]
        if a == b:
            # Probe along the diagonal with doubling steps, then close in by halving.
            k, step, limit = 1, 2, min(n - i, m - j)
            while k < limit and ends_a[i + k : i + k + step] == ends_b[j + k : j + k + step]:
                k += step
                step += step
            step //= 2
            while step and k < limit:
                if ends_a[i + k : i + k + step] == ends_b[j + k : j + k + step]:
                    k += step
                step //= 2
            if k > limit:
                k = limit
            i += k
            j += k
            straight(True)
        else:
            # An irregular group: each step links two overlapping tokens.
            while a != b:
                left(i)
                right(j)
                if a < b:
                    i += 1
                    a = ends_a[i]
                else:
                    j += 1
                    b = ends_b[j]
            left(i)
            right(j)
            i += 1
            j += 1
            straight(False)
        reach_a(i)
        reach_b(j)
    return found


def links(found: Alignment) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all links: those of one-to-one stretches along their diagonals, then the others."""
    straight = np.array(found.straight, bool)
    out = []
    for ends, others in ((found.left_ends, found.left), (found.right_ends, found.right)):
        ends = np.array(ends, np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        sizes = (ends - starts)[straight]
        before = np.cumsum(sizes) - sizes
        out.append(np.concatenate([np.arange(sizes.sum()) + np.repeat(starts[straight] - before, sizes), np.array(others, np.int64)]))
    return out[0], out[1]


def spelled_groups(v: Vocabularies, found: Alignment, a: list[int], b: list[int]) -> str:
    """`a1,a2|b1;a3|b2,b3`: ids of each group in order."""
    sa, sb = list(map(v.last_a.__getitem__, a)), list(map(v.last_b.__getitem__, b))
    more_a, more_b = v.more_a, v.more_b
    parts: list[str] = []
    i = j = 0
    for i1, j1, one_to_one in zip(found.left_ends, found.right_ends, found.straight, strict=True):
        if one_to_one:
            both = [""] * (2 * (i1 - i))
            both[::2], both[1::2] = sa[i:i1], sb[j:j1]
            parts += both
        else:
            if i1 - i > 1:
                parts += [more_a[x] for x in a[i : i1 - 1]]
            parts.append(sa[i1 - 1])
            if j1 - j > 1:
                parts += [more_b[x] for x in b[j : j1 - 1]]
            parts.append(sb[j1 - 1])
        i, j = i1, j1
    return "".join(parts)[:-1]


def _coded(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte planes apart (they compress well)."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _decoded(coded: bytes) -> np.ndarray:
    planes = np.frombuffer(coded, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


_DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, stored: `row` (unique), id, token, group and link counts, hash of the groups, coded pairs.

    A pair is A id x size of the second vocabulary + B id; `times` holds uint32 numbers.
    """
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(first, second)
        row = TaskContext.get().partitionId() << 33
        types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        names = ["row", "doc_id", *(f.split()[0] for f in _DOCUMENT.split(", "))]
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(1).to_pylist()
                ids = iter(v.tokens([t for t in texts if t]))
                columns = zip(*(_document(v, *(next(ids) if t else ([], []))) for t in texts), strict=True)
                numbers = pa.array(np.arange(row, row + len(texts)))
                row += len(texts)
                yield pa.RecordBatch.from_arrays([numbers, part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return stored(rows.mapInArrow(run, f"row long, doc_id {id_type}, {_DOCUMENT}"))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a few texts, fewer where they are long."""
    sizes = np.cumsum(np.fromiter((len(t) if (t := x.as_py()) else 0 for x in batch.column(1)), np.int64, batch.num_rows))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, min(start + 256, int(np.searchsorted(sizes, before + PART_CHARS, side="right"))))
        yield batch.slice(start, end - start)
        start = end


def _document(v: Vocabularies, a: list[int], b: list[int]) -> tuple:
    if not a:
        return 0, 0, 0, 0, "", b"", b""
    found = align(list(accumulate(map(v.first_size.__getitem__, a))), list(accumulate(map(v.second_size.__getitem__, b))))
    left, right = links(found)
    pairs, times = np.unique(np.array(a)[left] * v.width + np.array(b)[right], return_counts=True)
    groups = len(left) - len(found.left) + len(found.straight) - sum(found.straight)
    digest = hashlib.sha256(spelled_groups(v, found, a, b).encode()).hexdigest()
    return len(a), len(b), groups, len(left), digest, _coded(pairs), times.astype("<u4").tobytes()


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, n): in how many documents of `aligned` each id pair is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            pairs, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], ["pair", "n"])

        for batch in batches:
            for coded in batch.column(0):
                held.append(_decoded(coded.as_py()))
                n += len(held[-1])
                if n >= COUNTED:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    partial = documents.select("pairs").where("n_links > 0").mapInArrow(count, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def link_sums(documents: DataFrame, counts: DataFrame, width: int, slices: int = SLICES, blocks_a_copy: int = BLOCKS_A_COPY) -> DataFrame:
    """(row, n_best, count_sum) for each document of `aligned` that has links."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        block = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            sizes = [len(p) for _, p, _ in held]
            pairs, times = np.concatenate([p for _, p, _ in held]), np.concatenate([t for _, _, t in held])
            places = np.repeat(np.arange(len(held)), sizes)
            home = pairs // width % slices
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(slices + 1))
            rows = np.array([r for r, _, _ in held], "<i8").tobytes()
            out = []
            for s in range(slices):
                mine = order[cuts[s] : cuts[s + 1]]
                if len(mine):
                    out.append((s, block, rows, places[mine].astype("<u2").tobytes(), pairs[mine].astype("<u4").tobytes(), times[mine].tobytes()))
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["slice", "block", "rows", "places", "pairs", "times"]
            )

        n = 0
        for batch in batches:
            for row, coded, times in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.append((row.as_py(), _decoded(coded.as_py()), np.frombuffer(times.as_py(), "<u4")))
                n += len(held[-1][1])
                if len(held) == BLOCK_DOCS or n >= COUNTED:
                    yield flush()
                    held, n, block = [], 0, (block + 7919) % (1 << 30)
        if held:
            yield flush()

    shape = "slice int, block int, rows binary, places binary, pairs binary, times binary"
    linked = documents.where("n_links > 0")
    blocks = linked.select("row", "pairs", "times").mapInArrow(deal, shape)
    # How many copies of a slice are needed so that none meets too many blocks.
    copies = max(1, -(-linked.count() // (BLOCK_DOCS * blocks_a_copy)))
    dealt = blocks.withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int")).withColumn("n", F.lit(None).cast("long"))
    header = counts.select(
        (F.floor(F.col("pair") / width) % slices).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        "pair",
        "n",
    )
    stream = dealt.withColumn("pair", F.lit(None).cast("long")).drop("block").unionByName(header, allowMissingColumns=True)
    # Rows with a pair are the counts of a slice; they come first.
    stream = stream.repartition("slice", "copy").sortWithinPartitions(F.col("slice"), F.col("copy"), F.col("pair").asc_nulls_last())
    names = ["slice", "copy", "pair", "n", "rows", "places", "pairs", "times"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        new: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = times = best = np.zeros(0, np.int64)
        for batch in batches:
            homes = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), len(homes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if at != homes[a]:
                    at, new = homes[a], []
                    pairs = np.zeros(0, np.int64)
                known = part.num_rows - part.column(2).null_count
                if known:
                    new.append((part.column(2).slice(0, known).to_numpy(), part.column(3).slice(0, known).to_numpy()))
                if known < part.num_rows and new:
                    pairs, times = (np.concatenate([x[i] for x in new]) for i in (0, 1))
                    new = []
                    # Pairs are sorted, so an A id is one run.
                    starts = np.flatnonzero(np.diff(pairs // width, prepend=-1))
                    best = np.repeat(np.maximum.reduceat(times, starts), np.diff([*starts, len(pairs)])) == times
                for i in range(known, part.num_rows):
                    rows, places, own, often = (part.column(c)[i].as_py() for c in (4, 5, 6, 7))
                    where = np.searchsorted(pairs, np.frombuffer(own, "<u4").astype(np.int64))
                    doc, often = np.frombuffer(places, "<u2"), np.frombuffer(often, "<u4").astype(np.int64)
                    ids = np.frombuffer(rows, "<i8")
                    n_best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                    np.add.at(n_best, doc, often * best[where])
                    np.add.at(total, doc, often * times[where])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n_best), pa.array(total)], ["row", "n_best", "count_sum"])

    sums = stream.select(*names).mapInArrow(fold, "row long, n_best long, count_sum long")
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignments(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of tokens, groups and links, and how usual its links are.

    `n_best` counts links whose pair is found in as many documents as any pair of the
    same A id; `count_sum` sums the document counts over all links.
    """
    documents = aligned(docs, first, second, doc_id, text)
    counts = keep(pair_counts(documents))
    sums = link_sums(documents, counts, vocabularies(first, second).width)
    slim = documents.drop("pairs", "times")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return slim.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
