"""Near copies by the Jaccard similarity of 5-word shingles: SimHash first, then minwise bands.

Texts with equal shingle sets are one node. Candidates come from three sources, and
every one is verified on the real shingles before it links anything:

1. SimHash fingerprints of the 5-word shingles within 2 bits (`simhash.close_links`),
   and nodes of one fingerprint.
2. Each node has 24 keys of 6 minwise hashes: a pair of similarity 0.8 shares a key
   with probability 0.9993, closer pairs with more. Keys of at most PAIRWISE nodes give
   their pairs.
3. Keys that more nodes share (a family of near copies) take hubs in rounds: each
   key's hub of a round is drawn by a hash, so a node meets up to 24 hubs a round, and
   only nodes in other components than the hub are compared. Keys that still hold
   several components are finished exactly: the nodes outside a key's largest component
   are held in chunks, and all nodes of the key stream past them.

A comparison never carries two texts. The hashes of a node travel once to a group, cut
into parts of bounded size; a group holds one hub (or a chunk of nodes) and streams the
others, so memory is bounded however long the texts or large the families are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_light, keep, stored
from .graph import components
from .simhash import close_links, fingerprint

WIDTH = 5
# Similarity of near copies as a fraction.
SHARED, OF = 4, 5
BANDS, ROWS = 24, 6
# Nodes of a key that are compared pair by pair at once.
PAIRWISE = 32
# Rounds of hubs before the exact end.
ROUNDS = 2
# Nodes that a group holds, nodes that stream past one group, hashes of one row.
HELD, STREAMED, PART = 128, 2048, 512
# Texts of a task that are remembered so that their copies are sketched once.
REMEMBERED = 200_000
# Rows of a batch that are Python objects at once.
_SLICE = 256
_STEP = 4096
_RANDOM = np.random.default_rng(42)
_FACTORS, _TERMS = _RANDOM.integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh3_64_intdigest
    found = [digest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.array(found, dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed key per band."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (hashes[at : at + _STEP, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column was not met in this task lately: a hint, never a promise."""
    seen: set[bytes] = set()
    for batch in batches:
        mask = []
        for t in batch.column(0).to_pylist():
            mask.append(t not in seen)
            seen.add(t)
        yield batch.filter(pa.array(mask, pa.bool_()))
        if len(seen) > REMEMBERED:
            seen.clear()


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _once(batches):
        nodes, sizes, prints, keys = [], [], [], []
        for t in batch.column(1):
            text = t.as_py()
            h = shingles(text)
            nodes.append(node_of(h))
            sizes.append(len(h))
            f = fingerprint(text, WIDTH)
            prints.append(f - (1 << 64) if f >> 63 else f)
            keys.append(band_keys(h))
        columns = [batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["t", "node", "size", "print", "keys"])


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _once(batches):
        for at in range(0, batch.num_rows, 64):
            rows = []
            for t in batch.column(1).slice(at, 64):
                h = shingles(t.as_py())
                node = node_of(h)
                rows += [(node, i, h[p : p + PART].tobytes()) for i, p in enumerate(range(0, len(h), PART))]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            types = (pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(columns, types, strict=True)], names=["node", "part", "hashes"])


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored (node, part, hashes) of the texts (t, text) whose key is wanted (t)."""
    light = broadcast_if_light(keep(wanted), F.lit(16))
    return stored(texts.join(light, "t").mapInArrow(_parts, "node binary, part int, hashes binary").dropDuplicates(["node", "part"]))


class _Group:
    """Sets that are held, and the links of sets that stream past them."""

    def __init__(self) -> None:
        self.nodes: list[bytes] = []
        self.roots: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.index: tuple | None = None
        self.linked: set[tuple[int, bytes]] = set()

    def hold(self, node: bytes, root: bytes, hashes: np.ndarray) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(hashes)
        self.index = None

    def links(self, node: bytes, root: bytes, hashes: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        if not self.sets:
            return
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets])
            joined, owners = np.concatenate(self.sets), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(joined, kind="stable")
            self.index = joined[order], owners[order], sizes
        values, owners, sizes = self.index
        low, high = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
        found = high - low
        places = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
        both = np.bincount(owners[places], minlength=len(sizes))
        for i in np.flatnonzero(OF * both >= SHARED * (len(hashes) + sizes - both)):
            # One link to each other component is enough.
            if self.roots[i] != root and (i, root) not in self.linked:
                self.linked.add((i, root))
                yield self.nodes[i], node


def _grouped_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (g, kind, node, root, part, hashes) in order; rows of kind 0 are held, the others stream."""
    group, at, now, parts = _Group(), None, None, []

    def close() -> list[tuple[bytes, bytes]]:
        if now is None:
            return []
        _, kind, node, root = now
        hashes = np.frombuffer(b"".join(parts), np.uint64)
        if kind == 0:
            group.hold(node, root, hashes)
            return []
        return list(group.links(node, root, hashes))

    def batch_of(out: list) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    slices = (b.slice(at, _SLICE) for b in batches for at in range(0, b.num_rows, _SLICE))
    for batch in slices:
        out: list[tuple[bytes, bytes]] = []
        for g, kind, node, root, _, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (g, kind, node, root) != now:
                out += close()
                if g != at:
                    group, at = _Group(), g
                now, parts = (g, kind, node, root), []
            parts.append(hashes)
        yield batch_of(out)
    yield batch_of(close())


def _compared(held: DataFrame, streamed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between held and streamed rows (g, node, root) of each group."""
    rows = held.withColumn("kind", F.lit(0)).unionByName(streamed.withColumn("kind", F.lit(1)))
    rows = rows.join(sets, "node").select("g", "kind", "node", "root", "part", "hashes")
    dealt = rows.repartition("g").sortWithinPartitions("g", "kind", "node", "root", "part")
    return dealt.mapInArrow(_grouped_links, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are near copies; a node with many partners is split over groups."""
    pairs = keep(pairs.select("a", "b").distinct())
    fan = keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STREAMED).cast("int").alias("slices")))
    light = broadcast_if_light(fan, F.lit(20))
    held = fan.select(F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "a")
    held = held.select(F.xxhash64("a", "slice").alias("g"), F.col("a").alias("node"), F.col("a").alias("root"))
    streamed = pairs.join(light, "a").select(
        F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int")).alias("g"), F.col("b").alias("node"), F.col("b").alias("root")
    )
    return keep(_compared(held, streamed, sets))


def finished(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between components of each key (key, node, root), without a row per pair.

    Of a pair of different components one is outside the key's largest: those nodes
    are held, chunk by chunk, and all nodes of the key stream past each chunk.
    """
    by_root = open_.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    plan = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("in_most"))
    plan = plan.select("key", "most", F.ceil((F.col("n") - F.col("in_most")) / HELD).cast("int").alias("chunks"), F.ceil(F.col("n") / STREAMED).cast("int").alias("slices"))
    rows = open_.join(broadcast_if_light(keep(plan), F.lit(40)), "key")

    def dealt(column: str, count: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(column)), F.col(count)).cast("int")

    def all_of(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    held = rows.where("root != most").withColumn("chunk", dealt("chunk", "chunks")).withColumn("slice", all_of("slices"))
    streamed = rows.withColumn("slice", dealt("slice", "slices")).withColumn("chunk", all_of("chunks"))
    group = F.xxhash64("key", "chunk", "slice").alias("g")
    return keep(_compared(held.select(group, "node", "root"), streamed.select(group, "node", "root"), sets))


def _of_like_size() -> Column:
    return F.least("x.size", "y.size") * OF >= F.greatest("x.size", "y.size") * SHARED


def _open_keys(many: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, node, size, root) of keys that hold several components."""
    rooted = many.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("key")
    return keep(rooted.join(mixed, "key").select("key", "node", "size", "root"))


def _hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): the hub of each key in this turn and the key's nodes of other components."""
    hubs = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("draw"), "node", "root", "size")).alias("y"))
    met = rows.alias("x").join(hubs, "key").select("x.*", F.col("y.node").alias("hub"), F.col("y.root").alias("hub_root"), F.col("y.size").alias("hub_size"))
    like = F.least("size", "hub_size") * OF >= F.greatest("size", "hub_size") * SHARED
    return met.where((F.col("root") != F.col("hub_root")) & like).select(F.col("hub").alias("a"), F.col("node").alias("b"))


def near_copies(docs: DataFrame, text: str = "text", pairwise: int = PAIRWISE, rounds: int = ROUNDS) -> DataFrame:
    """(t, root): one row per distinct `text_key` of `docs`; near copies share a root.

    Roots are components over pairs with a Jaccard similarity of 0.8 or more. Null,
    empty and blank texts are one node; texts of fewer than five words are one shingle.
    Repeated rows count once. An empty table gives an empty result.
    """
    texts = docs.select(text_key(text).alias("t"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sketches = stored(texts.mapInArrow(_sketches, "t binary, node binary, size long, print long, keys array<long>"))
    nodes = stored(sketches.groupBy("node").agg(F.min("t").alias("t"), F.min("size").alias("size"), F.min("print").alias("print"), F.min("keys").alias("keys")))

    first = keep(nodes.groupBy("print").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")))
    close = close_links(first.select(F.col("print").alias("f")))
    reps = first.select(F.col("print").alias("f"), F.col("a").alias("rep"))
    far = close.join(reps.withColumnRenamed("f", "a").withColumnRenamed("rep", "x"), "a").join(reps.withColumnRenamed("f", "b").withColumnRenamed("rep", "y"), "b")
    pairs = far.select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.select("node", "print").join(first.where("n > 1").select("print", "a"), "print").where("node != a")
    pairs = pairs.unionByName(same.select("a", F.col("node").alias("b")))

    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keep(keyed.join(shared, "key"))
    few, many = met.where(F.col("n") <= pairwise), met.where(F.col("n") > pairwise).select("key", "node", "size")
    couples = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _of_like_size())
    pairs = pairs.unionByName(couples.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    pairs = keep(pairs.unionByName(_hub_pairs(many.withColumn("root", F.col("node")), 0)).distinct())

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(many.select("node")).distinct()
    sets = shingle_sets(texts, nodes.join(wanted, "node").select("t"))
    found = components(verified(pairs, sets))
    for turn in range(1, rounds + 1):
        open_ = _open_keys(many, found)
        if open_.isEmpty():
            break
        more = verified(_hub_pairs(open_, turn), sets) if turn < rounds else finished(open_, sets)
        if not more.isEmpty():
            # A component is the star of its nodes by now; its links need not be gone through again.
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return keep(sketches.select("t", "node").distinct().join(found, "node", "left").select("t", F.coalesce("root", "node").alias("root")))
