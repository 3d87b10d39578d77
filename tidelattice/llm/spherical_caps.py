"""Embedding near duplicates by spherical-cap filters.

A filter is a direction made of one code word per half of the vector; the code words
are random, so the 2,048 x 2,048 directions are a structured random product code. A
vector falls into every filter whose direction it exceeds by the cap height. The two
halves are scored separately (4,096 products) and the product code is list-decoded:
for each first word, in order, the sorted second words that still reach the height.
Close vectors share a cap almost surely, unrelated ones almost never; vectors of one
label that share a filter are verified by their cosine in double precision.

Equal vectors of a label are one node, so copies never pair. A pair that shares
several filters is counted in the smallest of them. A filter with many members is
cut into blocks and pairs of blocks are separate tasks, which return counts and one
link per vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .graph import components

COSINE = 0.98
CODE_WORDS = 2048
# Mean number of filters of a random vector; the cap height follows from it.
FILTERS = 96
# A vector that exceeds fewer filters than this takes its highest ones instead.
LEAST_FILTERS = 24
BLOCK = 512
SEED = 11


@lru_cache(maxsize=8)
def code(dims: int, words: int = CODE_WORDS, filters: float = FILTERS) -> tuple[np.ndarray, np.ndarray, float]:
    """Code words of both halves and the height that a random vector exceeds `filters` times."""
    rng = np.random.default_rng([SEED, dims])
    halves = []
    for width in (dims - dims // 2, dims // 2):
        c = rng.standard_normal((words, max(width, 1)))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    if dims < 2:
        halves[1][:] = 0
    x = rng.standard_normal((8, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.concatenate([np.add.outer(a, b).ravel() for a, b in zip(*_scores(x, halves[0], halves[1]))])
    rank = min(len(scores) - 1, max(1, int(len(scores) * filters / words**2)))
    return halves[0], halves[1], float(-np.partition(-scores, rank)[rank])


def _scores(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] - x.shape[1] // 2
    right = x[:, cut:] if x.shape[1] > 1 else np.zeros((len(x), 1))
    return x[:, :cut] @ first.T, right @ second.T


def decode(x: np.ndarray) -> list[np.ndarray]:
    """All filters that each unit vector exceeds, LEAST_FILTERS at least, as sorted numbers."""
    first, second, height = code(x.shape[1])
    out = []
    for a, b in zip(*_scores(x, first, second)):
        order = np.argsort(-b, kind="stable")
        falling = -b[order]
        heads = np.flatnonzero(a >= height + falling[0])
        counts = np.searchsorted(falling, a[heads] - height, side="right")
        if counts.sum() < LEAST_FILTERS:
            # The best sums are among the best words of both halves.
            heads, tails = np.argsort(-a, kind="stable")[:LEAST_FILTERS], order[:LEAST_FILTERS]
            best = np.argsort(-np.add.outer(a[heads], b[tails]).ravel(), kind="stable")[:LEAST_FILTERS]
            out.append(np.sort(heads[best // len(tails)] * len(second) + tails[best % len(tails)]).astype(np.int32))
            continue
        tails = np.concatenate([order[:c] for c in counts])
        out.append(np.sort(np.repeat(heads, counts) * len(second) + tails).astype(np.int32))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _emit_filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, label, dims, vec = (batch.column(i) for i in range(4))
        sizes = dims.to_numpy()
        for d in np.unique(sizes):
            chosen = pa.array(np.flatnonzero(sizes == d))
            found = decode(unit(_matrix(vec.take(chosen))))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            columns = [node.take(chosen), label.take(chosen), dims.take(chosen), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "dims", "filters"])


def verify(x: np.ndarray, node: np.ndarray, copies: np.ndarray, filters: list[np.ndarray], here: int, side: np.ndarray | None, cosine: float) -> list[tuple[int, int, int]]:
    """(node, linked rows, smallest node of its local component) of one filter or pair of blocks.

    `side` tells the two blocks apart; without it all pairs count. Only pairs without a
    smaller common filter than `here` are counted.
    """
    close = x @ x.T >= cosine
    np.fill_diagonal(close, False)
    if side is not None:
        close &= side[:, None] != side[None, :]
    some = np.flatnonzero(close.any(axis=1))
    if not len(some):
        return []
    close = close[np.ix_(some, some)]
    earlier = [filters[i][filters[i] < here] for i in some]
    flat = np.concatenate(earlier)
    if len(flat):
        _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(some)), [len(e) for e in earlier])
        shared = counts[at] > 1
        if shared.any():
            _, column = np.unique(at[shared], return_inverse=True)
            seen = np.zeros((len(some), column.max() + 1), dtype=np.float32)
            seen[row[shared], column] = 1
            close &= (seen @ seen.T) == 0
    links = close @ copies[some].astype(np.int64)
    # Smallest node by spreading it along links until nothing changes.
    least = node[some].copy()
    big = np.iinfo(np.int64).max
    while True:
        spread = np.minimum(least, np.where(close, least[None, :], big).min(axis=1))
        if (spread == least).all():
            break
        least = spread
    return [(int(n), int(k), int(m)) for n, k, m in zip(node[some], links, least) if k]


def _verified(cosine: float):
    names = ["label", "dims", "filter", "bi", "bj"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        out: list[tuple[int, int, int]] = []

        def close_group() -> None:
            rows = pa.Table.from_batches(open_rows).combine_chunks()
            get = lambda n: rows.column(n).combine_chunks()
            bi, bj = get("bi")[0].as_py(), get("bj")[0].as_py()
            side = None if bi == bj else get("b").to_numpy()
            lists = get("filters")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            filters = [flat[a:b] for a, b in zip(ends, ends[1:])]
            out.extend(
                verify(unit(_matrix(get("vec"))), get("node").to_numpy(), get("copies").to_numpy(), filters, get("filter")[0].as_py(), side, cosine)
            )

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["node", "links", "hub"])

        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))
            start = 0
            for i, k in enumerate(keys):
                if k != last:
                    if i > start:
                        open_rows.append(batch.slice(start, i - start))
                    if open_rows:
                        close_group()
                        open_rows.clear()
                    start, last = i, k
            if len(keys) > start:
                open_rows.append(batch.slice(start))
            if len(out) >= 10_000:
                yield flushed()
        if open_rows:
            close_group()
        yield flushed()

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Only rows with equal labels are compared. A null label, a null or zero vector and
    a vector with null or non-finite components link with nothing; such a row is its
    own component. Vectors of different lengths are never linked. Repeated rows link
    with each other. A null id is never a component's id unless all its ids are null.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
    good = (
        F.col("label").isNotNull()
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vec", lambda v: v != 0)
    )
    rows = keep(rows.withColumn("ok", F.coalesce(good, F.lit(False))))
    classes = keep(
        rows.where("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )
    # Numbers follow from the checkpointed partitions, so a retried task gives the same ones.
    nodes = classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("vec"))
    label_type = nodes.schema["label"].dataType.simpleString()
    caps = keep(
        nodes.select("node", "label", "dims", "vec").mapInArrow(_emit_filters, f"node long, label {label_type}, dims int, filters array<int>")
    )
    keyed = caps.select("node", "label", "dims", F.explode("filters").alias("filter"))
    shared = keyed.groupBy("label", "dims", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = keep(keyed.join(shared, ["label", "dims", "filter"]))
    # A vector's filters number a few dozen: the list is bounded by the code.
    own = live.groupBy("node").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    known = own.join(nodes.select("node", "vec", "copies"), "node")
    blocks = F.ceil(F.col("n") / block).cast("int")
    cells = (
        live.join(known, "node")
        .withColumn("b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("label", "dims", "filter", F.least("b", "_o").alias("bi"), F.greatest("b", "_o").alias("bj"), "b", "node", "copies", "vec", "filters")
    )
    cell = ["label", "dims", "filter", "bi", "bj"]
    found = keep(cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_verified(cosine), "node long, links long, hub long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    rooted = keep(
        nodes.select("node", "label", "vec", "least", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("label", "vec", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = rooted.join(named, "root").select("label", "vec", "n_links", "component_id")
    linked = rows.where("ok").join(per_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
