"""Exact top-k inner products by a pivot-distance index.

The largest inner products are the nearest neighbours once every vector x gets one
more component sqrt(M^2 - |x|^2), M the largest norm, and every query a zero there:
|q - x|^2 = |q|^2 + M^2 - 2 q.x. In that space each vector is keyed by its nearest
pivot and its distance to it, and the keys are sorted in ranges; consecutive vectors
of one pivot form an annulus of at most ANNULUS rows with a least and a largest
distance. A pivot that holds a third of all rows is many annuli in many tasks.

A query is scored against its own annulus first; its k-th score there bounds the
radius that can still matter. By the triangle inequality an annulus [lo, hi] of pivot
p can hold a better vector only if d(q, p) - r <= hi and d(q, p) + r >= lo, and only
if d(q, p) - r <= d(q, p') + r for every pivot p' (its vectors are nearest to p).
Neighbouring annuli share a bin. Queries are sent once to each bin that may matter;
a task holds one bin and streams queries in batches, annuli expanding outward from
the nearest; the radius shrinks with each and the search stops where no bound allows
more. Scores are exact; the bounds have slack for rounding and only save work.

Defined results: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as padded with zeros; components are floor(64 x) as
doubles, and scores beyond 64 bits are held at the ends of that range; rows are told
apart by place, so repeated ids are queries and candidates of their own; ties go to
the smaller vec_id, null last, then in the order of storage; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .common import broadcast_if_light, keep, stored

# Pivots, and the bounded sample of rows they are chosen from (any choice is exact).
PIVOTS, SAMPLE = 64, 4_096
# Rows of an annulus, and of all annuli that one task holds.
ANNULUS, BIN = 1_024, 65_536
# Queries that meet one copy of a bin, and those scored at once.
QUERIES_A_COPY, BATCH = 65_536, 256
SLACK = 1e-9
# Up to this size sums of products of whole numbers are exact in doubles.
EXACT = float(1 << 53)
# Squared norms beyond this leave no room for bounds; then nothing is passed over.
TOO_LARGE = 1e290
NULL_ID = np.iinfo(np.int64).max


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in 2 bytes each where they fit, else as doubles; the first byte says which."""
    small = np.abs(x).max(initial=0) < 1 << 15
    return (b"\x02" + x.astype("<i2").tobytes()) if small else (b"\x08" + x.astype("<f8").tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i2" if blob[0] == 2 else "<f8", offset=1).astype("<f8")


def _matrix(blob: bytes, n: int) -> np.ndarray:
    x = _unpacked(blob)
    return x.reshape(n, len(x) // max(n, 1))


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        exact = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
        return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return (q @ x.T).astype(np.int64)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """The extra component that makes all norms equal."""
    return np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to pivots that have the extra component in their last place."""
    head, last = pivots[:, :-1], pivots[:, -1]
    squares = (np.einsum("ij,ij->i", x, x) + extra**2)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :]
    return np.sqrt(np.maximum(squares - 2 * (x @ head.T + extra[:, None] * last[None, :]), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first centres, then three rounds of means."""
    chosen = [0]
    away = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    pivots = sample[chosen].copy()
    for _ in range(3):
        home = _distances(sample[:, :-1], sample[:, -1], pivots).argmin(axis=1)
        for p in np.unique(home):
            pivots[p] = sample[home == p].mean(axis=0)
    return pivots


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Stored rows (row, vec_id, v) of the vectors that take part; `v` holds floor(64 x)."""
    rows = spread(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")))
    last = np.finfo("<f8").max

    def whole(x: pa.ListScalar) -> bytes | None:
        if not x.is_valid or x.values.null_count:
            return None
        values = x.values.to_numpy(zero_copy_only=False)
        if not np.isfinite(values).all():
            return None
        with np.errstate(over="ignore"):
            return _packed(np.clip(np.floor(64 * values), -last, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            blobs = pa.array([whole(x) for x in batch.column(1)], pa.binary())
            rows_ = pa.array(np.arange(row, row + len(blobs)))
            row += len(blobs)
            yield pa.RecordBatch.from_arrays([rows_, batch.column(0), blobs], ["row", "vec_id", "v"]).filter(blobs.is_valid())

    return stored(rows.mapInArrow(run, "row long, vec_id long, v binary"))


def _top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, smaller id (null last), earlier row."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((rows[near], ids[near], ~scores[near]))][:k]


class _Index:
    """What a task needs to key vectors: pivots, the largest squared norm, the number of components."""

    def __init__(self, pivots: np.ndarray, most: float, dims: int) -> None:
        self.pivots, self.most, self.dims = pivots, most, dims
        self.scale = SLACK * (1 + np.sqrt(most) + np.abs(pivots).max(initial=0))

    def padded(self, blobs: list[bytes]) -> np.ndarray:
        out = np.zeros((len(blobs), self.dims))
        for i, b in enumerate(blobs):
            v = _unpacked(b)
            out[i, : len(v)] = v
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of vectors; where numbers are too large to tell, infinite."""
        with np.errstate(all="ignore"):
            return np.nan_to_num(_distances(x, _lifted(x, self.most), self.pivots), nan=np.inf, posinf=np.inf)

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.nan_to_num(_distances(q, np.zeros(len(q)), self.pivots), nan=0.0, posinf=0.0)

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far a vector that beats or ties `score` may be from each query."""
        if self.most > TOO_LARGE:
            return np.full(len(q), np.inf)
        with np.errstate(all="ignore"):
            r = np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q) + self.most - 2 * score, 0)) * (1 + SLACK) + self.scale
        return np.where(np.isfinite(r), r, np.inf)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = [_unpacked(b.as_py()) for b in batch.column(0)]
            with np.errstate(over="ignore"):
                most = max(float(v @ v) for v in vectors)
            yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([max(map(len, vectors))], pa.int64())], ["most", "dims"])


def fit_index(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> _Index | None:
    """Norm and size over all rows; pivots from a bounded sample of them, the same on each run."""
    most, dims = rows.select("v").mapInArrow(_measures, "most double, dims long").agg(F.max("most"), F.max("dims")).first()
    if most is None:
        return None
    taken = rows.select("v").orderBy(F.xxhash64("v"), "row").limit(sample).collect()
    x = _Index(np.zeros((1, dims + 1)), 0.0, dims).padded([bytes(r["v"]) for r in taken])
    with np.errstate(all="ignore"):
        lifted = np.hstack([x, _lifted(x, most)[:, None]])
        usable = np.einsum("ij,ij->i", lifted, lifted) <= TOO_LARGE
    centres = choose_pivots(lifted[usable], pivots) if usable.any() else np.zeros((1, dims + 1))
    return _Index(centres, most, dims)


_ANNULUS = {
    "bin": "long", "pivot": "int", "lo": "double", "hi": "double", "n": "long", "ids": "binary", "rows": "binary", "vectors": "binary",
    "q_n": "long", "q_ids": "binary", "q_rows": "binary", "q_vectors": "binary", "q_kth": "binary",
}


def annuli(rows: DataFrame, index: _Index, is_query: Column, k: int, annulus: int = ANNULUS, per_bin: int = 64) -> DataFrame:
    """Stored annuli in bins, with the queries among their rows and those queries' k-th scores inside."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = index.distances(index.padded([b.as_py() for b in batch.column(2)]))
            home = d.argmin(axis=1)
            columns = [*batch.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "pivot", "d"])

    keyed = rows.select("row", "vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("query"))
    keyed = keyed.mapInArrow(key, "row long, vec_id long, v binary, query boolean, pivot int, d double")
    dealt = keyed.repartitionByRange("pivot", "d", "row").sortWithinPartitions("pivot", "d", "row")

    def annulus_of(held: list[pa.RecordBatch], bin_: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, places, d = t["vec_id"].fill_null(NULL_ID).to_numpy(), t["row"].to_numpy(), t["d"].to_numpy()
        x = index.padded([b.as_py() for b in t["v"]])
        asks = np.flatnonzero(t["query"].to_numpy())
        kth = np.full(len(asks), -np.inf)
        if len(asks) and len(x) > k:
            scores = _scores(x[asks], x)
            scores[np.arange(len(asks)), asks] = -(1 << 63)
            kth = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k].astype("<f8")
        row = [bin_, t["pivot"][0].as_py(), float(d[0]), float(d[-1]), len(x), ids.tobytes(), places.tobytes(), _packed(x)]
        row += [len(asks), ids[asks].tobytes(), places[asks].tobytes(), _packed(x[asks]), kth.tobytes()]
        types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([v], types[y]) for v, y in zip(row, _ANNULUS.values(), strict=True)], list(_ANNULUS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, pivot, made = 0, None, 0
        first = TaskContext.get().partitionId() << 20
        for batch in batches:
            home = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if n and (home[a] != pivot or n == annulus):
                        yield annulus_of(held, first + made // per_bin)
                        held, n, made = [], 0, made + 1
                    pivot, take = home[a], min(b - a, annulus - n)
                    held.append(batch.slice(a, take))
                    n, a = n + take, a + take
        if n:
            yield annulus_of(held, first + made // per_bin)

    return stored(dealt.mapInArrow(gather, ", ".join(f"{c} {t}" for c, t in _ANNULUS.items())))


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = PIVOTS,
    sample: int = SAMPLE,
    annulus: int = ANNULUS,
    bin_rows: int | None = None,
    queries_a_copy: int = QUERIES_A_COPY,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest scores of each query row over all other rows.

    `is_query` is a condition on `vec_id`.
    """
    rows = whole_vectors(vectors, vec_id, embedding)
    index = fit_index(rows, pivots, sample)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if bin_rows is None:
        # Enough bins to keep all cores busy, and none beyond a bounded size.
        bin_rows = min(BIN, rows.count() // (2 * rows.sparkSession.sparkContext.defaultParallelism))
    found = annuli(rows, index, is_query, k, annulus, max(1, bin_rows // annulus))
    asked = found.agg(F.sum("q_n")).first()[0]
    return _search(found, index, k, max(1, -(-asked // queries_a_copy)))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, ids, vectors and k-th scores of the queries of each annulus."""
    for batch in batches:
        for n, ids, rows, x, kth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield _longs(rows), _longs(ids), _matrix(x, n), np.frombuffer(kth, "<f8")


def _search(found: DataFrame, index: _Index, k: int, copies: int) -> DataFrame:
    """Queries meet the bins that may matter to them; the best of each bin are merged."""
    queried = found.where("q_n > 0").select("q_n", "q_ids", "q_rows", "q_vectors", "q_kth")

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query the interval of distances that can matter around each pivot."""
        for rows, _, x, kth in _asked(batches):
            d, r = index.query_distances(x), index.radius(x, kth)[:, None]
            q, p = np.nonzero(d - r <= d.min(axis=1, keepdims=True) + r)
            columns = [pa.array(rows[q]), pa.array(p.astype(np.int32)), pa.array((d - r)[q, p]), pa.array((d + r)[q, p])]
            yield pa.RecordBatch.from_arrays(columns, ["q_row", "pivot", "low", "high"])

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, x, kth in _asked(batches):
            columns = [pa.array(rows), pa.array(ids), pa.array([_packed(v) for v in x], pa.binary()), pa.array(kth)]
            yield pa.RecordBatch.from_arrays(columns, ["q_row", "q_id", "q", "kth"])

    # One row per bin and pivot: a bin has thousands of vectors, and its range of distances.
    spans = keep(found.groupBy("bin", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    intervals = queried.mapInArrow(reaches, "q_row long, pivot int, low double, high double")
    meets = intervals.join(broadcast_if_light(spans, F.lit(28)), "pivot").where("low <= hi AND high >= lo")
    sent = meets.select("q_row", "bin").distinct().join(queried.mapInArrow(queries, "q_row long, q_id long, q binary, kth double"), "q_row")
    sent = sent.withColumn("copy", F.pmod(F.xxhash64("q_row"), F.lit(copies)).cast("int"))
    blocks = found.select("bin", "pivot", "lo", "hi", "n", "ids", "rows", "vectors", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    order = ["bin", "copy", "pivot", "lo", "hi", "n", "ids", "rows", "vectors", "q_row", "q_id", "q", "kth"]
    stream = blocks.unionByName(sent, allowMissingColumns=True).select(*order)
    # Annuli have no query row, so they come before the queries of their bin.
    stream = stream.repartition("bin", "copy").sortWithinPartitions("bin", "copy", "q_row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            homes = (batch.column(0).to_numpy() << 20) + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), len(homes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at != homes[a]:
                    at, held = homes[a], []
                part = batch.slice(a, b - a)
                known = part.column(order.index("q_row")).null_count
                for pivot, lo, hi, n, ids, rows, x in zip(*(part.column(c).slice(0, known).to_pylist() for c in range(2, 9)), strict=True):
                    held.append((pivot, lo, hi, _longs(ids), _longs(rows), _matrix(x, n)))
                for i in range(known, part.num_rows, BATCH):
                    rows, ids, x, kth = part.slice(i, BATCH).columns[9:]
                    yield _answer(index, held, k, rows.to_numpy(), ids.to_numpy(), index.padded(x.to_pylist()), kth.to_numpy())

    best = stream.mapInArrow(search, "q_row long, query_id long, vec_id long, v_row long, score long")
    ranked = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "v_row")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answer(index: _Index, held: list, k: int, q_rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
    """The best of one bin for a batch of queries, annuli taken outward from the queries."""
    none, kth = np.zeros(0, np.int64), kth.copy()
    best = [(none, none, none)] * len(q)
    d = index.query_distances(q)[:, [h[0] for h in held]]
    # Least distance that the triangle inequality leaves to each annulus.
    bound = np.maximum(np.maximum(d - np.array([h[2] for h in held]), np.array([h[1] for h in held]) - d), 0)
    r = index.radius(q, kth)
    for h in np.argsort(bound.min(axis=0), kind="stable"):
        near = np.flatnonzero(bound[:, h] <= r)
        if not len(near):
            continue
        _, _, _, ids, rows, x = held[h]
        for i, s in zip(near, _scores(q[near], x), strict=True):
            good = np.flatnonzero((s >= kth[i]) & (rows != q_rows[i]))
            if len(good):
                found = tuple(np.concatenate(z) for z in zip(best[i], (s[good], ids[good], rows[good]), strict=True))
                top = _top(*found, k)
                best[i] = tuple(c[top] for c in found)
                if len(top) == k:
                    kth[i] = max(kth[i], float(found[0][top[-1]]))
        r = index.radius(q, kth)
    sizes = [len(b[0]) for b in best]
    scores, ids, rows = (np.concatenate([b[c] for b in best]) for c in range(3))
    columns = [np.repeat(q_rows, sizes), np.repeat(q_ids, sizes), pa.array(ids, mask=ids == NULL_ID), rows, scores]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["q_row", "query_id", "vec_id", "v_row", "score"])
