"""Quality by nearest-neighbour voting in a latent-semantic space.

Words, word shapes and layout of a text are hashed into a weighted vector. A
truncated singular value decomposition of the labelled sample gives the latent
space. The labelled vectors (at most `sample` rows) are broadcast; every document
is compared with all of them by exact cosine products, block by block, and its
nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import labelled_sample

SAMPLE = 4000
WORD_DIMS, SHAPE_DIMS, LAYOUT_DIMS = 4096, 512, 128
LATENT = 64
NEIGHBOURS = 25
BLOCK = 256
SHARPNESS = 8
# Weight of each part of the vector.
PARTS = (0.5, 1.0, 0.5)
_TABLE_ROWS = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Runs of letters as a (A if all upper case), of digits as 0, of a mark as one mark."""
    word = _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return _RUNS.sub(r"\1", _DIGITS.sub("0", word))[:12]


class Features:
    """Hashed, weighted counts of one text; a bounded table remembers words."""

    dims = WORD_DIMS + SHAPE_DIMS + LAYOUT_DIMS

    def __init__(self) -> None:
        self.table: dict[str, tuple[int, int]] = {}

    def _places(self, word: str) -> tuple[int, int]:
        if len(self.table) >= _TABLE_ROWS:
            self.table.clear()
        plain = word.lower().encode()
        places = zlib.crc32(plain) % WORD_DIMS, WORD_DIMS + zlib.crc32(shape(word).encode()) % SHAPE_DIMS
        self.table[word] = places
        return places

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        counts = Counter(words)
        n = len(words)
        out = np.zeros(self.dims, dtype=np.float32)
        if not n:
            return out
        get = self.table.get
        places = np.array([get(w) or self._places(w) for w in counts], dtype=np.int64)
        times = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
        out[:WORD_DIMS] = np.bincount(places[:, 0], times, WORD_DIMS)
        out[WORD_DIMS : WORD_DIMS + SHAPE_DIMS] = np.bincount(places[:, 1] - WORD_DIMS, times, SHAPE_DIMS)
        lines = text.split("\n")
        chars = sum(len(w) * c for w, c in counts.items())
        layout = (
            int(2 * math.log2(1 + n)),
            int(4 * math.log2(1 + n / len(lines))),
            min(24, int(2 * chars / n)),
            int(12 * len(counts) / n),
            int(10 * (1 - len(set(lines)) / len(lines))),
        )
        for i, v in enumerate(layout):
            out[WORD_DIMS + SHAPE_DIMS + zlib.crc32(b"%d %d" % (i, v)) % LAYOUT_DIMS] += 1
        return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of shares per part, inverse document frequency, unit length per part."""
    x = np.sqrt(counts)
    x *= idf
    at = 0
    for dims, part in zip((WORD_DIMS, SHAPE_DIMS, LAYOUT_DIMS), PARTS):
        block = x[:, at : at + dims]
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        block *= part / np.where(norm > 0, norm, 1)
        at += dims
    return x


@dataclass(slots=True)
class Voter:
    """Latent space and the labelled vectors in it; plain arrays of bounded size."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return self.place(_weigh(counts, self.idf))

    def place(self, weighed: np.ndarray) -> np.ndarray:
        z = weighed @ self.basis
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def vote(self, z: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, by similarity; the prior where nothing is similar."""
        if not len(self.labels):
            return np.full(len(z), self.prior)
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1) ** SHARPNESS
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight * self.labels[near]).sum(axis=1) / np.where(total > 1e-9, total, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Voter:
    """Learn from at most `sample` labelled rows of the training folds.

    Texts become counts of fixed width on the executors; the driver gets at most
    `sample` rows of them. Without labelled rows every score is one half.
    """
    rows = labelled_sample(docs, labels, label, folds, fold, sample, doc_id, text)

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        features = Features()
        found = [features(t) for t in texts]
        return pd.Series([np.stack([np.flatnonzero(x), x[x > 0].astype(np.int64)]).astype(np.int32).ravel() for x in found])

    # Arrow columns, not rows: the driver holds no Python object per count.
    got = rows.select("doc_id", "y", places("text").alias("x")).toArrow()
    ids, found = got["doc_id"].to_pylist(), got["x"]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    counts = np.zeros((len(ids), Features.dims), dtype=np.float32)
    for i, at in enumerate(order):
        at_dims, times = found[at].values.to_numpy().reshape(2, -1)
        counts[i, at_dims] = times
    y = got["y"].to_numpy()[order].astype(np.float64)
    del got, found
    return _learn(counts, y)


def learn(counts: np.ndarray, y: np.ndarray) -> Voter:
    """The voter of labelled counts."""
    return _learn(counts.copy(), y)


def _learn(x: np.ndarray, y: np.ndarray) -> Voter:
    """The same in the place of the counts, some rows at a time, so that the driver holds them once."""
    n = len(x)
    idf = np.log((1 + n) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 0.1
    for at in range(0, n, BLOCK):
        x[at : at + BLOCK] = _weigh(x[at : at + BLOCK], idf)
    width = min(LATENT, *x.shape) if n else 1
    q = np.random.default_rng(1).standard_normal((Features.dims, width + 16)).astype(np.float32)
    for _ in range(3):  # subspace iteration
        q = np.linalg.qr(x.T @ (x @ q))[0] if n else q
    basis = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :width] if n else q[:, :width]
    voter = Voter(idf, basis.astype(np.float32), np.zeros((0, width), np.float32), y, float(y.mean()) if len(y) else 0.5)
    voter.vectors = voter.place(x)
    return voter


def score(voter: Voter) -> Callable[[Column], Column]:
    """Scores in [0, 1] of a text column, one per row; null and empty texts get the prior."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for texts in batches:
            out = []
            for start in range(0, len(texts), BLOCK):
                block = np.stack([features(t or "") for t in texts.iloc[start : start + BLOCK]])
                out.append(voter.vote(voter.project(block)))
            yield pd.Series(np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0), dtype="float64")

    return scored
