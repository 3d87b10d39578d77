"""Toxicity by a factorization machine over hashed terms.

The score of a text with terms i is sigmoid(b + sum w_i + sum over pairs <v_i, v_j>):
the second sum learns pairs such as an insult together with a group, which additive
weights cannot. It costs no more than a linear model, since the sum over pairs is
half of |sum v_i|^2 - sum |v_i|^2.

Null and empty texts get the bias alone, as does every text where nothing was learned.
A very long text counts each of its terms once, however often it occurs. Repeated rows
are scored alike; an empty table gives no rows; no column but the text is read, so
extra columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import labelled_sample

SAMPLE = 12_000
HASH_SPACE = 1 << 22
# A term is kept if it is in so many sampled documents and either its frequency differs
# between the classes by so many standard errors or it is in so large a share of them.
LEAST_DOCS, LEAST_ERRORS, COMMON = 3, 5.0, 0.2
# Two terms that say little on their own are kept if they meet in so many toxic documents and
# toxic ones are so many standard errors more frequent where they meet. A term of a telling
# pair is itself more frequent in toxic documents, by at least so many errors.
PAIR_DOCS, PAIR_ERRORS, PARTNER_ERRORS = 5, 6.5, 2.0
_PAIRS_AT_ONCE = 500_000
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.2, 3e-4
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE_ROWS = 300_000


def term(word: str) -> int:
    """Hash of a word without case and outer marks; -1 if nothing is left."""
    plain = word.strip(MARKS).lower()
    return zlib.crc32(plain.encode()) % HASH_SPACE if plain else -1


@dataclass(slots=True)
class Machine:
    """Bias, weights and factors of the terms in `terms` (sorted hashes)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts as consecutive runs of term places in `rows`, run i from starts[i]."""
        padded = np.append(rows, 0)  # an empty last run has a place to start at
        lengths = np.diff(np.append(starts, len(rows)))
        full = lengths > 0

        def run_sums(values: np.ndarray) -> np.ndarray:
            sums = np.add.reduceat(values, starts, axis=0)
            sums[~full] = 0
            return sums

        v = self.factors[padded]
        v[-1] = 0
        w = self.weights[padded]
        w[-1] = 0
        pairs = 0.5 * ((run_sums(v) ** 2).sum(axis=1) - run_sums((v**2).sum(axis=1)))
        return self.bias + run_sums(w) + pairs


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Adaptive gradient steps on the logistic loss; the same result on each run."""
    terms = _telling(docs, labels)
    rng = np.random.default_rng(7)
    rate = labels.mean() if len(labels) else 0.5
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    m = Machine(terms, float(np.log(rate / (1 - rate))), np.zeros(len(terms) + 1), rng.normal(0, 0.02, (len(terms) + 1, FACTORS)))
    m.factors[-1] = 0
    if not len(terms):
        return m
    places = [_places(terms, d) for d in docs]
    seen_w, seen_v, seen_b = np.full(len(terms) + 1, 1.0), np.full((len(terms) + 1, FACTORS), 1.0), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            rows = np.concatenate([places[i] for i in batch])
            lengths = np.array([len(places[i]) for i in batch])
            if not len(rows):
                continue
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            error = 1 / (1 + np.exp(-np.clip(m.logit(rows, starts), -30, 30))) - labels[batch]
            of = np.repeat(np.arange(len(batch)), lengths)
            v = m.factors[rows]
            sums = np.zeros((len(batch), FACTORS))
            for f in range(FACTORS):
                sums[:, f] = np.bincount(of, v[:, f], len(batch))
            used, at = np.unique(rows, return_inverse=True)
            g = error[of]
            grad_w = np.bincount(at, g) + DECAY * m.weights[used]
            seen_w[used] += grad_w**2
            m.weights[used] -= RATE * grad_w / np.sqrt(seen_w[used])
            gv = g[:, None] * (sums[of] - v)
            grad_v = np.stack([np.bincount(at, gv[:, f]) for f in range(FACTORS)], axis=1) + DECAY * m.factors[used]
            seen_v[used] += grad_v**2
            m.factors[used] -= 0.2 * RATE * grad_v / np.sqrt(seen_v[used])
            seen_b += error.sum() ** 2
            m.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return m


def _telling(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Sorted hashes of the terms worth learning, alone or as one of two."""
    if not docs:
        return np.zeros(0, dtype=np.int64)
    terms, at, counts = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    toxic = np.bincount(at, np.repeat(labels, [len(d) for d in docs]), len(terms))
    n1 = max(labels.sum(), 1)
    n0 = max(len(labels) - labels.sum(), 1)
    share = counts / len(docs)
    apart = (toxic / n1 - (counts - toxic) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    kept = (counts >= LEAST_DOCS) & ((np.abs(apart) >= LEAST_ERRORS) | (share >= COMMON))
    partners = (toxic >= PAIR_DOCS) & (apart >= PARTNER_ERRORS) & (share < COMMON)
    number = np.where(partners, np.cumsum(partners) - 1, -1)
    ends = np.cumsum([len(d) for d in docs])
    own = [np.sort(x[x >= 0]) for x in np.split(number[at], ends[:-1])]
    kept[np.flatnonzero(partners)[_telling_pairs(own, labels, int(partners.sum()))]] = True
    return terms[kept]


def _pairs(numbers: np.ndarray, n: int, part: int, parts: int) -> np.ndarray:
    """Keys of the pairs of sorted numbers below n whose smaller number is of the part."""
    first = np.flatnonzero(numbers % parts == part)
    partners = len(numbers) - 1 - first
    at = np.repeat(first, partners)
    steps = np.arange(len(at)) - np.repeat(np.cumsum(partners) - partners, partners) + 1
    return numbers[at] * n + numbers[at + steps]


def _telling_pairs(docs: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the terms that form a telling pair; documents are sorted numbers below n.

    Pairs are counted part by part, so that memory does not grow with their number.
    """
    rate = labels.mean()
    parts = 1 + sum(len(d) * (len(d) - 1) // 2 for d, y in zip(docs, labels) if y) // _PAIRS_AT_ONCE
    found = [np.zeros(0, dtype=np.int64)]
    for part in range(parts):
        keys = [_pairs(d, n, part, parts) for d, y in zip(docs, labels) if y and len(d) > 1]
        met, times = np.unique(np.concatenate([found[0], *keys]), return_counts=True)
        met, times = met[times >= PAIR_DOCS], times[times >= PAIR_DOCS]
        if not len(met):
            continue
        everywhere = np.zeros(len(met), dtype=np.int64)
        for d in docs:
            keys = _pairs(d, n, part, parts) if len(d) > 1 else d[:0]
            at = np.minimum(np.searchsorted(met, keys), len(met) - 1)
            everywhere[at[met[at] == keys]] += 1
        apart = (times - everywhere * rate) / np.sqrt(everywhere * rate * (1 - rate) + 1e-12)
        telling = met[apart >= PAIR_ERRORS]
        found += [telling // n, telling % n]
    return np.unique(np.concatenate(found))


def _places(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    return at[terms[at] == hashes] if len(terms) else at[:0]


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Machine:
    """Learn from at most `sample` labelled rows of the training folds.

    Executors turn texts into distinct term hashes; the driver trains on those.
    Without labelled rows every score is the same.
    """
    rows = labelled_sample(docs, labels, label, folds, fold, sample, doc_id, text)

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(sorted({term(w) for w in set(t.split())} - {-1}), dtype=np.int32) for t in texts])

    got = sorted(rows.select("doc_id", "y", hashed("text").alias("x")).collect())
    return train([np.array(r["x"], dtype=np.int64) for r in got], np.array([r["y"] for r in got], dtype=np.float64))


def score(machine: Machine) -> Callable[[Column], Column]:
    """Scores in [0, 1] of a text column, one per row; null and empty texts get the bias alone."""
    terms, bias = machine.terms, machine.bias
    weights, factors = machine.weights.astype(np.float32), machine.factors.astype(np.float32)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Machine(terms, bias, weights, factors)
        known = {int(h): i for i, h in enumerate(terms)}
        table: dict[str, int] = {}

        def place(word: str) -> int:
            if len(table) >= _TABLE_ROWS:
                table.clear()
            table[word] = at = known.get(term(word), -1)
            return at

        for texts in batches:
            rows, starts, n = [], [], 0
            for t in texts:
                found = {table[w] if w in table else place(w) for w in set((t or "").split())}
                found.discard(-1)
                starts.append(n)
                rows.extend(found)
                n += len(found)
            logit = m.logit(np.array(rows, dtype=np.int64), np.array(starts, dtype=np.int64)) if starts else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))), dtype="float64")

    return scored
