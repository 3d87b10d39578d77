"""SimHash near duplicates: pigeonhole blocks, a join on blocks, Hamming distance.

A fingerprint is cut into 5 blocks. Fingerprints that differ in at most 2 bits agree
in at least 3 of them, so every close pair shares one of the 10 keys made of 3 block
values. Documents with the same fingerprint are one node, so copies never pair.

Keys that few distinct fingerprints share are joined pair by pair and verified. A key
with many (a family of near copies) would emit all its pairs; there each fingerprint
offers itself and its one-bit changes as meeting points. Two fingerprints within 2
bits have a meeting point within 1 bit of both, and those that share one are within
2 bits, so linking each meeting point to its smallest fingerprint gives the same
components from a number of rows in proportion to the fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import keep
from .graph import components

BITS, DISTANCE = 64, 2
BLOCKS = (13, 13, 13, 13, 12)
SHINGLE, SEED = 3, 42
# Distinct fingerprints of a key that are compared pair by pair.
PAIRWISE = 32
_STEP = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of all shingle hashes; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        pairs = zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    """Fingerprints of whole texts as signed longs; null and empty texts have 0."""
    found = np.array([fingerprint(t) for t in text], dtype=np.uint64)
    return pd.Series(found.view(np.int64))


def _mask(chosen: tuple[int, ...]) -> int:
    bits, at = 0, 0
    for i, width in enumerate(BLOCKS):
        if i in chosen:
            bits |= ((1 << width) - 1) << at
        at += width
    return bits - (1 << 64) if bits >> 63 else bits


KEYS = [_mask(c) for c in combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE)]


def _free_bits(mask: int) -> list[int]:
    """One-bit masks (signed) outside the key's blocks."""
    return [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(BITS) if not mask >> i & 1]


def close_links(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b) between distinct fingerprints (column f); components are those of distance <= 2.

    Every pair is within distance 2. Where a key is shared by more than `pairwise`
    fingerprints only the links to each meeting point's smallest are listed.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("f").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(KEYS)]))
    keyed = prints.select("f", keys.alias("key")).select("f", "key.k", "key.value")
    shared = keep(keyed.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = keep(keyed.join(shared, ["k", "value"]))
    few, many = met.where(F.col("n") <= pairwise), met.where(F.col("n") > pairwise)
    left, right = few.select("k", "value", F.col("f").alias("a")), few.select("k", "value", F.col("f").alias("b"))
    pairs = left.join(right, ["k", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    flips = F.get(F.array(*[F.array(*[F.lit(b) for b in [0, *_free_bits(m)]]) for m in KEYS]), F.col("k"))
    points = many.select("f", "k", F.explode(F.transform(flips, lambda b: F.col("f").bitwiseXOR(b))).alias("point"))
    hubs = points.groupBy("k", "point").agg(F.min("f").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spokes = points.join(hubs, ["k", "point"]).where(F.col("f") != F.col("hub"))
    return pairs.select("a", "b").unionByName(spokes.select(F.col("hub").alias("a"), F.col("f").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, f, component_id): one row per input row.

    `f` is the fingerprint as a signed long; `component_id` the smallest doc_id of the
    documents reachable over links of at most 2 bits. Null and texts without words have
    fingerprint 0 and are linked like others. Repeated rows stay. A null id takes part
    in links but is never a component's id unless all ids of it are null. Extra columns
    are ignored; an empty table gives an empty result.
    """
    rows = keep(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text).cast("string")).alias("f")))
    nodes = keep(rows.groupBy("f").agg(F.min("doc_id").alias("least")))
    found = components(close_links(nodes.select("f"), pairwise))
    rooted = keep(nodes.join(found, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("f", "component_id"), "f")


def hexadecimal(f: Column) -> Column:
    return F.lpad(F.lower(F.hex(f)), 16, "0")
