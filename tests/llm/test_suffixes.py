import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelattice.llm import suffix_dedup as sd

from .helpers import make


def covered(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        edge = np.diff(np.concatenate([[0], (np.cumsum(step)[: len(t)] > 0).astype(int), [0]]))
        out.append([(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
    return out


def corpus(seed=5):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    base = [noise(300) for _ in range(6)]
    texts = [None, "", "short"]
    for _ in range(80):
        t = noise(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 200)
            t += rng.choice(base)[a : a + rng.randint(20, 150)] + noise(rng.randint(0, 30))
        texts.append(t)
    return [*texts, "a" * 200, "ab" * 150, "é" * 100, base[0], base[0], base[1][:60]]


# Pairs, refinement by bytes, hashed windows of groups too large, parts of long texts.
@pytest.mark.parametrize(
    ("seed_bytes", "limit", "pairwise", "scan", "often"),
    [(8, 20_000, 24, 1 << 20, 3000), (8, 20_000, 2, 90, 3000), (8, 3, 24, 1 << 20, 3000), (20, 20_000, 3, 1 << 20, 2), (8, 3, 2, 1 << 20, 4)],
)
def test_spans_equal_brute_force(spark, monkeypatch, seed_bytes, limit, pairwise, scan, often):
    texts = corpus()
    monkeypatch.setattr(sd, "PAIRWISE", pairwise)
    if scan < 1 << 20:  # executors fork before this is set, so the scanner is tried on its own
        scanner = sd.Scanner(40, seed_bytes)
        data = [(t or "").encode() for t in texts]
        whole = {(i, int(p)) for i, places, _ in scanner.texts(data) for p in places}
        monkeypatch.setattr(sd, "SCAN", scan)
        parts = [(i, int(p)) for i, places, _ in scanner.texts(data) for p in places]
        assert set(parts) == whole and len(parts) == len(whole)
    rows = [(None if i == 20 else i, t, "en", "a") for i, t in enumerate(texts)]
    got = sd.remove_repeats(make(spark, rows), length=40, seed_bytes=seed_bytes, group_limit=limit, often=often, carry=("lang",)).collect()
    want = covered([(t or "").encode() for t in texts], 40)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for (i, t, _, _), spans in zip(rows, want):
        data, r = (t or "").encode(), by_id[i]
        assert [(s.a, s.b) for s in r.spans] == spans
        assert r.kept == sd.without(data, spans) and r.n_bytes == len(data) and r.lang == "en"
        r.kept_text.encode()


def test_repeated_rows_and_the_same_document_count_as_elsewhere(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(50))
    rows = [(1, t, "en", "a"), (1, t, "en", "a"), (2, "x" + t[:39], "en", "a"), (3, "".join(random.Random(2).choice("ghij") for _ in range(45)) * 2, "en", "a")]
    got = sorted((r.doc_id, len(r.kept)) for r in sd.remove_repeats(make(spark, rows), length=40, seed_bytes=8).collect())
    assert got == [(1, 0), (1, 0), (2, 40), (3, 0)]


def test_empty_table(spark):
    assert sd.remove_repeats(make(spark, [])).collect() == []


def test_loser_tree_merges_in_order_with_common_prefixes():
    rng = random.Random(7)
    for runs in (1, 2, 3, 7):
        parts = [sorted(sd.Suffix(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))), b"l", i) for i in range(rng.randint(0, 30))) for _ in range(runs)]
        merged = list(sd.merge_runs([sd.encode_run(p) for p in parts]))
        assert [s.text for _, s in merged] == sorted(s.text for p in parts for s in p)
        assert Counter(s for _, s in merged) == Counter(s for p in parts for s in p)
        for (_, a), (shared, b) in zip(merged, merged[1:]):
            assert shared == sd.common_prefix(a.text, b.text)


def test_characters_on_a_border_stay_whole():
    data = "aéb".encode()
    assert sd.whole_characters(data, [(2, 4)]) == [(3, 4)]
    assert sd.whole_characters(data, [(0, 2)]) == [(0, 1)]
    assert sd.whole_characters(data, [(2, 3)]) == []


def test_suffixes_spread_evenly_over_the_ranges():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(100)]
    wanted = [[] for _ in texts]
    for i, places, seeds in sd.Scanner(400, 48).texts([t.encode() for t in texts]):
        wanted[i] += [{"pos": int(p), "seed": int(h), "context": 0} for p, h in zip(places, seeds.view(np.int64))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), pa.array(texts), pa.array(wanted)], names=["k1", "k2", "text", "wanted"])
    held = Counter()
    for out in sd._runs(400, 48, 16)([batch]):
        for r, run in zip(*(c.to_pylist() for c in out.columns)):
            suffixes = [s for _, s in sd.decode_run(run)]
            assert suffixes == sorted(suffixes)
            assert {sd.range_of(int.from_bytes(s.text[:8], "big"), 16) for s in suffixes} == {r}
            held[r] += len(suffixes)
    assert held.total() == sum(map(len, wanted))
    # An even share is a sixteenth; least hashes by their own order put most into the first range.
    assert max(held.values()) < 0.12 * held.total()
