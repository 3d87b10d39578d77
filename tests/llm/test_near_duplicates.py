import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidelattice.llm import graph, shingles, simhash, spherical_caps
from tidelattice.llm.common import keep

from .helpers import find_components, make, odd_rows, words


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("pairwise", [0, 32])
def test_simhash_equals_brute_force(spark, pairwise):
    rng = random.Random(1)
    rows = odd_rows()
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)]
    for i in range(40):
        near = list(base)
        near[rng.randrange(400)] = "changed"
        rows.append((1000 + i, " ".join(near), "en", "a"))
    got = simhash.near_duplicates(make(spark, rows), pairwise=pairwise).collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(t) for _, t, _, _ in rows]
    distinct = sorted(set(prints))
    pairs = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2]
    roots = find_components(distinct, pairs)
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = Counter((i, p, least.get(roots[p])) for (i, *_), p in zip(rows, prints))
    assert Counter((r.doc_id, r.f % (1 << 64), r.component_id) for r in got) == want


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(make(spark, [])).collect() == []


def test_keys_cover_all_close_pairs():
    rng = random.Random(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m % (1 << 64) == b & m % (1 << 64) for m in simhash.KEYS)


def test_components_of_paths_hubs_and_cycles(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    pairs += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    linked = [p for p in pairs if p[0] != p[1]]
    want = find_components({x for p in linked for x in p}, linked)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_components_end_when_all_edges_are_stars(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "keep", lambda df: kept.append(1) or keep(df))
    pairs = [(i, i % 5) for i in range(5, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i % 5 for i in range(200)}
    assert len(kept) == 2  # the links and one round; a round that only finds nothing to move was the third


def vectors(spark, rows):
    extra = [(i, v, l, 5, 6, 7, "x") for i, v, l in rows]
    return spark.createDataFrame(extra, "vec_id long, embedding array<float>, label int, node long, filter int, copies long, vec string")


@pytest.mark.parametrize("block", [16, 512])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((4, 24))
    rows = []
    for i in range(220):
        v = centre[i % 4] + 0.08 * rng.standard_normal(24) if i % 3 else rng.standard_normal(24)
        rows.append((i, [float(x) for x in v.astype(np.float32)], [1, 2, None][i % 7 % 3]))
    rows += [(300 + i, rows[1][1], rows[1][2]) for i in range(30)]
    rows += [(400, [2 * x for x in rows[1][1]], rows[1][2]), (401, None, 1), (402, [0.0] * 24, 1), (403, [float("nan")] + [1.0] * 23, 1)]
    rows += [(404, [float("inf")] + [1.0] * 23, 1), (405, [None] + [1.0] * 23, 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [], 1), (1, rows[1][1], rows[1][2])]
    got = spherical_caps.near_vectors(vectors(spark, rows), block=block).collect()
    assert len(got) == len(rows)

    def fine(v):
        return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)

    pairs, links = [], Counter()
    for i, (_, a, l) in enumerate(rows):
        for j, (_, b, m) in enumerate(rows[:i]):
            if l is not None and l == m and fine(a) and fine(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    pairs.append((i, j))
                    links.update((i, j))
    roots = find_components(range(len(rows)), pairs)
    least = {}
    for i, r in enumerate(rows):
        least[roots[i]] = min(r[0], least.get(roots[i], 1 << 60))
    want = Counter((r[0], links[i], least[roots[i]], r[0] == least[roots[i]]) for i, r in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert len(pairs) > 500


def test_recall_of_the_filters_on_isolated_pairs():
    rng = np.random.default_rng(6)
    x = spherical_caps.unit(rng.standard_normal((400, 64)))
    u = rng.standard_normal((400, 64))
    u = spherical_caps.unit(u - (u * x).sum(axis=1, keepdims=True) * x)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * u
    met = sum(len(np.intersect1d(a, b)) > 0 for a, b in zip(spherical_caps.decode(x), spherical_caps.decode(y)))
    assert met >= 0.97 * 400


def test_near_vectors_of_an_empty_table(spark):
    assert spherical_caps.near_vectors(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("pairwise", [2, 32])
def test_near_copies_equal_brute_force_jaccard(spark, pairwise):
    rng = random.Random(11)
    rows = odd_rows(20, longest=2_000)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    for i in range(60):
        near = list(base if i % 2 else [f"v{i // 8}{w}" for w in base])
        for _ in range(rng.randint(0, 8)):
            near[rng.randrange(200)] = f"changed{rng.random()}"
        rows.append((1000 + i, " ".join(near), "en", "a"))
    docs = make(spark, rows).withColumn("t", shingles.text_key())
    roots = {r.t: r.root for r in shingles.near_copies(docs, pairwise=pairwise).collect()}
    got = [(r.text, roots[r.t]) for r in docs.select("text", "t").collect()]

    def cut(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [cut(t) for t, _ in got]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = find_components(range(len(sets)), pairs)
    found = {}
    assert all(found.setdefault(r, want[i]) == want[i] for i, (_, r) in enumerate(got))
    assert len(found) == len(set(want.values())) < len(sets)
    prints = [simhash.fingerprint(t) for t, _ in got]
    assert sum((prints[i] ^ prints[j]).bit_count() > 2 for i, j in pairs) > 50
    assert shingles.near_copies(make(spark, [])).collect() == []
