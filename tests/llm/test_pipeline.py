"""Each stage of the pipeline on its own input, against brute force."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tidelattice.llm import quality_neighbours, shingles, suffix_dedup
from tidelattice.llm.common import stored

from .helpers import find_components, make, odd_rows, words
from .test_mixing_packing import shared_targets

SF = "/root/testdata/sf0.001"
COLUMNS = list(pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        found.append(docs.collect())
    return found


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_neighbours", "simhash", "suffix_dedup", "mixing", "packing"]
    for rows in stages[1:-1]:
        assert list(rows[0].asDict()) == COLUMNS


def test_rejected_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    voter = quality_neighbours.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", 4, 2)
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality_neighbours.score(voter)("text").alias("s")).collect()}
    assert Counter(tuple(r) for r in stages[1]) == Counter(tuple(r) for r in stages[0] if scores[r.doc_id] >= pipeline.LEAST_QUALITY)
    assert 0 < len(stages[1]) < len(stages[0])


def jaccard_roots(texts):
    """Components of distinct texts with a 5-word Jaccard similarity of 0.8 or more, by counting shared shingles."""
    texts = sorted(texts)
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    where, shared = defaultdict(list), Counter()
    for i, own in enumerate(sets):
        for h in own:
            shared.update((j, i) for j in where[h])
            where[h].append(i)
    pairs = [(i, j) for (i, j), n in shared.items() if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    roots = find_components(range(len(texts)), pairs)
    return {t: roots[i] for i, t in enumerate(texts)}, [(texts[i], texts[j]) for i, j in pairs]


def test_one_document_of_each_group_stays(stages):
    roots, _ = jaccard_roots({r.text for r in stages[1]})
    least = {}
    for r in stages[1]:
        least[roots[r.text]] = min(r.doc_id, least.get(roots[r.text], r.doc_id))
    assert Counter(tuple(r) for r in stages[2]) == Counter(tuple(r) for r in stages[1] if r.doc_id == least[roots[r.text]])


def test_recall_of_near_copies(spark):
    """Measured against all pairs of a table: 0.99 of the similar pairs share a root, and no others do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    roots, pairs = jaccard_roots({r.text or "" for r in docs.collect()})
    found = shingles.near_copies(docs)
    got = {r.text or "": r.root for r in docs.withColumn("t", shingles.text_key()).join(found, "t").select("text", "root").collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs) > 0
    held = defaultdict(set)
    for t, root in got.items():
        held[root].add(roots[t])
    assert all(len(x) == 1 for x in held.values())


@pytest.mark.parametrize("pairwise, rounds", [(32, 4), (2, 1), (2, 2)])
def test_families_larger_than_a_key_holds(spark, pairwise, rounds, monkeypatch):
    """Hubs in rounds and the exact end find what all pairs find; long texts come in parts."""
    monkeypatch.setattr(shingles, "HELD", 5)
    monkeypatch.setattr(shingles, "STREAMED", 16)
    monkeypatch.setattr(shingles, "PART", 8)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(140):
        own = list(base)
        for at in rng.integers(0, 120, size=rng.integers(0, 5)):
            own[at] = f"x{i}_{at}"
        texts.append(" ".join(own))
    texts += [" ".join(f"y{j}" for j in range(i, i + 100)) for i in range(0, 60, 3)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    roots, pairs = jaccard_roots(set(texts))
    docs = make(spark, rows)
    found = shingles.near_copies(docs, pairwise=pairwise, rounds=rounds)
    got = {r.text: r.root for r in docs.withColumn("t", shingles.text_key()).join(found, "t").select("text", "root").collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.999 * len(pairs)
    held = defaultdict(set)
    for t, root in got.items():
        held[root].add(roots[t])
    assert all(len(x) == 1 for x in held.values())


def test_repeats_are_cut(stages):
    """Every byte of a 229-byte window that starts twice, in spans of 400 bytes or 51 words."""
    texts = {r.doc_id: r.text.encode() for r in stages[2]}
    n = pipeline.REPEATED_BYTES
    starts = Counter(hash(t[i : i + n]) for t in texts.values() for i in range(len(t) - n + 1))
    cut = 0
    for r in stages[3]:
        t = texts[r.doc_id]
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if starts[hash(t[i : i + n])] > 1:
                step[i] += 1
                step[i + n] -= 1
        edge = np.diff(np.concatenate([[0], (np.cumsum(step)[: len(t)] > 0).astype(int), [0]]))
        spans = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
        long = [(a, b) for a, b in spans if b - a >= suffix_dedup.LENGTH or len(t[a:b].split()) >= pipeline.REPEATED_WORDS]
        spans = suffix_dedup.whole_characters(t, long)
        cut += len(spans)
        assert r.text == suffix_dedup.without(t, spans).decode() and r.n_chars == len(r.text)
    assert len(stages[3]) == len(stages[2]) and cut > 0


def test_mix_and_packing(stages):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in stages[3]:
        sizes[r.source] += len(words(r.text))
    for r in stages[4]:
        taken[r.source] += len(words(r.text))
    for s, t in shared_targets(sizes).items():
        assert abs(taken[s] - t) <= 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == want == sum(len(r.ids) // 4 for r in stages[5])


def test_stages_take_odd_documents(spark):
    docs = make(spark, odd_rows(40, longest=20_000))
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() > 0
    empty = make(spark, [])
    for _, stage in pipeline.STAGES:
        empty = stored(stage(spark, empty, SF))
    assert empty.count() == 0


def test_shared_and_null_ids_keep_one_row_of_each_group(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (1, two), (2, two), (None, one), (3, None), (3, ""), (4, f"{one} more"), (None, "other words"), (None, "other words"), (5, "last")]
    got = pipeline.one_of_each(spark, make(spark, [(i, t, "en", "a") for i, t in rows]), SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, one), (1, two), (3, ""), (None, "other words"), (5, "last")])


def test_repeats_of_over_fifty_words_are_cut(spark):
    def text(name, n):
        return " ".join(f"{name}{i:03}" for i in range(n))

    long, short = text("xy", 51), text("uv", 42)
    assert len(short) < len(long) < suffix_dedup.LENGTH
    rows = [(i, f"{text(f'a{i}', 60)}\n{p}\n{text(f'b{i}', 60)}", "en", "a") for i, p in enumerate([long, long, short, short])]
    got = {r.doc_id: r.text for r in pipeline.without_repeats(spark, make(spark, rows), SF).collect()}
    assert all("xy025" not in got[i] and 118 <= len(got[i].split()) <= 121 for i in (0, 1))
    assert all(got[i] == rows[i][1] for i in (2, 3))
