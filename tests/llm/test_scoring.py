import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelattice.llm import quality_neighbours, quality_rules, token_counts, toxicity
from tidelattice.llm.learning import held_out, labelled_sample
from tidelattice.llm.merge_automaton import MergeAutomaton

from .helpers import make, odd_rows, words

SF = "/root/testdata/sf0.1"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("module", "label", "folds", "fold", "least"), [(toxicity, "toxic", 3, 1, 0.97), (quality_neighbours, "quality", 4, 2, 0.97)])
def test_held_out_accuracy(spark, module, label, folds, fold, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = module.score(module.fit(docs, labels, label, folds, fold))
    rows = docs.join(labels, "doc_id").where(held_out("doc_id", folds, fold)).select(label, scored("text").alias("s")).toPandas()
    y, s = rows[label].to_numpy(), rows["s"].to_numpy()
    assert area(y, s) > least
    hard = s >= 0.7
    assert (hard == (y == 1)).mean() > 0.96


@pytest.mark.parametrize("module", [toxicity, quality_neighbours])
def test_odd_texts_and_no_labels(spark, module):
    docs = make(spark, odd_rows())
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(3, 70)] + [(None, 1, 1), (12, 0, 0), (12, 1, 0)], "doc_id long, toxic int, quality int")
    for label in ("toxic", "quality"):
        scored = module.score(module.fit(docs, labels, label, 3, 1))
        got = docs.select("doc_id", "score", scored("text").alias("out")).collect()
        assert len(got) == docs.count() and all(0 <= r["out"] <= 1 for r in got)
    none = make(spark, [])
    assert none.select(module.score(module.fit(none, labels, "toxic", 3, 1))("text")).collect() == []


def test_sample_is_bounded_and_avoids_the_held_out_fold(spark):
    docs = make(spark, odd_rows())
    labels = spark.createDataFrame([(i, 1) for i in range(70)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 3, 1, 20).collect()
    assert len(got) <= 20 and len({r.doc_id for r in got}) == len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)


def test_pairs_are_learned():
    """Either term alone is harmless, both together are toxic: no additive weights do that."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        terms = [100 + int(x) for x in rng.choice(20, 4, replace=False)]
        a, b = i % 2, i // 2 % 2
        docs.append(np.array(sorted(terms + [1] * a + [2] * b), dtype=np.int64))
        labels.append(a & b)
    m = toxicity.train(docs, np.array(labels, dtype=float), epochs=150)
    places = [toxicity._places(m.terms, d) for d in docs]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in places])[:-1]])
    assert area(np.array(labels), m.logit(np.concatenate(places), starts)) > 0.99


def test_a_rare_pair_of_harmless_terms_is_learned():
    """Each term is in 4 % of the documents, both in 1 %; only those and other insults are toxic."""
    rng = np.random.default_rng(6)

    def sample(n):
        docs, labels = [], []
        for _ in range(n):
            u = rng.random()
            a, b, insult = u < 0.04, u < 0.01 or 0.04 <= u < 0.07, rng.random() < 0.1
            terms = set(rng.integers(100, 5000, 20).tolist()) | {t for t, there in ((1, a), (2, b), (3, insult)) if there}
            docs.append(np.array(sorted(terms), dtype=np.int64))
            labels.append(float(insult or (a and b)))
        return docs, np.array(labels)

    docs, labels = sample(1200)
    assert {1, 2, 3} <= set(toxicity._telling(docs, labels).tolist())
    m = toxicity.train(docs, labels)
    fresh, _ = sample(4000)
    places = [toxicity._places(m.terms, d) for d in fresh]
    logit = np.array([m.logit(p, np.array([0])) for p in places])[:, 0]
    has = np.array([[t in d for t in (1, 2, 3)] for d in fresh])
    both, one = has[:, 0] & has[:, 1] & ~has[:, 2], (has[:, 0] ^ has[:, 1]) & ~has[:, 2]
    assert both.sum() > 10 and one.sum() > 50
    assert (logit[both] > 0).mean() > 0.9 and (logit[one] > 0).mean() < 0.1


def test_scores_are_the_double_sum_over_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(np.arange(40), 0.3, rng.normal(size=41), rng.normal(size=(41, 3)))
    docs = [np.sort(rng.choice(40, k, replace=False)) for k in (0, 1, 2, 40, 0, 7, 0)]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
    got = m.logit(np.concatenate(docs), starts)
    for d, s in zip(docs, got):
        pairs = sum(float(m.factors[i] @ m.factors[j]) for i in d for j in d if i < j)
        assert math.isclose(s, 0.3 + m.weights[d].sum() + pairs, rel_tol=1e-9, abs_tol=1e-9)


def test_neighbours_vote_like_all_pairs():
    rng = np.random.default_rng(2)
    z, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((30, 8)), rng.standard_normal((200, 8))))
    y = rng.integers(0, 2, 200).astype(float)
    got = quality_neighbours.Voter(None, None, v, y, 0.5).vote(z)
    for row, s in zip(z, got):
        near = sorted(((float(row @ u), t) for u, t in zip(v, y)), reverse=True)[: quality_neighbours.NEIGHBOURS]
        weights = [(max(c, 0) ** quality_neighbours.SHARPNESS, t) for c, t in near]
        assert math.isclose(s, sum(w * t for w, t in weights) / sum(w for w, _ in weights), rel_tol=1e-9)


def slow_base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(inside)


def test_rules_base_counts(spark):
    rng = random.Random(9)
    rows = odd_rows() + [(500 + i, " ".join(rng.choice("abc") for _ in range(60)), "en", "a") for i in range(20)]
    rows += [(600, "x y z w v\nx y z w v\n\n\n \n \nx y z w v", None, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(70)] + [(None, 1)], "doc_id long, quality int")
    got = quality_rules.judge(make(spark, rows), labels).collect()
    name = lambda b: (*b, b[0] < 10 or 100 * b[4] > 20 * b[0])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter(
        (i, *name(slow_base(t))) for i, t, _, _ in rows
    )
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules.judge(make(spark, []), labels).collect() == []


def test_many_distinct_words_keep_exact_windows():
    rng = random.Random(3)
    w = [str(rng.randrange(9000)).encode() for _ in range(30_000)]
    w[20_000:20_009] = w[100:109]
    assert quality_rules.repeated_words(w) == slow_base(b" ".join(w).decode())[4]


def test_binomial_tail_and_certificates():
    for n, p in ((30, 0.1), (400, 0.02), (7, 0.5)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(quality_rules.binomial_tail(k, n, p), min(1, want), rel_tol=1e-9)
    grid = (3.0, 2.0, 1.0)
    # 5,000 good documents: none above 3, none above 2, 500 above 1.
    assert quality_rules.certified([(0, 4500), (1, 500)], 5000, grid, 0.01, 0.01) == 2.0
    assert quality_rules.certified([(0, 20)], 20, grid, 0.01, 0.01) is None


def test_rules_reject_little_of_the_good(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.judge(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    for _, own in rows[rows.quality == 1].groupby("stratum"):
        assert 1 - own.kept.mean() <= quality_rules.FALSE_REJECTION
    assert 1 - rows[rows.quality == 0].kept.mean() > 0.3


def test_token_counts_equal_the_library(spark):
    rows = odd_rows()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    for chunk in (7, 1000, 65_536):
        if chunk == 7:
            rows_now = [r for r in rows if len(r[1] or "") < 2000]
        else:
            rows_now = rows
        got = token_counts.token_counts(make(spark, rows_now), BYTE_BPE, chunk_chars=chunk).collect()
        want = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows_now)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(make(spark, []), BYTE_BPE).collect() == []


def slow_merges(word, rank):
    """Byte-pair merging as defined: the pair of the lowest rank, the leftmost first."""
    parts = list(word)
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_counts_like_merging():
    """Random small vocabularies, with merges whose results never occur."""
    rng = random.Random(8)
    for trial in range(150):
        letters = "ab" if trial % 3 else "abc"
        merges, made, tokens = [], set(), list(letters)
        for _ in range(rng.randint(0, 12)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if "".join(pair) not in made and len("".join(pair)) < 9:
                merges.append(pair)
                made.add("".join(pair))
                tokens.append("".join(pair))
        rank = {p: i for i, p in enumerate(merges)}
        m = MergeAutomaton(letters, merges, states=rng.choice([1, 5, 10_000]))
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
            assert m.count(word) == len(slow_merges(word, rank)), (merges, word)


def test_automaton_counts_like_the_library():
    m = MergeAutomaton.from_file(BYTE_BPE)
    model = Tokenizer.from_file(BYTE_BPE).model
    rng = random.Random(5)
    tokens, letters = sorted(m.tokens), sorted(m.letters)
    words = ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    words += ["a" * 5000, "ab" * 3000, "\u0120" * 1000, "".join(rng.choice(letters) for _ in range(20_000))]
    assert all(m.count(w) == len(model.tokenize(w)) for w in words)
    with pytest.raises(KeyError):
        m.count("a b")


def test_state_maps_compose_in_any_order():
    t = token_counts.transducer(BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "a", "Bc", "1", "'s", "!", "\x1c", "\t", "é", "漢", "<|endoftext|>", " ", "\r\n", "😀", "'", "foo.\nBar"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        k = rng.randint(1, 7)
        maps = [t.state_map(text[i : i + k]) for i in range(0, len(text), k)]
        folded = token_counts.StateMap("", 0, "", False)
        for m in maps:
            folded = t.compose(folded, m)
        assert t.units_count(text) == t.scan(maps) == t.close(folded) == want


def test_labelled_counts_are_weighed_once_on_the_driver():
    rng = np.random.default_rng(4)
    counts = ((rng.random((1200, quality_neighbours.Features.dims)) < 0.06) * rng.integers(1, 5, (1200, quality_neighbours.Features.dims))).astype(np.float32)
    tracemalloc.start()
    try:
        voter = quality_neighbours.learn(counts, (rng.random(1200) < 0.5).astype(float))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(voter.vectors, voter.project(counts))
    # Weighed twice, with the first still held, it was three times the counts.
    assert peak < 2.5 * counts.nbytes


def test_quality_fit_holds_no_object_per_count(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}x" for i in range(9000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary, 2000))) for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        voter = quality_neighbours.fit(docs, labels, "quality", 4, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    counts = 4 * len(voter.labels) * quality_neighbours.Features.dims
    # Rows of Python integers were several times the counts.
    assert len(voter.labels) > 700 and peak < 2.5 * counts
