import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelattice.llm import mixing, packing

from .helpers import make, odd_rows, words

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def shared_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2):
    """The repeated sharing of the excess, as stated."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: target[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            cap = ceiling * sizes[s]
            if given[s] >= cap:
                left += given[s] - cap
                given[s] = cap
                open_.discard(s)
            target[s] = given[s]
    return target


def test_mix_hits_targets(spark):
    rows = odd_rows(200)
    docs = make(spark, rows)
    draws, documents = mixing.mix(docs, block_words=200, shards=6)
    got = documents.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _, _ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want = shared_targets(sizes)
    by_source = draws.groupBy("source").agg(F.sum("words")).collect()
    for s, n in by_source:
        assert abs(n - want[s]) <= 1
    assert {s for s, _ in by_source} == {s for s, t in want.items() if t >= 1}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert math.isclose(sum(r.taken for r in got), sum(n for _, n in by_source))
    for r in got:
        assert any(math.isclose(r.target, t, abs_tol=1e-6) and r.source_size == sizes[s] for s, t in want.items())
    again = mixing.mix(docs.repartition(7), block_words=200, shards=6)[0]
    key = ["shard", "place", "doc_id", "source", "pass", "words"]
    assert Counter(map(tuple, draws.select(key).collect())) == Counter(map(tuple, again.select(key).collect()))


def test_drawn_texts(spark):
    rows = odd_rows(100)
    docs = make(spark, rows)
    draws, _ = mixing.mix(docs, block_words=300)
    got = mixing.drawn_texts(docs, draws).collect()
    assert len(got) == draws.count()
    texts = {(i, s, t) for i, t, _, s in rows}
    trimmed = [r for r in got if (r.doc_id, r.source, r.text) not in texts]
    assert len(trimmed) <= 4
    for r in trimmed:
        assert any(words(t)[: len(words(r.text))] == words(r.text) for i, s, t in texts if (i, s) == (r.doc_id, r.source) and t)


def test_quotas_are_split_exactly(spark):
    quotas = {"a": 1000, "b": 37, None: 300, "c": 1, "d": 0}
    got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, blocks long"), 8).collect()
    for s, n in quotas.items():
        assert sum(r.blocks for r in got if r.source == s) == n
    per_shard = Counter()
    for r in got:
        assert r.blocks >= 0
        per_shard[r.shard] += r.blocks
    assert max(per_shard.values()) - min(per_shard.values()) <= 3


def test_hypergeometric_has_its_distribution(spark):
    total, good, drawn, n = 50, 20, 15, 20_000
    one = lambda x: F.lit(x).cast("long")
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    got = spark.range(n).select(mixing.hypergeometric(one(total), one(good), one(drawn), u).alias("x")).groupBy("x").count().collect()
    seen = {r.x: r["count"] / n for r in got}
    for k in range(drawn + 1):
        p = math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn)
        assert abs(seen.get(k, 0) - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_mix_of_an_empty_table(spark):
    draws, documents = mixing.mix(make(spark, []))
    assert draws.collect() == [] and documents.collect() == []
    draws, documents = mixing.mix(make(spark, [(1, None, "en", None), (2, "", "en", "a")]))
    assert draws.collect() == [] and sorted((r.doc_id, r.taken, r.target) for r in documents.collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_round_trip(spark, parts):
    rows = odd_rows(150)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    got = packing.pack_documents(make(spark, rows).repartition(parts), WORD_BPE, size=256).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
        documents[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    short = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256 and at == pieces[0].sequence_length and at & (at - 1) == 0
        short += at < 256
    assert short <= 8 * parts  # only powers of two at the end of a partition
    want = Counter()
    for i, t, _, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids)] += 1
        if sum((i, t) == (a, b) for a, b, _, _ in rows) == 1 and len(documents[i, len(ids)]) == sum(1 for _ in documents[i, len(ids)]):
            pieces = sorted(documents[i, len(ids)])
            if sum(len(p) for _, p in pieces) == len(ids):
                assert [x for _, p in pieces for x in p] == ids
    for key, n in want.items():
        assert sum(len(p) for _, p in documents[key]) == n * key[1]
    assert packing.pack_documents(make(spark, []), WORD_BPE).collect() == []


def test_sequences_are_balanced_by_cost():
    rng = random.Random(8)
    pieces = [packing.Piece(i, 0, rng.choice([20, 60, 300, 900])) for i in range(2000)]
    done, left = packing.pack(pieces, 2048, close=False)
    assert all(s.room == 0 for s in done) and sum(p.length for p in left) < 2048
    costs = np.array([s.cost for s in done])
    shuffled = [s for s in np.array_split(np.array([p.length for p in pieces]), len(done))]
    plain = np.array([sum(n + n * n / 2048 for n in s) for s in shuffled])
    assert costs.std() < 0.5 * plain.std()


def test_pieces_go_to_the_cheapest_sequence_with_room():
    rng = random.Random(9)
    pieces = [packing.Piece(i, 0, min(2047, int(rng.lognormvariate(5.8, 1)) + 1)) for i in range(6000)]
    done, _ = packing.pack(pieces, 2048, close=False)
    bins = [[0.0, i, 2048, []] for i in range(sum(p.length for p in pieces) // 2048)]
    for p in sorted(pieces, key=lambda p: (-p.length, p.doc)):
        fit = min((b for b in bins if b[2] >= p.length), key=lambda b: b[:2], default=None)
        if fit:
            fit[0] += p.length + p.length**2 / 2048
            fit[2] -= p.length
            fit[3].append(p.doc)
    assert len(bins) > 1000
    whole = [[p.doc for p in s.pieces if p.length == pieces[p.doc].length] for s in done]
    assert [b[3] for b in bins] == whole


def test_words_have_the_ids_of_the_whole_text():
    ids = packing.word_ids(WORD_BPE)
    rng = random.Random(5)
    parts = [" ", "\n", "a", "Bc", "1", "'s", "!", "\x1c", "\t", "é", "漢", "<|endoftext|>", " ", "\r\n", "😀", "İ", "Σ", "<|start", "é", "Word."]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert zlib.crc32(ids.of("a")) == zlib.crc32(np.array(ids.tokenizer.encode("a", add_special_tokens=False).ids, "<u4").tobytes())
