"""Alignments against brute force with the plain libraries."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidelattice.llm import token_alignment

from .helpers import make, odd_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_groups(ea, eb):
    common, groups, i, j = set(ea) & set(eb), [], 0, 0
    for end in sorted(common):
        k, m = ea.index(end, i) + 1, eb.index(end, j) + 1
        groups.append((i, k, j, m))
        i, j = k, m
    return groups


def brute_links(ea, eb):
    sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
    return [(i, j) for i in range(len(ea)) for j in range(len(eb)) if sa[i] < eb[j] and sb[j] < ea[i]]


def single(found):
    out, i, j = [], 0, 0
    for i1, j1, straight in zip(found.left_ends, found.right_ends, found.straight):
        out += [(i + k, i + k + 1, j + k, j + k + 1) for k in range(i1 - i)] if straight else [(i, i1, j, j1)]
        i, j = i1, j1
    return out


@pytest.mark.parametrize("dense", [0.2, 0.5, 0.9, 0.99])
def test_groups_and_links_of_random_cuts(dense):
    rng = random.Random(int(dense * 100))
    for _ in range(150):
        n = rng.randint(1, 70)
        ea, eb = ([x for x in range(1, n) if rng.random() < dense] + [n] for _ in range(2))
        found = token_alignment.align(ea, eb)
        assert single(found) == brute_groups(ea, eb)
        assert sorted(zip(*(x.tolist() for x in token_alignment.links(found)))) == brute_links(ea, eb)


def test_pairs_are_coded_and_read_back():
    rng = random.Random(1)
    values = token_alignment.np.array(sorted(rng.sample(range(50257 * 32000), 500)))
    assert token_alignment._decoded(token_alignment._coded(values)).tolist() == values.tolist()
    assert len(token_alignment._decoded(b"")) == 0


def expected(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    names = {i: s for s, i in json.load(open(A))["model"]["vocab"].items()}
    docs, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a = b = []
        links, groups = [], []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            ba = [bytes(letters[c] for c in names[i]) for i in a]
            bb = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
                a = b = []
            else:
                ea, eb = ([sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (ba, bb))
                groups = brute_groups(ea, eb)
                links = [(a[i], b[j]) for i, j in brute_links(ea, eb)]
        counts.update(set(links))
        spelled = ";".join(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])) for i, k, j, m in groups)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(
        ((d, na, nb, g, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), h) for d, na, nb, g, ls, h in docs), key=str
    )


ORDER = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equal_to_brute_force(spark):
    rows = odd_rows(50, longest=3_000) + [(100 + i, f"The <s> word </s> {i} <|endoftext|> of thntwhre, Ètion. {'a' * i}", "en", "a") for i in range(30)]
    got = token_alignment.alignments(make(spark, rows), A, B)
    assert got.columns == ORDER
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_several_copies_of_slices(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_DOCS", 4)
    monkeypatch.setattr(token_alignment, "COUNTED", 300)
    rows = odd_rows(40, longest=500)
    documents = token_alignment.aligned(make(spark, rows), A, B)
    counts = token_alignment.pair_counts(documents)
    sums = token_alignment.link_sums(documents, counts, 32000, slices=3, blocks_a_copy=2)
    got = documents.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(*ORDER).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_table(spark):
    assert token_alignment.alignments(make(spark, []), A, B).collect() == []
