"""Small odd tables and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators might use inside.
    "size long, score double, f long, k1 long, seed long, pos long, spans string, _text string, _key long, node long, target double, stratum string, words long, b string"
)
ALPHABET = ["alpha", "beta", "Gamma", "delta,", "it's", "é", "漢字", "|", "x&&&", "12", "\n", "  ", "\t", "foo.", "BAR", "😀", "<|endoftext|>", "\x1c", "\x85", "İ!"]


def words(text):
    return WORD.findall(text or "")


def make(spark, rows):
    """(doc_id, text, lang, source) rows with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 1, 0.5, 7, 8, 9, 10, "s", "t", 11, 12, 1.5, "u", 3, "b") for i, t, l, s in rows], SCHEMA)


def odd_rows(n=60, seed=3, longest=200_000):
    rng = random.Random(seed)
    rows = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \n\t ", None, "b"),
        (None, "alpha beta gamma", "en", None),
        (None, None, None, None),
        (3, "one", "de", "a"),
        (4, "same text here for all", "en", "b"),
        (4, "same text here for all", "en", "b"),  # a repeated row
        (5, "same text here for all", "en", "b"),  # a copy
        (4, "another text of the same id", "en", "b"),
        (6, " ".join(rng.choice(ALPHABET) for _ in range(longest // 5)), "en", "c"),
    ]
    for i in range(n):
        rows.append((10 + i, " ".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 120))), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"])))
    return rows


def find_components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
