"""Token counts without token lists: a transducer over units, composed chunk by chunk.

The merges are compiled into a deterministic transducer over letters
(`merge_automaton`), which counts the tokens of a pre-token. Around it lies a machine
over units: its boundary state is "a solid character was just read"; there a
white-space character always starts a new pre-token, so the text may be cut. A unit is
the text between two such cuts. The transition of a unit, from boundary to boundary,
is composed of the letter transitions of its pre-tokens and annotated with their sum;
composed transitions are kept, for words repeat. The library gives the pre-tokens of
what is not plain ASCII words; it never gives tokens.

A chunk of text is a state map: tokens between its first and last cut, plus the
open ends that belong to units shared with its neighbours. Maps compose
associatively, so chunks of one text are mapped in parallel and combined in a scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .merge_automaton import MergeAutomaton

CHUNK_CHARS = 65_536
# Transitions kept per worker; the table is emptied when full and composed anew.
TRANSITIONS = 400_000
# Marks that form pre-tokens of their own after a letter (the apostrophe may start a contraction).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# How byte-level vocabularies write the blank.
BLANK = "\u0120"
_UNCLEAN = 1 << 50


class StateMap(NamedTuple):
    """A chunk: `count` tokens lie between the cuts; without a cut all text is in `head`."""

    head: str
    count: int
    tail: str
    cut: bool


class Transducer(dict):
    """Maps the text after a cut-off blank to the tokens of blank and text together."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        split, added = parts["pre_tokenizer"] or {}, parts["added_tokens"]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} has no byte-level pre-tokens without a prefix")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        self.automaton = MergeAutomaton.from_file(path)
        self.pre_tokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        # Of added strings that start at the same place the longest is taken.
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names)) or r"(?!)")

    def emitted(self, unit: str) -> int:
        """Tokens of a unit (or any text that stands alone)."""
        plain = self.added.split(unit)
        inside = sum(self.automaton.count(word) for part in plain if part for word, _ in self.pre_tokens(part))
        return inside + len(plain) - 1

    def __missing__(self, piece: str) -> int:
        if not piece or piece[-1].isspace():
            count = _UNCLEAN
        else:
            lines = _line_units(" " + piece)
            if len(lines) > 1:
                # Line units repeat across texts; their combinations do not, so these are not kept.
                return sum(self._line(x) for x in lines)
            letters = piece.rstrip(MARKS)
            if letters is not piece and letters.isalpha():
                # Letters and the marks after them are separate pre-tokens; words repeat more than pairs.
                return self[letters] + self._alone(piece[len(letters) :])
            if piece.isascii() and piece.isalpha():
                count = self.automaton.count(BLANK + piece)  # one pre-token, written as in the vocabulary
            else:
                count = self.emitted(lines[0])
        if len(self) >= TRANSITIONS:
            self.clear()
        self[piece] = count
        return count

    def _line(self, unit: str) -> int:
        return self[unit[1:]] if unit[0] == " " else self._alone(unit)

    def _alone(self, unit: str) -> int:
        key = " " + unit  # a piece has no blank, so these keys are apart
        count = self.get(key)
        if count is None:
            count = self.emitted(unit)
            if len(self) >= TRANSITIONS:
                self.clear()
            self[key] = count
        return count

    def units_count(self, text: str) -> int:
        """Tokens of a text that starts and ends at cuts (or at the ends of the document)."""
        if not text:
            return 0
        pieces = text.split(" ")
        if pieces[0]:
            total = self.emitted(pieces[0]) if not pieces[0][-1].isspace() else _UNCLEAN
            rest = pieces[1:]
        elif len(pieces) > 1:
            total, rest = 0, pieces[1:]
        else:
            total, rest = self.emitted(text), []
        total += sum(map(self.__getitem__, rest))
        return total if total < _UNCLEAN else sum(map(self.emitted, units(text)))

    def state_map(self, chunk: str) -> StateMap:
        first = _first_cut(chunk)
        if first < 0:
            return StateMap(chunk, 0, "", False)
        last = _last_cut(chunk)
        return StateMap(chunk[:first], self.units_count(chunk[first:last]), chunk[last:], True)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.cut and not b.cut:
            return self.state_map(a.head + b.head)
        if not a.cut:
            joined = self.state_map(a.head + b.head)
            if not joined.cut:
                return StateMap(joined.head, b.count, b.tail, True)
            return StateMap(joined.head, joined.count + self.units_count(joined.tail) + b.count, b.tail, True)
        if not b.cut:
            joined = self.state_map(a.tail + b.head)
            # a.tail starts at a cut, so all before the last cut of the joined text is closed.
            if not joined.cut:
                return StateMap(a.head, a.count, joined.head, True)
            closed = self.units_count(joined.head) + joined.count
            return StateMap(a.head, a.count + closed, joined.tail, True)
        return StateMap(a.head, a.count + self.units_count(a.tail + b.head) + b.count, b.tail, True)

    def close(self, m: StateMap) -> int:
        return self.units_count(m.head) + m.count + self.units_count(m.tail)

    def scan(self, maps: Sequence[StateMap]) -> int:
        """Compose in a balanced tree, then close both ends."""
        maps = list(maps)
        while len(maps) > 1:
            pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        return self.close(maps[0]) if maps else 0


def _cuts(text: str) -> Iterator[int]:
    """Places before a blank or line feed that follows a solid character."""
    for i in range(1, len(text)):
        if text[i] in " \n" and not text[i - 1].isspace():
            yield i


def _first_cut(text: str) -> int:
    return next(_cuts(text), -1)


def _last_cut(text: str) -> int:
    for i in range(len(text) - 1, 0, -1):
        if text[i] in " \n" and not text[i - 1].isspace():
            return i
    return -1


def units(text: str) -> list[str]:
    cuts = [0, *_cuts(text), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def _line_units(text: str) -> list[str]:
    out, start, at = [], 0, text.find("\n", 1)
    while at > 0:
        if not text[at - 1].isspace():
            out.append(text[start:at])
            start = at
        at = text.find("\n", at + 1)
    out.append(text[start:])
    return out


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One lazily compiled transducer per worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def token_counts(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Bytes and tokens of every whole text: (doc_id, n_bytes, n_tokens).

    `vocabulary` is a tokenizer file of the `tokenizers` library with byte-level
    pre-tokens, readable on every executor. Null and empty texts have 0 bytes and
    0 tokens; repeated rows are repeated in the result; a null id stays null; an empty
    table gives an empty result. Other columns are ignored, whatever their names. Chunks of one text are
    separate rows before they are mapped, so a long text is no long task step.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_chunks = F.greatest(F.ceil(F.length("_text") / chunk_chars), F.lit(1)).cast("int")
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("_text"))
    chunks = rows.select(
        "doc_id",
        F.xxhash64("_text").alias("_hash"),
        F.octet_length("_text").cast("long").alias("n_bytes"),
        n_chunks.alias("_n"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), n_chunks - 1), lambda i: F.substring("_text", i * chunk_chars + 1, F.lit(chunk_chars))
            )
        ).alias("_no", "_chunk"),
    )

    @F.pandas_udf("head string, count long, tail string, cut boolean")
    def mapped(chunk: pd.Series, no: pd.Series, n: pd.Series) -> pd.DataFrame:
        t = transducer(vocabulary)
        out = []
        for c, i, k in zip(chunk, no, n):
            out.append(StateMap("", t.units_count(c), "", True) if k == 1 else t.state_map(c))
        return pd.DataFrame(out, columns=["head", "count", "tail", "cut"])

    @F.pandas_udf("long")
    def scanned(maps: pd.Series) -> pd.Series:
        t = transducer(vocabulary)
        return pd.Series([t.scan([StateMap(m["head"], m["count"], m["tail"], m["cut"]) for m in ms]) for ms in maps], dtype="int64")

    maps = chunks.select("doc_id", "_hash", "n_bytes", "_no", mapped("_chunk", "_no", "_n").alias("_map"))
    # Repeated rows have the same maps: the set keeps one of each, and the first chunk counts the rows.
    per_text = maps.groupBy("doc_id", "_hash", "n_bytes").agg(
        F.sort_array(F.collect_set(F.struct("_no", "_map"))).alias("_maps"),
        F.sum(F.when(F.col("_no") == 0, 1).otherwise(0)).alias("_rows"),
    )
    return per_text.select(
        "doc_id",
        "n_bytes",
        scanned(F.transform("_maps", lambda m: m["_map"])).alias("n_tokens"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_row"),
    ).drop("_row")
