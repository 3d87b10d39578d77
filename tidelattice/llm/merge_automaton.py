"""Byte-pair merges compiled into a deterministic finite-state transducer.

A split of a word into tokens is the one the merges give exactly if every two
neighbouring tokens stay apart when merged on their own. So the last token of each
prefix follows from the last tokens of shorter prefixes: it is the only token that
ends the prefix and stays apart from the last token of what precedes it.

A state is what later letters can still depend on: the ends of the input that may begin
a token, each with the last token before it and the tokens counted up to there, relative
to now. A transition reads one letter and is annotated with
the tokens it emits: the growth of the prefix's count, below zero where the letter
joins what were several tokens. States are compiled from the vocabulary when they are
first reached; at any time the table is a part of one fixed machine.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

# States kept per worker; beyond, the table is emptied and compiled again where needed.
STATES = 300_000
_NEVER = 1 << 60


# An end that may begin a token (its place in the trie of tokens), the last token before it
# (its place, 0 at the start of the word), and the tokens before it less the tokens now.
Open = tuple[int, int, int]
# Keys are pairs of numbers in one: a place or state and the code of a letter.
_CODE_BITS = 21


class MergeAutomaton:
    """Counts the tokens of pre-tokens written in the letters of the vocabulary.

    `letters` are the tokens that no merge makes, `merges` the pairs in order of rank.
    A letter outside the vocabulary raises KeyError.
    """

    def __init__(self, letters: Iterable[str], merges: Iterable[tuple[str, str]], states: int = STATES) -> None:
        self.letters = set(letters)
        self.rank: dict[tuple[str, str], int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), rank)
            if self.halves.setdefault(a + b, (a, b)) != (a, b):
                raise ValueError(f"two merges make {a + b!r}")
        self._right: dict[str, list[tuple[str, int]]] = {}
        self._left: dict[str, list[tuple[str, int]]] = {}
        # A token whose own halves do not stay whole until they meet is never the result of merging.
        self.tokens = set(self.letters)
        for token, (a, b) in self.halves.items():
            if a in self.tokens and b in self.tokens and self._meet(a, b) == (a, b):
                self.tokens.add(token)
        self._trie: dict[int, int] = {}
        self._name: list[str] = [""]
        for token in self.tokens:
            place = 0
            for n, letter in enumerate(token, 1):
                key = place << _CODE_BITS | ord(letter)
                place = self._trie.get(key, 0)
                if not place:
                    place = self._trie[key] = len(self._name)
                    self._name.append(token[:n])
        self._whole = {place for place, name in enumerate(self._name) if name in self.tokens}
        self._apart: dict[int, bool] = {}
        self.limit = states
        self._reset()

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        """From a tokenizer file of plain byte-pair merges: one merge a token, nothing that changes the text before."""
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        changed = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or changed or parts.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-pair vocabulary: {changed or model.get('type')}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        return cls((t for t in model["vocab"] if t not in made and len(t) == 1), merges)

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts at one edge of a token, smallest first, each with the rank of the merge that ends it."""
        kept = (self._left, self._right)[side]
        found = kept.get(token)
        if found is None:
            part, ended, found = token, _NEVER, []
            while True:
                found.append((part, ended))
                if part not in self.halves:
                    break
                ended = self.rank[self.halves[part]]
                part = self.halves[part][side]
            found.reverse()
            kept[token] = found
        return found

    def _meet(self, a: str, b: str) -> tuple[str, str] | None:
        """The first two parts of `a` and `b` that merge across their border, if any do."""
        right, left = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            rank = self.rank.get((x, y), _NEVER)
            # Of equal pairs the left one merges first: within `a` before the border, the border before `b`.
            if rank < x_ends and rank <= y_ends and rank < _NEVER:
                return x, y
            if x_ends == y_ends == _NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _stay_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) >= 4 * self.limit:
                self._apart.clear()
            found = self._apart[key] = self._meet(self._name[a], self._name[b]) is None
        return found

    def _reset(self) -> None:
        self._steps: dict[int, tuple[int, int]] = {}
        self._number: dict[tuple[Open, ...], int] = {}
        self._ends: list[tuple[Open, ...]] = []
        self._state(((0, 0, 0),))  # the first state has the number 0

    def _state(self, ends: tuple[Open, ...]) -> int:
        number = self._number.setdefault(ends, len(self._ends))
        if number == len(self._ends):
            self._ends.append(ends)
        return number

    def _compile(self, state: int, letter: str) -> tuple[int, int]:
        """The transition of a state for a letter: the next state and the tokens emitted."""
        if letter not in self.letters:
            raise KeyError(letter)
        code, trie = ord(letter), self._trie
        last, emitted, longer = 0, 0, []
        for place, before, count in self._ends[state]:
            grown = trie.get(place << _CODE_BITS | code)
            if grown is not None:
                longer.append((grown, before, count))
                if not last and grown in self._whole and (not before or self._stay_apart(before, grown)):
                    last, emitted = grown, count + 1
        ends = [(place, before, count - emitted) for place, before, count in longer]
        ends.append((0, last, 0))
        step = self._steps[state << _CODE_BITS | code] = self._state(tuple(ends)), emitted
        return step

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        if len(self._ends) > self.limit:
            self._reset()
        steps, state, total = self._steps, 0, 0
        for letter in word:
            step = steps.get(state << _CODE_BITS | ord(letter))
            if step is None:
                step = self._compile(state, letter)
                if len(self._ends) > 2 * self.limit:
                    # Within one very long word: only the state it has reached is needed to go on.
                    reached = self._ends[step[0]]
                    self._reset()
                    steps, step = self._steps, (self._state(reached), step[1])
            state, emitted = step
            total += emitted
        return total
