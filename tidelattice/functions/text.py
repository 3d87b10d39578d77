"""Screening prose for reserved terms, with Unicode folding.

Plain ASCII texts are judged by regular expressions on the JVM; only texts that
may hold a term, or that need folding, travel to an Arrow function.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reserved terms, proper nouns that may hold one, and the line every text must carry.
RESERVED_TERMS = (
    "Warning",
    "Advisory",
    "Watch",
    "Information Statement",
    "Threat Message",
    "Cancellation",
    "All Clear",
    "Bulletin",
)
PROPER_NOUNS = (
    "Tsunami Warning Center",
    "Pacific Tsunami Warning Center",
    "National Tsunami Warning Center",
    "Tsunami Bulletin Board",
)
DISCLAIMER = "Non-authoritative situational awareness. Not an official NOAA tsunami message."
# Joiners that build one word, shapes read as another letter, and characters that show nothing.
JOINERS = "-_/.:~|\u2010\u2011\u2012\u2013\u2014\u2015\u2017\u2043\u2212\u2e17\u2e3a\u2e3b\u2215\u2044\u29f8\ua789\u02d0\u0589\u05c3\u2e2e\u30fb\u00b7\u2022\u2e31\u00a6"
SHAPES = {"I": "l", "1": "l", "|": "l", "0": "o"}
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u2028\u2029\u202f\u2800\u3164\uffa0\ufffc"
CONTEXT_CHARS = 30


def _letters_by_name() -> dict[str, str]:
    """Small capitals and barred, hooked or similar Latin letters, by their Unicode names."""
    found = {}
    named = re.compile(r"LATIN (?:LETTER SMALL CAPITAL|(SMALL|CAPITAL) LETTER) ([A-Z])(?: WITH .+)?$")
    for code in (*range(0x0180, 0x02B0), *range(0x1D00, 0x1DC0), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800)):
        match = named.match(unicodedata.name(chr(code), ""))
        if match:
            found[chr(code)] = match[2] if match[1] == "CAPITAL" else match[2].lower()
    return found


_NAMED = _letters_by_name()
_SHAPE = str.maketrans(SHAPES)
_FAR = re.compile(r"([^\x00-\x7F]+)")


def _class_of(test) -> str:
    """Character class of all code points that pass the test."""
    return "".join(re.escape(chr(c)) for c in range(0x80, 0x110000) if test(chr(c)))


_UNSEEN = re.compile("[\ufe00-\ufe0f\U000e0100-\U000e01ef" + INVISIBLE + _class_of(lambda c: unicodedata.category(c) == "Cf") + "]")
_MARKS = re.compile("[" + _class_of(unicodedata.combining) + "]")


def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Characters that the published Unicode data calls confusable with ASCII letters or digits.

    The data come with the ICU library among Spark's own jars; all characters are asked
    in one call. A letter whose own look is not ASCII is judged by its capital.
    """
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    chars = [c for c in map(chr, [*range(0x80, 0xD800), *range(0x10000, 0x20000)]) if unicodedata.category(c)[0] in "LNS"]

    def looks(of: list[str]) -> list[str]:
        return [_bare(x, _NAMED) for x in checker.getSkeleton("\n".join(of)).split("\n")]

    capitals = [c.upper() if len(c.upper()) == 1 else c for c in chars]
    table = {}
    for char, look, capital in zip(chars, looks(chars), looks(capitals), strict=True):
        shown = look if look.isascii() else capital.lower()
        if shown.isascii() and shown.isalnum():
            table[char] = shown
    return table


def read_confusables(lines: Iterable[str]) -> dict[str, str]:
    """The same table from the published text format (`code ; code ... ; type`), ASCII targets only."""
    table = {}
    for line in lines:
        parts = line.split("#")[0].split(";")
        if len(parts) >= 2:
            source, target = ("".join(chr(int(c, 16)) for c in p.split()) for p in parts[:2])
            if len(source) == 1 and not source.isascii() and target.isascii() and target.isalnum():
                table[source] = target
    return table


def _bare(text: str, table: dict[str, str]) -> str:
    spread = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
    return "".join(table.get(c, c) for c in _MARKS.sub("", spread))


class _Characters(dict):
    """What each character folds to, worked out when it is first met."""

    def __init__(self, fold: Callable[[str], str]) -> None:
        super().__init__()
        self.fold = fold

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = folded = char if code < 0x80 else "" if _UNSEEN.match(char) else self.fold(char)
        return folded


def _with_every_other(parts: list[str], shown: list[str]) -> list[str]:
    out = parts.copy()
    out[1::2] = shown
    return out


class Folding:
    """Folds a text character by character, so a place in the folded text is a place in the text.

    `table` maps characters to the ASCII they look like (`lookalikes`,
    `read_confusables`); letters named after a Latin one fold without it. The first
    view reads look-alikes before normalising, the second only after it.
    """

    def __init__(self, table: dict[str, str] | None = None) -> None:
        known = _NAMED | (table or {})
        self.first = _Characters(lambda c: _bare(known.get(c, c), known))
        self.second = _Characters(lambda c: _bare(c, known))

    def views(self, text: str) -> list[tuple[str, _Characters]]:
        if text.isascii():
            return [(text, self.first)]
        # Most of a text is ASCII, which folds to itself; every other part is beyond it.
        parts = _FAR.split(text)
        first, second = ([r.translate(c) for r in parts[1::2]] for c in (self.first, self.second))
        views = [(first, self.first)] if first == second else [(first, self.first), (second, self.second)]
        return [("".join(_with_every_other(parts, shown)), c) for shown, c in views]


def places(text: str, characters: _Characters) -> Callable[[int], int]:
    """Where the character that shows at a place of the text's view stands in the text."""
    # Only characters beyond ASCII show as more or fewer than one.
    far = [i for run in _FAR.finditer(text) for i in range(*run.span())]
    more = list(accumulate((len(characters[ord(text[i])]) - 1 for i in far), initial=0))
    ends = [i + 1 + m for i, m in zip(far, more[1:], strict=True)]

    def place(at: int) -> int:
        k = bisect_right(ends, at)
        return min(at - more[k], far[k] if k < len(far) else len(text))

    return place


def place_in(text: str, view: str, characters: _Characters, at: int) -> int:
    """Where the character that shows as `view[at]` stands in the text."""
    if len(view) == len(text) and text.isascii():
        return at
    return places(text, characters)(at)


_PLAIN_FOLDING = Folding()


# Accepted forms of the last word of a term or name.
WORD_FORMS = {
    "Warning": ("warning", "warnings"),
    "Advisory": ("advisory", "advisories"),
    "Watch": ("watch", "watches"),
    "Statement": ("statement", "statements"),
    "Message": ("message", "messages"),
    "Cancellation": ("cancellation", "cancellations"),
    "Clear": ("clear", "clears"),
    "Bulletin": ("bulletin", "bulletins"),
    "Center": ("center", "centers"),
    "Board": ("board", "boards"),
}
_SEPARATOR = r"(?:\s+|[" + re.escape(JOINERS) + r"]+)?"
_BETWEEN = re.compile(r"[\s" + re.escape(JOINERS) + "]+")


def written_forms(term: str) -> list[list[str]]:
    """The words of a term in lower case, once for each form of the last word."""
    words = term.split()
    return [[w.lower() for w in words[:-1]] + [form] for form in WORD_FORMS[words[-1]]]


def lowered(text: str) -> str:
    """Lower case, place by place, with the letters that a pattern without case takes for ASCII ones."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    return text.lower()


def shaped_like(text: str) -> str:
    for shape, letter in SHAPES.items():
        text = text.replace(shape, letter)
    return text


class _Finder:
    """Finds written forms and names the term of each, by the letters that matched.

    The pattern runs from the first place where a form can begin: its first word stands
    there and its other words are somewhere in the text.
    """

    def __init__(self, terms: Iterable[str], respell: Callable[[str], str] = str) -> None:
        self.term_of: dict[str, str] = {}
        spelled = []
        words_of: set[tuple[str, ...]] = set()
        for term in terms:
            for words in written_forms(term):
                # Shapes are read off the term as it is written, in either case.
                for shown in {respell(" ".join(words)), respell(" ".join(w.capitalize() for w in words))}:
                    self.term_of[shown.replace(" ", "").lower()] = term
                    spelled.append(_SEPARATOR.join(map(re.escape, shown.split())))
                    words_of.add(tuple(shown.lower().split()))
        spelled.sort(key=len, reverse=True)
        self.pattern = re.compile(rf"\b(?:{'|'.join(spelled)})\b", re.IGNORECASE)
        # A form that begins with another one is found with it.
        self.words = [w for w in words_of if not any(v != w and v[:-1] == w[:-1] and w[-1].startswith(v[-1]) for v in words_of)]

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(term, start, end)"""
        low = lowered(text)
        starts = [at for first, *others in self.words if all(w in low for w in others) and (at := low.find(first)) >= 0]
        if not starts:
            return []
        return [(self.term_of[_BETWEEN.sub("", low[m.start() : m.end()])], *m.span()) for m in self.pattern.finditer(text, min(starts))]


_PLAIN = _Finder(RESERVED_TERMS)
_SHAPED = _Finder(RESERVED_TERMS, lambda t: t.translate(_SHAPE))
_NOUNS = _Finder(PROPER_NOUNS)


def strip_invisible(text: str) -> str:
    return text if text.isascii() else _UNSEEN.sub("", text)


def find_terms(text: str, folding: Folding = _PLAIN_FOLDING) -> tuple[list[tuple[str, int, str]], bool]:
    """(term, position, context) of each reserved term in the text, and whether the disclaimer is there."""
    hits: dict[tuple[str, int], str] = {}
    settled: set[str] = set()
    views = folding.views(text)
    for view, characters in views:
        shaped = shaped_like(view)
        matches = [*_PLAIN(view), *_SHAPED(shaped)]
        if not matches:
            continue
        excused = {i for v in (view, shaped) for _, start, end in _NOUNS(v) for i in range(start, end)}
        place = places(text, characters)
        for term, start, end in matches:
            # The second view only adds terms the first one neither reported nor excused.
            if term not in settled and excused.isdisjoint(range(start, end)):
                first, last = place(start), place(end - 1)
                hits.setdefault((term, first), text[max(0, first - CONTEXT_CHARS) : last + 1 + CONTEXT_CHARS])
        settled |= {term for term, _, _ in matches}
    found = sorted((position, term, context) for (term, position), context in hits.items())
    return [(term, position, context) for position, term, context in found], DISCLAIMER in views[0][0]


# Java and RE2 read this the same way; proper nouns come first so they swallow the term inside them.
_ASCII_SEPARATOR = r"(?:\s+|[-_/.:~|]+)?"


def _ascii(terms: Iterable[str], respell: Callable[[str], str] = str) -> str:
    return "|".join(_ASCII_SEPARATOR.join(respell(w) for w in words) for t in terms for words in written_forms(t)[::-1])


_ASCII_NOUN = _ascii(("Tsunami Warning Center", "Tsunami Bulletin Board"))
_ASCII_TERM = _ascii(RESERVED_TERMS)
ASCII_PATTERN = rf"(?i)\b(?:{_ASCII_NOUN}|({_ASCII_TERM}))\b"


def ascii_hits(text: Column) -> Column:
    """Reserved terms of an ASCII text as written, in order; proper nouns excused. JVM only."""
    return F.filter(F.regexp_extract_all(text, F.lit(ASCII_PATTERN), F.lit(1)), lambda x: x != "")


def may_hold_term(text: Column) -> Column:
    """False only for texts no term can be in: ASCII, and no match as it is or by shape."""
    plain = text.rlike(rf"(?i)\b(?:{_ASCII_TERM})\b")
    shaped = F.translate(text, "".join(SHAPES), "".join(SHAPES.values())).rlike(
        rf"(?i)\b(?:{_ascii(RESERVED_TERMS, lambda w: w.capitalize().translate(_SHAPE).lower())}|{_ascii(RESERVED_TERMS, lambda w: w.translate(_SHAPE))})\b"
    )
    return text.rlike(r"[^\x00-\x7F]") | plain | shaped


FOUND = T.StructType(
    [
        T.StructField(
            "violations",
            T.ArrayType(
                T.StructType(
                    [T.StructField("term", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("context", T.StringType())]
                )
            ),
        ),
        T.StructField("has_disclaimer", T.BooleanType()),
    ]
)


def _scanner(table: dict[str, str] | None):
    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        folding = Folding(table)
        for texts in batches:
            found = [find_terms(t, folding) if t is not None else ([], False) for t in texts]
            violations = [[{"term": t, "position": p, "context": c} for t, p, c in hits] for hits, _ in found]
            yield pd.DataFrame({"violations": violations, "has_disclaimer": [d for _, d in found]})

    return scan


def fold_text(text: Column, table: dict[str, str] | None = None) -> Column:
    """Visible, normalised, look-alike-folded text without marks."""

    @F.pandas_udf(T.StringType())
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        folding = Folding(table)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else folding.views(t)[0][0])

    return fold(text)


def scan_terms(text: Column, table: dict[str, str] | None = None) -> Column:
    """Struct of violations, disclaimer and pass; `table` holds look-alikes. Texts without a candidate never leave the JVM."""
    candidate = may_hold_term(text)
    far = _scanner(table)(F.when(candidate, text))
    hits = far["violations"]
    disclaimer = F.when(candidate, far["has_disclaimer"]).otherwise(F.contains(text, F.lit(DISCLAIMER)))
    return F.struct(hits.alias("violations"), disclaimer.alias("has_disclaimer"), ((F.size(hits) == 0) & disclaimer).alias("passed"))


def strings_inside(value: Column, kind: T.DataType) -> Column:
    """Every string inside a nested value, field names and map keys included, as one array."""
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(value))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.array(F.lit(f.name)), strings_inside(value[f.name], f.dataType)) for f in kind.fields]
        return F.coalesce(F.concat(*parts), F.array().cast("array<string>"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings_inside(x, kind.elementType))), F.array().cast("array<string>"))
    if isinstance(kind, T.MapType):
        keys, values = F.map_keys(value), F.map_values(value)
        inner = F.flatten(F.transform(values, lambda x: strings_inside(x, kind.valueType)))
        return F.coalesce(F.concat(keys.cast("array<string>"), inner), F.array().cast("array<string>"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.array().cast("array<string>")
    return F.array_compact(F.array(value.cast("string")))
