"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document whose signal is above a cutoff. Per stratum and rule
the cutoffs of a fixed grid are tested from the most lenient to the strictest. A
cutoff passes if the exact binomial test says that it rejects less than its share
of `false_rejection` of the good documents; testing stops at the first failure, and
the last cutoff that passed is used. The level of each test is `error` divided by
the number of strata times rules (Bonferroni; a fixed sequence needs no more), and
`false_rejection` is divided by the number of rules, so with probability 1 - error
no stratum loses more than `false_rejection` of its good documents. A rule without
enough evidence rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import broadcast_if_light, keep

FALSE_REJECTION, ERROR = 0.02, 0.05
# Rule: (signal, cutoffs from lenient to strict). A signal is large for bad documents.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
    "repeated_lines": ("n_dup_lines / n_words", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01)),
    "repeated_words": ("n_repeat_words / n_words", (0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.09, 0.08, 0.07, 0.06, 0.05)),
    "long_words": ("word_chars / n_words", (50.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0)),
    "short_words": ("n_words / word_chars", (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_BLANKS = "\x20\t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    base = len(numbers)
    if base**window < 1 << 62:
        keys = np.zeros(n, dtype=np.int64)
        for i in range(window):
            keys = keys * base + ids[i : i + n]
    else:
        # Rank word by word, so that keys stay exact whatever the vocabulary.
        keys = ids
        for i in range(1, window):
            keys = np.unique(keys[: len(words) - i] * base + ids[i:], return_inverse=True)[1].astype(np.int64)
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, dtype=np.int64)
    hit = np.flatnonzero(counts[place] > 1)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    chars = len(text) - sum(text.count(c) for c in _BLANKS)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), repeats, repeated_words(words)


@F.pandas_udf(StructType([StructField(name, LongType()) for name in BASE]))
def base_columns(text: pd.Series) -> pd.DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text; all 0 for null."""
    return pd.DataFrame([base_counts(t) for t in text], columns=list(BASE), dtype="int64")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed away from the mean until terms vanish."""
    if n == 0 or k >= n:
        return 1.0
    lower = k <= n * p
    i = k if lower else k + 1
    log_term = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    term, total = math.exp(log_term), 0.0
    while 0 <= i <= n and term > 1e-18 * (total or 1e-300):
        total += term
        if lower:
            term *= i * (1 - p) / ((n - i + 1) * p)
            i -= 1
        else:
            term *= (n - i) * p / ((i + 1) * (1 - p))
            i += 1
    return min(1.0, total if lower else 1 - total)


def certified(passed_at: Iterable[tuple[int, int]], good: int, grid: tuple[float, ...], share: float, level: float) -> float | None:
    """The strictest cutoff reached before a test fails.

    `passed_at` holds (number of cutoffs of the grid that reject, good documents).
    """
    rejected = np.zeros(len(grid) + 1, dtype=np.int64)
    for hits, n in passed_at:
        # A signal above the i-th strictest cutoffs is rejected by the last `hits` cutoffs.
        rejected[len(grid) - hits] += n
    best = None
    for cutoff, k in zip(grid, np.cumsum(rejected[:-1])):
        if k >= good * share or binomial_tail(int(k), good, share) > level:
            break
        best = cutoff
    return best


def cutoffs(rows: DataFrame, good: DataFrame, stratum: str = "stratum", false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """(stratum, cutoff): a map from rule to cutoff for each stratum with a certified rule.

    `rows` has the base columns, `stratum` and `doc_id`; `good` the doc_id of labelled
    good documents. Rows that fail the base rule are no evidence.
    """
    tested = rows.where(~base_failed()).join(good, "doc_id")
    hits = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), sum((F.when(F.expr(signal) > c, 1).otherwise(0) for c in grid), F.lit(0)).alias("hits"))
            for name, (signal, grid) in RULES.items()
        ]
    )
    counted = tested.select(stratum, F.inline(hits)).groupBy(stratum, "rule", "hits").agg(F.count(F.lit(1)).alias("n"))
    tests = rows.select(stratum).distinct().count() * len(RULES)  # to correct for

    def certify(group: pd.DataFrame) -> pd.DataFrame:
        level = error / tests
        good_docs = int(group.loc[group["rule"] == next(iter(RULES)), "n"].sum())
        found = {}
        for name, (_, grid) in RULES.items():
            own = group[group["rule"] == name]
            best = certified(zip(own["hits"], own["n"]), good_docs, grid, false_rejection / len(RULES), level)
            if best is not None:
                found[name] = best
        return pd.DataFrame({stratum: [group[stratum].iloc[0]], "cutoff": [found]})

    # One group holds at most rules x grid rows, whatever the number of documents.
    return counted.groupBy(stratum).applyInPandas(certify, f"{stratum} string, cutoff map<string, double>")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
) -> DataFrame:
    """(doc_id, stratum, base columns, base_failed, cutoff, kept): one row per input row.

    Null texts count as empty and fail the base rule. A null stratum is a stratum of
    its own. Null ids are judged but are no evidence. Repeated rows are judged each
    for itself. Other columns are ignored. Empty tables give an empty result.
    """
    rows = keep(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("stratum"), base_columns(F.col(text).cast("string")).alias("b"))
        .select("doc_id", "stratum", "b.*")
    )
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = keep(cutoffs(rows, good, "stratum", false_rejection, error))
    light = broadcast_if_light(chosen, F.length("stratum") + 32 * (1 + F.size("cutoff")))
    joined = rows.join(light, "stratum", "left").withColumn("base_failed", base_failed())
    broken = F.lit(False)
    for name, (signal, _) in RULES.items():
        broken = broken | F.coalesce(F.expr(f"try_divide({signal.replace(' / ', ', ')})") > F.col("cutoff")[name], F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~broken)
