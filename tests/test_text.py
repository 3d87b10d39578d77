"""Reserved terms: plain, plural, joined, hidden, look-alike, and inside proper nouns."""

import re

import pytest
from pyspark.sql import functions as F

from tidelattice.functions import text as X


@pytest.mark.parametrize(
    "given, terms",
    [
        ("A Warning and two ADVISORIES", ["Warning", "Advisory"]),
        ("watches", ["Watch"]),
        ("Information\tStatements", ["Information Statement"]),
        ("All/Clear, All--Clear, AllClear", ["All Clear"] * 3),
        ("that is all - clear skies ahead", []),
        ("forewarning", []),
        ("Warn​ing", ["Warning"]),
        ("Wärning", ["Warning"]),
        ("ＷＡＲＮＩＮＧ", ["Warning"]),
        ("ᴡᴀʀɴɪɴɢ", ["Warning"]),
        ("CanceIlation", ["Cancellation"]),
        ("B0gus Bu1letin", ["Bulletin"]),
        ("the Pacific Tsunami Warning Center said", []),
        ("Tsunami Bulletin Boards and a bulletin", ["Bulletin"]),
    ],
)
def test_find_terms(given, terms):
    assert [t for t, _, _ in X.find_terms(given)[0]] == terms


def test_spark_form_agrees_and_positions_point_at_the_term(spark):
    texts = ["x" * 50 + " All Clear " + "y" * 50, X.DISCLAIMER, "plain", "AlI Clear", "café Wаtch " + X.DISCLAIMER, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", X.scan_terms(F.col("t")).alias("s")).orderBy("i").collect()
    for r, t in zip(rows[:-1], texts):
        hits, disclaimer = X.find_terms(t)
        assert [(v["term"], v["position"], v["context"]) for v in r["s"]["violations"]] == hits
        assert r["s"]["has_disclaimer"] == disclaimer and r["s"]["passed"] == (not hits and disclaimer)
    first = rows[0]["s"]["violations"][0]
    assert first["position"] == 51 and first["context"] == "x" * 29 + " All Clear " + "y" * 29


def test_jvm_filter_never_hides_a_hit(spark):
    texts = ["warnings", "A1l C1ear", "al1-clear", "threat_message", "nothing here", "advisor y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    flags = [r[0] for r in df.select(X.may_hold_term(F.col("t"))).collect()]
    assert all(flag or not X.find_terms(t)[0] for flag, t in zip(flags, texts))
    assert flags[4] is False


# A few lines in the published format.
CONFUSABLES = ["0430 ;\t0061 ;\tMA\t# comment", "0441 ; 0063 ; MA", "# nothing", "", "0072 006E ; 006D ; MA", "2170 ; 0069 ; MA"]


def test_a_callers_table_of_lookalikes():
    table = X.read_confusables(CONFUSABLES)
    assert table == {"\u0430": "a", "\u0441": "c", "\u2170": "i"}
    folding = X.Folding(table)
    assert [t for t, _, _ in X.find_terms("W\u0430t\u0441h", folding)[0]] == ["Watch"]
    assert X.find_terms("W\u0430t\u0441h")[0] == []


def test_every_published_lookalike_of_a_term_is_found(spark):
    """One letter at a time is replaced by each character that Unicode data calls its look-alike."""
    table = X.lookalikes(spark)
    folding = X.Folding(table)
    by_letter = {}
    for char, look in table.items():
        by_letter.setdefault(look, []).append(char)
    for given in ("W\u0251rning", "Bulle\u03c4in", "Wat\u03f2h", "W\u0430rning", "\u0410dvisory"):
        assert len(X.find_terms(given, folding)[0]) == 1, given
    tried = 0
    for term in X.RESERVED_TERMS:
        for at, letter in enumerate(term):
            for char in by_letter.get(letter, ()):
                tried += 1
                assert [t for t, _, _ in X.find_terms(term[:at] + char + term[at + 1 :], folding)[0]] == [term], (term, char)
    assert tried > 500


def test_positions_point_into_the_scanned_text():
    text = "\u00e9\u200b\ufb01 xx W\u00e4rn\u200bing, and 1 more"
    ((term, position, context),), _ = X.find_terms(text)
    assert term == "Warning" and position == text.index("W") and context == text[: text.index("g,") + 1 + 30]


def test_nested_strings_are_scanned_as_they_are(spark):
    rows = spark.createDataFrame([(1, "W\u0430tch this"), (1, "calm"), (2, "AlI CIear")], "conv_id long, text string")
    nested = rows.select("conv_id", F.struct(F.array("text").alias("watch")).alias("value"))
    inside = nested.select("conv_id", F.explode(X.strings_inside(F.col("value"), nested.schema["value"].dataType)).alias("s"))
    found = inside.select("conv_id", "s", F.size(X.scan_terms(F.col("s"), X.lookalikes(spark))["violations"]).alias("n")).collect()
    assert sorted((r.conv_id, r.s, r.n) for r in found) == [
        (1, "W\u0430tch this", 1), (1, "calm", 0), (1, "watch", 1), (1, "watch", 1), (2, "AlI CIear", 1), (2, "watch", 1)
    ]


def test_lowered_is_what_a_pattern_without_case_matches():
    """Place by place; İ, ı, ſ and the Kelvin sign stand for ASCII letters there."""
    text = "".join(chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    low = X.lowered(text)
    assert len(low) == len(text)
    matched = {m.start() for m in re.finditer("[a-z]", text, re.IGNORECASE)}
    assert matched == {i for i, c in enumerate(low) if c.isascii()}


def test_terms_in_letters_that_only_ignoring_case_reads():
    # Found by the pattern, but the letters that matched named no term.
    found, _ = X.find_terms("x" * 50 + " bullet\u0131n and watch")
    assert [(term, at) for term, at, _ in found] == [("Bulletin", 51), ("Watch", 64)]


def test_places_of_terms_are_found_once_a_view(monkeypatch):
    """A text with many terms and look-alikes is walked once, not twice for each term."""
    text = "\u00e9\ufb03\u200b watch " * 200
    walked = []
    monkeypatch.setattr(X, "places", lambda t, c, real=X.places: walked.append(1) or real(t, c))
    found, _ = X.find_terms(text)
    assert [at for _, at, _ in found] == [text.index("watch") + 10 * i for i in range(200)]
    assert len(walked) <= 2
