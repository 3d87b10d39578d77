"""Reserved-term screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread
from . import Catalog
from .adapters import table, with_cte

C = Catalog()
PHRASES = (
    "",
    "A Tsunami Warning Center note.",
    "All-Clear given",
    "the ADVISORIES and watches",
    "forewarning only",
    "Information   Statements out",
    "AlI CIear " + X.DISCLAIMER,
    "Threat_Message, bulletin",
    "wаrning and Wärning, ＷａＴｃＨ",
    X.DISCLAIMER,
)


def marked_text(column, key, count=8):
    """The whole text with a phrase after it, so that hits occur in the invented prose."""
    phrase = F.array(*[F.lit(p) for p in PHRASES[:count]])[(key % count).cast("int")]
    return F.concat(column, F.lit(" "), phrase)


def marked_sql(column, key, count=8):
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES[:count])
    return f"{column} || ' ' || [{listed}][CAST({key} % {count} AS INT) + 1]"


_PATTERN_SQL = X.ASCII_PATTERN.replace("'", "''")
TEXTS = f"""texts AS (SELECT 'documents' AS origin, doc_id AS id, {marked_sql('text', 'doc_id')} AS body FROM documents
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, {marked_sql('text', 'turn')} FROM conversations
  UNION ALL SELECT 'pages', page_id, {marked_sql('html', 'page_id')} FROM pages),
plain AS (SELECT origin, id, regexp_replace(body, '[^\\x00-\\x7F]', 'x', 'g') AS body FROM texts),
hits AS (SELECT origin, id, list_filter(regexp_extract_all(body, '{_PATTERN_SQL}', 1), lambda x: x <> '') AS hits FROM plain)"""


def texts(spark, sf_dir, count=8):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), marked_text(F.col("text"), F.col("doc_id"), count).alias("body")
    )
    talks = table(spark, sf_dir, "conversations").select(
        F.lit("conversations"), F.col("conv_id") * 1000 + F.col("turn"), marked_text(F.col("text"), F.col("turn"), count)
    )
    pages = table(spark, sf_dir, "pages").select(F.lit("pages"), "page_id", marked_text(F.col("html"), F.col("page_id"), count))
    return docs.union(talks).union(pages)


@C.add("scan_terms_ascii", with_cte(TEXTS, body="SELECT origin, id, len(hits) AS n_hits, lower(array_to_string(hits, ';')) AS found FROM hits"))
def scan_terms_ascii(spark, sf_dir):
    plain = F.regexp_replace("body", r"[^\x00-\x7F]", "x")
    rows = texts(spark, sf_dir).select("origin", "id", X.ascii_hits(plain).alias("hits"))
    return rows.select("origin", "id", F.size("hits").cast("long").alias("n_hits"), F.lower(F.array_join("hits", ";")).alias("found"))


@C.add("scan_terms")
def scan_terms(spark, sf_dir):
    rows = spread(texts(spark, sf_dir, len(PHRASES))).select("origin", "id", X.scan_terms(F.col("body"), X.lookalikes(spark)).alias("s"))
    terms = F.array_join(F.transform("s.violations", lambda v: v["term"]), ";")
    return rows.select("origin", "id", F.size("s.violations").alias("n_hits"), terms.alias("terms"), "s.has_disclaimer", "s.passed")


@C.add("fold_text")
def fold_text(spark, sf_dir):
    rows = spread(texts(spark, sf_dir, len(PHRASES))).select("origin", "id", X.fold_text(F.col("body"), X.lookalikes(spark)).alias("folded"))
    return rows.select("origin", "id", F.length("folded").alias("n_chars"), F.sha2("folded", 256).alias("folded_hash"))


@C.add("scan_nested")
def scan_nested(spark, sf_dir):
    """The scanner on every string inside a nested value, names and keys included."""
    body = marked_text(F.col("text"), F.col("turn"), len(PHRASES))
    nested = F.struct(F.array(body).alias("watch"), F.create_map(F.lit("bulletin"), F.col("turn")).alias("extra"))
    rows = spread(table(spark, sf_dir, "conversations")).select("conv_id", nested.alias("value"))
    inside = rows.select("conv_id", F.explode(X.strings_inside(F.col("value"), rows.schema["value"].dataType)).alias("s"))
    found = inside.select("conv_id", X.scan_terms(F.col("s"), X.lookalikes(spark)).alias("f"))
    return found.groupBy("conv_id").agg(F.sum(F.size("f.violations")).alias("n_hits"), F.count(F.lit(1)).alias("n_strings"))
