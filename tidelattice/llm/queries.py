"""One thin query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Catalog
from . import mixing, packing, pivot_search, quality_neighbours, quality_rules, simhash, spherical_caps, suffix_dedup, token_alignment, token_counts, toxicity, turn_repair, url_filters
from .learning import held_out

C = Catalog()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _predictions(docs: DataFrame, scored, folds: int, fold: int) -> DataFrame:
    rows = docs.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), scored("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@C.add("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("f")).alias("fingerprint"), "component_id")


@C.add("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1)
    return _predictions(docs, toxicity.score(machine), 3, 1)


@C.add("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(table(spark, sf_dir, "documents"))
    return documents


@C.add("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@C.add("op5_quality_neighbours")
def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voter = quality_neighbours.fit(docs, table(spark, sf_dir, "labels"), "quality", 4, 2)
    return _predictions(docs, quality_neighbours.score(voter), 4, 2)


@C.add("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


@C.add("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@C.add("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept_text"
    )


def dated_pages(pages: DataFrame) -> DataFrame:
    """Captures with a fetch day; the table has none, so the id gives it."""
    return pages.withColumn("day", (F.col("page_id") * 101) % 3000)


def list_changes(pages: DataFrame) -> DataFrame:
    """A log of list changes from the pages themselves: hosts, parent domains and first path segments."""
    host = url_filters.host_of(F.col("url"))
    turn = F.col("page_id") % 20
    first = F.concat(host, F.lit("/"), F.get(url_filters.segments_of(F.col("url")), 0))
    entry = F.when(turn.isin(0, 1), host).when(turn.isin(2, 3), first).when(F.col("page_id") % 400 == 4, F.regexp_replace(host, r"^[^.]*\.", ""))
    action = F.when(turn.isin(0, 2, 4), "add").otherwise("remove")
    return pages.select(entry.alias("entry"), ((F.col("page_id") * 37) % 3000).alias("day"), action.alias("action")).where("entry is not null")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, (page_id * 101) % 3000 AS day, (page_id * 37) % 3000 AS change_day,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg
  FROM pages
), changes AS (
  SELECT change_day AS day,
    CASE WHEN page_id % 20 IN (0, 1) THEN host WHEN page_id % 20 IN (2, 3) THEN host || '/' || seg[1]
      WHEN page_id % 400 = 4 THEN regexp_replace(host, '^[^.]*\.', '') END AS entry,
    CASE WHEN page_id % 20 IN (0, 2, 4) THEN 'add' ELSE 'remove' END AS action
  FROM p
), daily AS (
  SELECT entry, day, max(action) AS action FROM changes WHERE entry IS NOT NULL GROUP BY entry, day
), turns AS (
  SELECT * FROM (SELECT *, coalesce(lag(action) OVER (PARTITION BY entry ORDER BY day), 'remove') AS before FROM daily) WHERE action <> before
), intervals AS (
  SELECT entry, day AS valid_from, valid_to, action
  FROM (SELECT *, lead(day) OVER (PARTITION BY entry ORDER BY day) AS valid_to FROM turns) WHERE action = 'add'
), keyed AS (
  SELECT page_id, day, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[1:i], '/')))) AS entry
  FROM p WHERE host <> ''
), hits AS (
  SELECT k.page_id, k.entry, i.valid_from,
    row_number() OVER (PARTITION BY k.page_id ORDER BY length(k.entry) DESC, k.entry) AS rn, count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keyed k JOIN intervals i ON k.entry = i.entry AND i.valid_from <= k.day AND (i.valid_to IS NULL OR k.day < i.valid_to)
)
SELECT p.page_id, p.day, h.n IS NOT NULL AS blocked, coalesce(h.n, 0) AS n_matches, h.entry, h.valid_from
FROM p LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h USING (page_id)
"""


@C.add("op9_url_filters", OP9_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_captures(dated_pages(pages), list_changes(pages))


@C.add("op10_embedding_dedup")
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_caps.near_vectors(table(spark, sf_dir, "embeddings"))


@C.add("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = turn_repair.damaged(conversations)
    return turn_repair.digests(conversations, rows, turn_repair.repair(rows))


@C.add("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.alignments(table(spark, sf_dir, "documents"), *paths)


@C.add("op13_pivot_search")
def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
