"""From raw documents to packed sequences: five stages, each written and read again.

Every stage takes the documents that the stage before kept and returns documents;
the last returns packed sequences. Null and empty texts pass through the stages
that keep them with the results their operators define; extra columns of the input
are dropped; repeated rows stay rows until the near-duplicate stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelattice.llm import mixing, packing, quality_neighbours, shingles, suffix_dedup
from tidelattice.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A document is rejected if its neighbours give it less than this chance of being good.
LEAST_QUALITY = 0.3
# Repeated passages of so many words are cut; 99 % of such passages have so many bytes.
REPEATED_WORDS, REPEATED_BYTES = 51, 229

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest-neighbour voting does not reject; an empty text gets the prior."""
    docs = docs.select(*COLUMNS)
    voter = quality_neighbours.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 4, 2)
    scored = docs.withColumn("score", quality_neighbours.score(voter)("text"))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, nulls last.

    Near copies are texts whose 5-word shingles have a Jaccard similarity of 0.8 or
    more, and what such texts connect. Of rows with the same id the smallest text
    stays, a null text last. Ids play no part in the groups: rows that share one but
    belong to different groups all stay.
    """
    keyed = docs.select(*COLUMNS, shingles.text_key().alias("t"))
    rooted = keyed.select("doc_id", "t").join(shingles.near_copies(docs.select(*COLUMNS)), "t")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    least = rooted.groupBy("root").agg(F.min(order).alias("least"))
    chosen = rooted.join(least, "root").where(order == F.col("least")).select("t", F.col("doc_id").alias("id"), "root").distinct()
    rows = keyed.join(chosen, "t").where(F.col("doc_id").eqNullSafe(F.col("id")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text", "doc_id", "lang", "source", "n_chars")).alias("d"))
    return first.select("d.*").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words or 400 bytes that occur elsewhere; n_chars follows the text."""
    done = suffix_dedup.remove_repeats(docs.select(*COLUMNS), length=REPEATED_BYTES, carry=("lang", "source"), words=REPEATED_WORDS)
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one row per draw, shard by shard; a trimmed draw has its first words."""
    docs = docs.select(*COLUMNS)
    draws, _ = mixing.mix(docs)
    texts = mixing.drawn_texts(docs, draws)
    return texts.repartition("shard").sortWithinPartitions("shard", "place").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    return packing.pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_neighbours", good_quality),
    ("simhash", one_of_each),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

# Classifiers, hashes and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each stored in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(out) if i < len(STAGES) - 1 else out
    return docs
