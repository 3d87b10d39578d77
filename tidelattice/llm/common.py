"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Largest serialized side that may be broadcast; a larger side is shuffled.
BROADCAST_BYTES = 8_000_000


def keep(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder; later reads survive lost executors."""
    return cut_lineage(df)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    return base if base.lower() not in taken else f"{base}_{uuid.uuid4().hex[:8]}"


def crc_of_id(doc_id: str) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def broadcast_if_light(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the measured bytes fit; otherwise the join shuffles.

    `row_bytes` is the size of one row. Read a materialised table with this.
    """
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def stored(df: DataFrame) -> DataFrame:
    """Write a table once into the shared checkpoint folder and read it back.

    Like `keep`, but in columns and compressed: for large intermediate tables of which
    later steps read a few columns.
    """
    spark = df.sparkSession
    keep(spark.range(0))  # sets the folder where none is configured
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
