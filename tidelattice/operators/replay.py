"""Batch twins of the keyed streams: the same rows from a closed log, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitioned import BUCKET, with_previous

STATION = ["source_type", "station_id"]
REVISION_US = 30 * 86_400_000_000
EVENT_MODE_US = 4 * 3_600_000_000


def high_water(rows: DataFrame, bucket: Column, arrival: str = "seq") -> DataFrame:
    """Rows above the running maximum of what arrived before; gauges may equal it.

    The maximum crosses bucket borders as one number per bucket.
    """
    placed = rows.withColumn(BUCKET, bucket)
    by_key = Window.partitionBy(*STATION).orderBy(BUCKET)
    tops = placed.groupBy(*STATION, BUCKET).agg(F.max("ts_us").alias("_top")).withColumn(
        "_start", F.max("_top").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    )
    inside = Window.partitionBy(*STATION, BUCKET).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.join(tops.drop("_top"), [*STATION, BUCKET]).withColumn("_mark", F.greatest(F.max("ts_us").over(inside), F.col("_start")))
    mark = F.col("_mark")
    newer = mark.isNull() | (F.col("ts_us") > mark) | ((F.col("source_type") == "coops") & (F.col("ts_us") == mark))
    return seen.where(newer).drop(BUCKET, "_start", "_mark")


def revisions(rows: DataFrame, bucket: Column) -> DataFrame:
    """Messages whose version differs from the one before; thirty silent days count as never seen."""
    stepped = with_previous(rows, ["event_id"], ["ts_us", "seq"], ["ts_us", "version"], bucket)
    prev = F.col("prev")
    known = prev.isNotNull() & (F.col("ts_us") - prev["ts_us"] <= REVISION_US)
    return stepped.withColumn("is_revision", known).where(~known | (prev["version"] != F.col("version"))).drop("prev")


def event_mode(rows: DataFrame) -> DataFrame:
    """Mode of each buoy after each poll; readings fold to one row per poll before ordering."""
    polls = rows.groupBy("station_id", "poll").agg(
        F.max("ts_us").alias("now_us"),
        F.max(F.when(F.col("measurement_type").isin(2, 3), F.col("ts_us"))).alias("mark_us"),
        F.bool_and(F.col("measurement_type") == 1).alias("all_standard"),
    )
    recent = F.col("mark_us").isNotNull() & (F.col("now_us") - F.col("mark_us") < EVENT_MODE_US)
    said = F.when(recent, F.col("mark_us")).when(F.col("all_standard"), F.lit(-1).cast("long"))
    so_far = Window.partitionBy("station_id").orderBy("poll").rowsBetween(Window.unboundedPreceding, 0)
    observed = F.last("_said", ignorenulls=True).over(so_far)
    on = (F.col("_observed") >= 0) & (F.col("now_us") - F.col("_observed") < EVENT_MODE_US)
    return polls.withColumn("_said", said).withColumn("_observed", observed).select(
        "station_id", "poll", F.coalesce(on, F.lit(False)).alias("event_mode")
    )


def station_health(readings: DataFrame, errors: DataFrame, now_us: int) -> DataFrame:
    """OFFLINE after an error newer than the last data, STALE at twice the cadence without data, else ONLINE."""
    last = readings.groupBy(*STATION).agg(F.max(F.struct("ts_us", "seq", "expected_interval_sec")).alias("_l"))
    failed = errors.groupBy(*STATION).agg(F.max("ts_us").alias("error_us"))
    out = last.join(failed, STATION, "full_outer")
    newest = F.col("_l.ts_us")
    stale = now_us - newest >= F.col("_l.expected_interval_sec") * 2 * 1_000_000
    status = (
        F.when(F.col("error_us").isNotNull() & (newest.isNull() | (F.col("error_us") > newest)), "OFFLINE")
        .when(stale, "STALE")
        .otherwise("ONLINE")
    )
    return out.select(*STATION, newest.alias("last_us"), "error_us", status.alias("status"))
