"""Series hygiene: duplicates, spikes, level shifts, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GAP_FACTOR, HAMPEL_HALF, HAMPEL_SIGMAS, LEVEL_SAMPLES, MAD_SCALE, WINDOW_HOURS, WINDOW_MIN_SAMPLES
from ..session import cut_lineage
from .partitioned import exact_percentiles, number_rows, running_sum, settle, time_bucket, with_halo, with_previous

CHUNK_ROWS = 20_000
DAY = 86_400


def dedup_series(df: DataFrame, keys: Sequence[str], policy: str, value: str = "value") -> DataFrame:
    """One row per instant; the map side of the aggregate already collapses copies."""
    pick = {
        "first": F.min_by(value, "seq"),
        "last": F.max_by(value, "seq"),
        "min": F.min(value),
        "max": F.max(value),
        "mean": F.avg(value),
    }[policy]
    return df.groupBy(*keys, "ts_us").agg(pick.alias(value))


def dedup_policies(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """All five policies side by side from one shuffle."""
    return df.groupBy(*keys, "ts_us").agg(
        F.min_by(value, "seq").alias("first"),
        F.max_by(value, "seq").alias("last"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.count(F.lit(1)).alias("copies"),
    )


def duplicate_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    instants = df.groupBy(*keys, "ts_us").agg(
        F.count(F.lit(1)).alias("copies"), (F.max(value) - F.min(value)).alias("spread")
    )
    return instants.groupBy(*keys).agg(
        F.sum("copies").alias("rows_in"),
        F.count(F.lit(1)).alias("rows_out"),
        F.sum(F.col("copies") - 1).alias("duplicate_rows"),
        F.count_if(F.col("spread") > 0).alias("conflicting_instants"),
        F.max("spread").alias("largest_spread"),
    )


def array_median(values: Column) -> Column:
    ordered = F.sort_array(values)
    n = F.size(ordered)
    low = F.floor((n - 1) / 2).cast("int")
    high = F.floor(n / 2).cast("int")
    return (ordered[low] + ordered[high]) / 2


def number_series(df: DataFrame, keys: Sequence[str], bucket_seconds: int = 30 * DAY, total: str | None = None) -> DataFrame:
    return number_rows(df, keys, ["ts_us"], time_bucket("ts_us", bucket_seconds), "rn", total)


def hampel(numbered: DataFrame, keys: Sequence[str], value: str = "value", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Centred 7-point median and MAD rule on a numbered series; adds `cleaned`, `spike`."""
    spread = with_halo(numbered, "rn", chunk_rows, HAMPEL_HALF, HAMPEL_HALF)
    around = Window.partitionBy(*keys, "chunk").orderBy("rn").rowsBetween(-HAMPEL_HALF, HAMPEL_HALF)
    seen = spread.withColumn("_near", F.collect_list(value).over(around)).where("own")
    seen = seen.withColumn("_mid", array_median(F.col("_near")))
    seen = seen.withColumn("_scale", MAD_SCALE * array_median(F.transform("_near", lambda x: F.abs(x - F.col("_mid")))))
    spike = (F.col("_scale") >= 1e-12) & (F.abs(F.col(value) - F.col("_mid")) > HAMPEL_SIGMAS * F.col("_scale"))
    return (
        seen.withColumn("spike", spike)
        .withColumn("cleaned", F.when(F.col("spike"), F.col("_mid")).otherwise(F.col(value)))
        .drop("_near", "_mid", "_scale", "chunk", "own")
    )


def correct_level_shifts(numbered: DataFrame, keys: Sequence[str], value: str = "cleaned") -> DataFrame:
    """Remove the step at each long gap from everything after it.

    `numbered` carries `rn` and the series length `n`. Both sides of a gap hold
    the same earlier corrections, so the shifts of all gaps are independent and
    their running sum is the correction.
    """
    stepped = with_previous(
        numbered.select(*keys, "rn", "n", "ts_us"), keys, ["rn", "ts_us"], ["ts_us"], F.floor((F.col("rn") - 1) / CHUNK_ROWS).cast("long")
    ).withColumn("dt", F.col("ts_us") - F.col("prev")["ts_us"])
    typical = exact_percentiles(stepped, keys, "dt", {"median_dt": 0.5}, counted=numbered)
    gaps = (
        stepped.where(F.col("dt").isNotNull() & (F.col("n") >= 2 * LEVEL_SAMPLES + 1))
        .join(settle(typical), list(keys))
        .where((F.col("median_dt") > 0) & (F.col("dt") > GAP_FACTOR * F.col("median_dt")))
        .select(*keys, "n", F.col("rn").alias("gap_rn"))
    )
    along = Window.partitionBy(*keys).orderBy("gap_rn")
    gaps = gaps.withColumn("_from", F.greatest(F.coalesce(F.lag("gap_rn").over(along), F.lit(1)), F.col("gap_rn") - LEVEL_SAMPLES))
    gaps = gaps.withColumn(
        "_to", F.least(F.coalesce(F.lead("gap_rn").over(along) - 1, F.col("n")), F.col("gap_rn") + LEVEL_SAMPLES - 1)
    )
    near = gaps.withColumn("rn", F.explode(F.sequence("_from", "_to"))).select(*keys, "gap_rn", "rn")
    levels = (
        near.join(numbered.select(*keys, "rn", value), [*keys, "rn"])
        .groupBy(*keys, "gap_rn")
        .agg(
            F.percentile(F.when(F.col("rn") >= F.col("gap_rn"), F.col(value)), 0.5).alias("_after"),
            F.percentile(F.when(F.col("rn") < F.col("gap_rn"), F.col(value)), 0.5).alias("_before"),
        )
        .select(*keys, F.col("gap_rn").alias("rn"), (F.col("_after") - F.col("_before")).alias("shift"))
    )
    marked = numbered.join(levels, [*keys, "rn"], "left")
    total = running_sum(
        marked, keys, ["rn"], F.floor((F.col("rn") - 1) / CHUNK_ROWS).cast("long"), F.coalesce("shift", F.lit(0.0)), "_total"
    )
    return total.withColumn("levelled", F.col(value) - F.col("_total")).drop("_total")


def clean_calibration(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Spikes out, level shifts out, slope out; the mean level stays."""
    numbered = number_series(df, keys, total="n")
    levelled = cut_lineage(correct_level_shifts(cut_lineage(hampel(numbered, keys, value), once=True), keys))
    first = levelled.groupBy(*keys).agg(F.min("ts_us").alias("_t0"))
    hours = levelled.join(settle(first), list(keys)).withColumn("hours", (F.col("ts_us") - F.col("_t0")) / F.lit(3_600_000_000.0))
    slopes = hours.groupBy(*keys).agg(F.regr_slope("levelled", "hours").alias("slope"))
    out = hours.join(settle(slopes), list(keys))
    return out.withColumn("clean", F.col("levelled") - F.coalesce("slope", F.lit(0.0)) * F.col("hours")).drop("_t0")


def rolling_window(df: DataFrame, keys: Sequence[str], value: str = "value_m") -> DataFrame:
    """The last six hours of each station up to its newest reading, one sample per instant."""
    newest = df.groupBy(*keys).agg(F.max("ts_us").alias("_ref"))
    recent = df.join(settle(newest), list(keys)).where(F.col("ts_us") >= F.col("_ref") - WINDOW_HOURS * 3_600_000_000)
    single = recent.groupBy(*keys, "ts_us").agg(F.min_by(value, "seq").alias(value))
    numbered = number_rows(single, keys, ["ts_us"], time_bucket("ts_us", 900), "rn", "n")
    return numbered.withColumnRenamed("n", "n_samples").withColumn("sufficient", F.col("n_samples") >= WINDOW_MIN_SAMPLES).drop("rn")


def sample_windows(df: DataFrame, keys: Sequence[str], hours: float, bucket_seconds: int = DAY) -> DataFrame:
    """Consecutive windows of a fixed number of samples; adds `window_no`.

    A trailing window under the minimum is left out, as the rule says.
    """
    numbered = number_rows(df, keys, ["ts_us"], time_bucket("ts_us", bucket_seconds), "rn", "n")
    stepped = with_previous(numbered.select(*keys, "ts_us"), keys, ["ts_us"], ["ts_us"], time_bucket("ts_us", bucket_seconds))
    steps = stepped.withColumn("dt", (F.col("ts_us") - F.col("prev")["ts_us"]) / F.lit(1_000_000.0))
    size = exact_percentiles(steps, keys, "dt", {"median_dt": 0.5}, counted=df).where(F.col("median_dt") > 0)
    size = size.select(*keys, F.greatest(F.lit(1), F.floor(F.lit(hours * 3600.0) / F.col("median_dt"))).cast("long").alias("per_window"))
    placed = numbered.join(settle(size), list(keys)).withColumn("window_no", F.floor((F.col("rn") - 1) / F.col("per_window")).cast("long"))
    in_window = F.least(F.col("per_window"), F.col("n") - F.col("window_no") * F.col("per_window"))
    return placed.where(in_window >= WINDOW_MIN_SAMPLES).drop("rn", "n")


def growing_windows(df: DataFrame, keys: Sequence[str], origin_us: int, step_min: int = 5, max_min: int = 360) -> DataFrame:
    """Which prefix windows each early sample belongs to, as (first, last) prefix numbers.

    A prefix k ends k*step minutes after the origin. The range form keeps one row
    per sample; a causal detector reads prefixes off one pass.
    """
    minutes = (F.col("ts_us") - F.lit(origin_us)) / F.lit(60_000_000.0)
    inside = df.withColumn("minutes", minutes).where(F.col("minutes").between(0, max_min))
    return inside.withColumn("first_prefix", F.greatest(F.lit(1), F.ceil(F.col("minutes") / step_min)).cast("long")).withColumn(
        "last_prefix", F.lit(max_min // step_min).cast("long")
    )


def series_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (position, instant, value) found in one series only; empty means equal in bag and order."""
    left = number_series(a.select(*keys, "ts_us", value), keys).select(*keys, "rn", "ts_us", value)
    right = number_series(b.select(*keys, "ts_us", value), keys).select(*keys, "rn", "ts_us", value)
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def drop_gap(df: DataFrame, start_us: int, length_sec: int) -> DataFrame:
    return df.where((F.col("ts_us") < start_us) | (F.col("ts_us") >= start_us + length_sec * 1_000_000))


def contiguous_segments(df: DataFrame, zone: str, index: str) -> DataFrame:
    """Runs of consecutive segment numbers per zone, the longest first."""
    distinct = df.select(zone, index).distinct()
    island = F.col(index) - F.row_number().over(Window.partitionBy(zone).orderBy(index))
    runs = distinct.withColumn("_island", island).groupBy(zone, "_island").agg(
        F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count(F.lit(1)).alias("run_length")
    )
    best = Window.partitionBy(zone).orderBy(F.desc("run_length"), "first_index")
    return runs.drop("_island").withColumn("run_rank", F.row_number().over(best))
