"""Record quality: validation, ordered checks, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_finite, is_reading
from ..schemas import (
    CADENCE_IRREGULAR_FACTOR,
    COOPS_QC,
    COOPS_RANGE_M,
    COOPS_RANGE_SUSPECT_M,
    DART_QC,
    FLAT_LINE_WINDOW_SEC,
    FUTURE_TOLERANCE_SEC,
    TIMING_GAP_FACTOR,
    USABLE_CONFIDENCE,
    WINDOW_HOURS,
)
from .partitioned import BUCKET, _carry, exact_percentiles, settle, time_bucket, with_previous

STATION = ["source_type", "station_id"]
CHECKS = ["timing", "range", "rate_of_change", "spike", "flat_line"]
PASS, NOT_EVALUATED, SUSPECT, FAIL, MISSING = 1, 2, 3, 4, 9
# Kinds of rows in the sort of the checks: a carried row, a reading, and a reading marked one hour later.
OLDER, ROW, MARK = 0, 1, 2


def drop_sentinels(df: DataFrame, value: str = "value_m") -> DataFrame:
    return df.where(is_reading(F.col(value)))


def mark_invalid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add `reasons`, the names of the rules a row breaks (a null test counts as broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def validate_split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): no row is lost, quarantined rows say why."""
    marked = mark_invalid(df, rules)
    valid = marked.where(F.size("reasons") == 0).drop("reasons")
    rejected = marked.where(F.size("reasons") > 0).withColumn("reason_detail", F.array_join("reasons", "; "))
    return valid, rejected.drop("reasons")


def feed_rules(feed: str) -> dict[str, Column]:
    """Closed bounds of a feed's readings: 'dart', 'coops' or 'seismic'. A null value passes where it is optional."""
    if feed == "dart":
        return {
            "height_m within 0..12000": F.col("height_m").between(0.0, 12_000.0),
            "measurement_type is 1, 2 or 3": F.col("measurement_type").isin(1, 2, 3),
        }
    if feed == "coops":
        return {
            "water_level_m within -15..30": F.col("water_level_m").isNull() | F.col("water_level_m").between(-15.0, 30.0),
        }
    if feed == "seismic":
        return {
            "magnitude within -2..10": F.col("magnitude").isNull() | F.col("magnitude").between(-2.0, 10.0),
            "depth_km within -10..1000": F.col("depth_km").isNull() | F.col("depth_km").between(-10.0, 1_000.0),
            "lat within -90..90": F.col("lat").isNull() | F.col("lat").between(-90.0, 90.0),
            "lon within -180..180": F.col("lon").isNull() | F.col("lon").between(-180.0, 180.0),
            "tsunami_flag is 0 or 1": F.col("tsunami_flag").isNull() | F.col("tsunami_flag").isin(0, 1),
        }
    raise ValueError(f"unknown feed {feed}")


def admit(df: DataFrame, now_us: int, ts_us: str = "ts_us", value: str = "value_m") -> DataFrame:
    """Mark rows a checkpoint at `now_us` would take into the rolling windows."""
    inside = F.col(ts_us).between(now_us - WINDOW_HOURS * 3_600_000_000, now_us + FUTURE_TOLERANCE_SEC * 1_000_000)
    return df.withColumn("admitted", inside & is_reading(F.col(value)))


def guard_late_and_future(df: DataFrame, now_us: int, ts_us: str = "ts_us") -> DataFrame:
    late = F.col(ts_us) < now_us - WINDOW_HOURS * 3_600_000_000
    future = F.col(ts_us) > now_us + FUTURE_TOLERANCE_SEC * 1_000_000
    return df.withColumn("timing_class", F.when(late, "late").when(future, "future").otherwise("on_time"))


def _limit(name: str) -> Column:
    return F.when(F.col("source_type") == "dart", DART_QC[name]).otherwise(COOPS_QC[name])


def _banded(size: Column, limit: Column) -> Column:
    """Pass up to the limit, suspect up to twice the limit, fail above."""
    return F.when(size <= limit, PASS).when(size <= limit * 2, SUSPECT).otherwise(FAIL)


def quality_flags(df: DataFrame, bucket_seconds: int = 6 * 3600) -> DataFrame:
    """All five ordered checks in (station, time bucket) partitions, at a cost that does not depend on density.

    The last hour of a row lies in two blocks of an hour: the start of its own block up
    to the row, and the end of the block before. Each reading is also sent, one hour
    later, into the next block as a mark; a running extreme over rows and a running
    extreme over marks from the end make up the hour, and no frame slides. The row
    before a bucket, however old, comes as one carried row.
    """
    look = FLAT_LINE_WINDOW_SEC * 1_000_000
    per_bucket = max(1, bucket_seconds // FLAT_LINE_WINDOW_SEC)
    order = ["ts_us", "payload_hash"]
    payload = ["value_m", "expected_interval_sec"]

    def placed(df: DataFrame, at: Column) -> DataFrame:
        return df.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / F.lit(look)).cast("long")).withColumn(
            BUCKET, F.floor(F.col("_block") / F.lit(per_bucket)).cast("long")
        )

    rows = df.where(F.col("ts_us").isNotNull())
    carried = _carry(placed(rows.select(*STATION, *order, *payload), F.col("ts_us")), STATION, order, payload).select(
        *STATION, F.col("_next").alias(BUCKET), *[F.col("_tail")[c].alias(c) for c in order + payload], F.lit(OLDER).alias("_kind")
    )
    # A mark needs its station, place and value only.
    twice = rows.withColumn("_kind", F.explode(F.array(F.lit(ROW), F.lit(MARK)))).where((F.col("_kind") == ROW) | F.col("value_m").isNotNull())
    twice = placed(twice, F.col("ts_us") + F.when(F.col("_kind") == MARK, look).otherwise(0))
    bare = [F.when(F.col("_kind") == ROW, F.col(c)).alias(c) for c in df.columns if c not in (*STATION, "value_m")]
    both = twice.select(*STATION, "value_m", *bare, "_kind", "_at", "_block", BUCKET).unionByName(carried, allowMissingColumns=True)
    both = both.withColumn("_at", F.coalesce("_at", "ts_us"))
    whole = (Window.unboundedPreceding, 0)
    ordered = Window.partitionBy(*STATION, BUCKET).orderBy("_at", "payload_hash").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*STATION, BUCKET, "_block").orderBy("_at", "payload_hash").rowsBetween(*whole)
    # Marks of the row's first instant an hour ago belong to the hour.
    down = Window.partitionBy(*STATION, BUCKET, "_block").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(*whole)
    value = F.col("value_m")
    own, mark = F.when(F.col("_kind") == ROW, value), F.when(F.col("_kind") == MARK, value)
    seen = both.select(
        "*",
        F.last(F.when(F.col("_kind") != MARK, F.struct("ts_us", *payload)), ignorenulls=True).over(ordered).alias("_prev"),
        F.least(F.min(own).over(up), F.min(mark).over(down)).alias("_low"),
        F.greatest(F.max(own).over(up), F.max(mark).over(down)).alias("_high"),
        (F.count(own).over(up) + F.count(mark).over(down)).alias("_count"),
    ).where(F.col("_kind") == ROW).select(*df.columns, "_prev", "_low", "_high", "_count")
    prev = F.col("_prev")
    dt = (F.col("ts_us") - prev["ts_us"]) / F.lit(1_000_000.0)
    no_step = prev.isNull() | prev["value_m"].isNull() | (dt <= 0)
    jump = F.abs(value - prev["value_m"])
    gap = F.greatest(F.col("expected_interval_sec"), prev["expected_interval_sec"]) * F.lit(TIMING_GAP_FACTOR)
    timing = F.when(prev.isNull() | (dt <= 0), NOT_EVALUATED).otherwise(_banded(dt, gap))
    spike = (
        F.when(value.isNull(), MISSING)
        .when(no_step | (dt > _limit("spike_window_sec") * 4), NOT_EVALUATED)
        .otherwise(_banded(jump, _limit("spike_m")))
    )
    rate = F.when(value.isNull(), MISSING).when(no_step, NOT_EVALUATED).otherwise(_banded(jump / dt, _limit("rate_m_per_sec")))
    flat = (
        F.when(value.isNull(), MISSING)
        .when(F.col("_count") < 2, NOT_EVALUATED)
        .when(F.col("_high") - F.col("_low") >= _limit("flat_m"), PASS)
        .otherwise(SUSPECT)
    )
    gross = (
        F.when(value.isNull(), MISSING)
        .when(~is_finite(value), FAIL)
        .when(F.col("source_type") == "dart", NOT_EVALUATED)
        .when(F.abs(value) <= COOPS_RANGE_M, PASS)
        .when(F.abs(value) <= COOPS_RANGE_SUSPECT_M, SUSPECT)
        .otherwise(FAIL)
    )
    flagged = (
        seen.withColumn("timing", timing.cast("int"))
        .withColumn("range", gross.cast("int"))
        .withColumn("rate_of_change", rate.cast("int"))
        .withColumn("spike", spike.cast("int"))
        .withColumn("flat_line", flat.cast("int"))
        .withColumn("latency", F.col("timing"))
        .drop("_prev", "_low", "_high", "_count")
    )
    return with_confidence(flagged)


def with_confidence(df: DataFrame) -> DataFrame:
    """Evaluated checks, confidence in [0, 1] and usability from the five flags."""
    definite = [F.col(c).isin(PASS, SUSPECT, FAIL).cast("int") for c in CHECKS]
    suspect = [(F.col(c) == SUSPECT).cast("int") for c in CHECKS]
    fail = [(F.col(c) == FAIL).cast("int") for c in CHECKS]
    n = sum(definite[1:], definite[0])
    s = sum(suspect[1:], suspect[0])
    f = sum(fail[1:], fail[0])
    raw = F.lit(1.0) - (F.lit(0.3) * s + f) / n
    confidence = F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return (
        df.withColumn("n_checks", n)
        .withColumn("confidence", confidence)
        .withColumn("usable", F.col("confidence") >= USABLE_CONFIDENCE)
    )


def station_summary(flagged: DataFrame) -> DataFrame:
    """Which stations are unusable, and how sure that is."""
    return flagged.groupBy(*STATION).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("usable").alias("n_usable"),
        F.min("confidence").alias("min_confidence"),
        F.count_if(F.col("n_checks") == 0).alias("n_without_checks"),
    )


def worst_flag(checks: list[str]) -> Column:
    """Decisive flag of a record: fail, missing, suspect, not evaluated, pass; else null."""
    flags = F.array(*[F.col(c) for c in checks])
    found = [F.when(F.array_contains(flags, code), code) for code in (FAIL, MISSING, SUSPECT, NOT_EVALUATED, PASS)]
    return F.coalesce(*found)


def retained_window_summary(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Quality of exactly the records a window retained, with their distinct well-formed hashes in order."""
    from ..functions.hashing import is_sha256

    worst = flagged.withColumn("worst", worst_flag(CHECKS + ["latency"]))
    has = F.col("n_checks").isNotNull()
    counts = {"n_pass": PASS, "n_not_evaluated": NOT_EVALUATED, "n_suspect": SUSPECT, "n_fail": FAIL, "n_missing": MISSING}
    out = worst.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        *[F.count_if(F.col("worst") == code).alias(name) for name, code in counts.items()],
        F.count_if(has & F.col("usable")).alias("n_usable"),
        F.sum(F.when(has, 5 - F.col("n_checks")).otherwise(0)).cast("long").alias("n_unevaluated_checks"),
        F.min("confidence").alias("confidence_min"),
        F.avg("confidence").alias("confidence_mean"),
        F.max("confidence").alias("confidence_max"),
        F.count_if(F.col("worst").isNotNull()).alias("n_flagged"),
        # A window retains six hours of one station, so its hashes are few.
        F.array_sort(F.collect_set(F.when(is_sha256(F.col("payload_hash")), F.col("payload_hash")))).alias("record_sha256s"),
    )
    condition = (
        F.when(F.col("n_fail") > 0, "WORST_FLAG_FAIL")
        .when(F.col("n_missing") > 0, "WORST_FLAG_MISSING")
        .when(F.col("n_suspect") > 0, "WORST_FLAG_SUSPECT")
        .when(F.col("n_not_evaluated") > 0, "WORST_FLAG_NOT_EVALUATED")
        .when(F.col("n_pass") > 0, "WORST_FLAG_PASS")
        .otherwise("NO_RETAINED_QC")
    )
    execution = (
        F.when(F.col("n_flagged") == F.col("n_records"), "SUCCEEDED").when(F.col("n_flagged") > 0, "PARTIAL").otherwise("NOT_RUN")
    )
    return (
        out.withColumn("n_unusable", F.col("n_records") - F.col("n_usable"))
        .withColumn("execution_status", execution)
        .withColumn("aggregate_condition", condition)
        .drop("n_flagged")
    )


def record_hashes(df: DataFrame, keys: list[str]) -> DataFrame:
    """All distinct well-formed hashes, one row each, with their number per key."""
    from ..functions.hashing import is_sha256

    distinct = df.where(is_sha256(F.col("payload_hash"))).groupBy(*keys, "payload_hash").agg(F.lit(1).alias("_one"))
    total = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    return distinct.drop("_one").join(settle(total), keys)


def cadence(df: DataFrame, keys: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """Median step and regularity of each series."""
    stepped = with_previous(df.select(*keys, "ts_us"), keys, ["ts_us"], ["ts_us"], time_bucket("ts_us", bucket_seconds))
    steps = stepped.withColumn("step_sec", (F.col("ts_us") - F.col("prev")["ts_us"]) / F.lit(1_000_000.0))
    positive = steps.where(F.col("step_sec") > 0)
    median = exact_percentiles(positive, keys, "step_sec", {"median_sec": 0.5}, counted=df)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    largest = positive.groupBy(*keys).agg(F.max("step_sec").alias("max_sec"))
    joined = size.join(largest, keys, "left").join(median, keys, "left")
    return joined.withColumn(
        "cadence",
        F.when(F.col("median_sec").isNull(), "UNKNOWN")
        .when(F.col("max_sec") > F.col("median_sec") * CADENCE_IRREGULAR_FACTOR, "IRREGULAR")
        .otherwise("NOMINAL"),
    )


def admission_status(attempted: Column, admitted: Column) -> Column:
    return (
        F.when(attempted == 0, "NO_RECORD_ATTEMPT")
        .when(admitted == 0, "ALL_RECORDS_REJECTED")
        .when(admitted == attempted, "ALL_RECORDS_ADMITTED")
        .otherwise("SOME_RECORDS_ADMITTED")
    )


def provenance_status(n: Column, hashed: Column) -> Column:
    return F.when((n == 0) | (hashed == n), "RESOLVED").when(hashed == 0, "UNAVAILABLE").otherwise("PARTIAL")
