"""Idempotent appends, quarantine and the payload archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import is_sha256
from ..session import cut_lineage

OBSERVATION_KEY = ["station_id", "ts", "payload_hash"]
ASSESSMENT_KEY = ["checkpoint_id", "schema_version"]


def first_per_key(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The row that came first per key, as an aggregate so copies collapse before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c != order]
    best = rows.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_b"))
    return best.select(*key, F.col(f"_b.{order}").alias(order), *[F.col("_b")[c].alias(c) for c in rest])


def new_rows(incoming: DataFrame, existing: DataFrame | None, key: Sequence[str], order: str) -> DataFrame:
    """Rows of `incoming` whose key is in neither `existing` nor an earlier incoming row."""
    single = first_per_key(incoming, key, order)
    return single if existing is None else single.join(existing.select(*key), list(key), "left_anti")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None


def append_observations(rows: DataFrame, path: str, order: str = "seq") -> int:
    """Append rows not yet stored, partitioned by date; returns how many were new.

    Only the stored partitions within the incoming dates are read. The new rows
    are materialised once, then counted and written, so both see the same rows.
    """
    spark = rows.sparkSession
    dated = rows.withColumn("observed_date", F.to_date("ts"))
    low, high = dated.agg(F.min("observed_date"), F.max("observed_date")).first()
    if low is None:
        return 0
    stored = _existing(spark, path)
    if stored is not None:
        stored = stored.where(F.col("observed_date").between(low, high))
    fresh = cut_lineage(new_rows(dated, stored, [*OBSERVATION_KEY, "observed_date"], order))
    n = fresh.count()
    if n:
        fresh.repartition("observed_date", F.pmod(F.xxhash64("payload_hash"), F.lit(8))).sortWithinPartitions(
            "station_id", "ts"
        ).write.mode("append").partitionBy("observed_date").parquet(path)
    return n


def seismic_observations(quakes: DataFrame) -> DataFrame:
    """Earthquake records in the shape of the observation log: the event takes the station's place."""
    return quakes.select(F.col("event_id").alias("station_id"), "ts", F.col("version").alias("payload_hash"), F.lit("seismic").alias("source_type"))


def append_assessments(rows: DataFrame, path: str, order: str = "produced_us") -> int:
    """At most one row per (checkpoint, schema version); the stored row wins."""
    fresh = cut_lineage(new_rows(rows, _existing(rows.sparkSession, path), ASSESSMENT_KEY, order))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def quarantine_rows(rejected: DataFrame, reason_code: str) -> DataFrame:
    """Rejected rows with reason and their fields as JSON."""
    fields = [c for c in rejected.columns if c not in ("reason_detail",)]
    return rejected.select(
        F.lit(reason_code).alias("reason_code"), "reason_detail", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("raw_fields")
    )


def write_quarantine(rejected: DataFrame, path: str, reason_code: str = "VALIDATION") -> None:
    quarantine_rows(rejected, reason_code).write.mode("append").parquet(path)


def archive_rows(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Content-addressed rows, one per digest, with the two-character fan-out prefix."""
    digest = F.sha2(F.col(payload), 256)
    return (
        payloads.select(digest.alias("payload_hash"), F.col(payload).alias("payload"))
        .dropDuplicates(["payload_hash"])
        .withColumn("prefix", F.substring("payload_hash", 1, 2))
    )


def archive_payloads(payloads: DataFrame, path: str, payload: str = "payload") -> int:
    """Store payloads not stored yet; storing again changes nothing."""
    stored = _existing(payloads.sparkSession, path)
    rows = archive_rows(payloads, payload)
    fresh = rows if stored is None else rows.join(stored.select("prefix", "payload_hash"), ["prefix", "payload_hash"], "left_anti")
    fresh = cut_lineage(fresh)
    n = fresh.count()
    if n:
        fresh.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
    return n


def lookup_payloads(wanted: DataFrame, archive: DataFrame) -> DataFrame:
    """Payload per wanted digest; malformed digests come back marked, unknown ones empty."""
    asked = wanted.select("payload_hash", is_sha256(F.col("payload_hash")).alias("well_formed"))
    keyed = asked.withColumn("prefix", F.when(F.col("well_formed"), F.substring("payload_hash", 1, 2)))
    return keyed.join(archive, ["prefix", "payload_hash"], "left").drop("prefix")


def archive_manifest(rows: DataFrame, origin_us: int) -> DataFrame:
    """Per station: rows around the origin, by measurement type, sentinels and window counts.

    `rows` has station_id, ts_us, measurement_type and height_m, sentinels included.
    """
    hour, day = 3_600_000_000, 86_400_000_000
    since = F.col("ts_us") - origin_us
    span = rows.where(since.between(-31 * day, 7 * day))
    real = F.col("height_m") < 9999.0
    per_type = span.groupBy("station_id", "measurement_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~real).alias("s"),
        F.count_if(real & since.between(-hour, 6 * hour)).alias("e"),
        F.count_if(real & (F.col("measurement_type") == 1) & since.between(-30 * day, -hour)).alias("c"),
    )
    return per_type.groupBy("station_id").agg(
        F.sum("n").alias("data_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("measurement_type").cast("string"), "n")))).alias("type_counts"),
        F.sum("s").alias("sentinel_rows"),
        F.sum("e").alias("event_rows"),
        F.sum("c").alias("calibration_rows"),
    )
