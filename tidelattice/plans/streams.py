"""Streaming queries: batch twins checked by SQL, and the streams themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as R
from ..operators.alerts import INPUT
from ..operators.partitioned import time_bucket
from ..streaming import jobs
from . import Catalog
from .adapters import EPOCH_2024_US, OBS, observations, table, with_cte
from .evaluation import MACHINE_SQL, alert_log

C = Catalog()

ARRIVED = OBS + """,
arr AS (SELECT *, ts_us // 3600000000 * 1000000 + seq * 7919 % 1000003 AS arrival FROM obs)"""


def arrived(spark, sf_dir):
    """Readings in a delivery order that is out of time order within the hour."""
    arrival = F.expr("ts_us div 3600000000") * 1_000_000 + (F.col("seq") * 7919) % 1_000_003
    return observations(spark, sf_dir).select("source_type", "station_id", arrival.alias("seq"), "ts_us", "value_m")


@C.add(
    "high_water_filter",
    with_cte(ARRIVED, body="""SELECT source_type, station_id, arrival AS seq, ts_us FROM (
  SELECT *, max(ts_us) OVER (PARTITION BY source_type, station_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM arr)
WHERE mark IS NULL OR ts_us > mark OR (source_type = 'coops' AND ts_us = mark)"""),
)
def high_water_filter(spark, sf_dir):
    out = R.high_water(arrived(spark, sf_dir), F.floor(F.col("seq") / 24_000_000).cast("long"))
    return out.select("source_type", "station_id", "seq", "ts_us")


REVISIONS = """rev AS (SELECT o_custkey AS event_id, o_orderkey AS seq, epoch_us(o_orderdate) AS ts_us, o_orderpriority AS version FROM orders)"""


def revision_log(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("seq"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"), F.col("o_orderpriority").alias("version"),
    )


@C.add(
    "revision_dedup",
    with_cte(REVISIONS, body="""SELECT event_id, seq, version, coalesce(ts_us - p_ts <= 2592000000000, false) AS is_revision FROM (
  SELECT *, lag(ts_us) OVER w AS p_ts, lag(version) OVER w AS p_v FROM rev WINDOW w AS (PARTITION BY event_id ORDER BY ts_us, seq))
WHERE p_ts IS NULL OR ts_us - p_ts > 2592000000000 OR p_v <> version"""),
)
def revision_dedup(spark, sf_dir):
    out = R.revisions(revision_log(spark, sf_dir), time_bucket("ts_us", 365 * 86_400))
    return out.select("event_id", "seq", "version", "is_revision")


def polls(spark, sf_dir):
    rows = observations(spark, sf_dir).where(F.col("source_type") == "dart")
    return rows.select("station_id", F.expr("ts_us div 1800000000").alias("poll"), "ts_us", "measurement_type")


@C.add(
    "event_mode_state",
    with_cte(OBS, body="""SELECT station_id, poll, coalesce(observed >= 0 AND now_us - observed < 14400000000, false) AS event_mode FROM (
  SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS observed FROM (
    SELECT *, CASE WHEN mark_us IS NOT NULL AND now_us - mark_us < 14400000000 THEN mark_us WHEN all_std THEN -1 END AS said FROM (
      SELECT station_id, ts_us // 1800000000 AS poll, max(ts_us) AS now_us, max(ts_us) FILTER (measurement_type IN (2, 3)) AS mark_us, bool_and(measurement_type = 1) AS all_std
      FROM obs WHERE source_type = 'dart' GROUP BY 1, 2)))"""),
)
def event_mode_state(spark, sf_dir):
    return R.event_mode(polls(spark, sf_dir))


NOW_US = EPOCH_2024_US + 30 * 86_400_000_000
CLOCK_US = EPOCH_2024_US + 15 * 86_400_000_000


@C.add(
    "station_health",
    with_cte(OBS, body=f"""SELECT source_type, station_id, last_us, error_us, CASE WHEN error_us IS NOT NULL AND (last_us IS NULL OR error_us > last_us) THEN 'OFFLINE'
  WHEN {NOW_US} - last_us >= interval_sec * 2000000 THEN 'STALE' ELSE 'ONLINE' END AS status FROM (
  SELECT source_type, station_id, max(ts_us) AS last_us, arg_max(expected_interval_sec, ts_us) AS interval_sec FROM obs WHERE seq % 100 <> 99 GROUP BY 1, 2)
FULL JOIN (SELECT source_type, station_id, max(ts_us) AS error_us FROM obs WHERE seq % 100 = 99 GROUP BY 1, 2) USING (source_type, station_id)"""),
)
def station_health(spark, sf_dir):
    obs = observations(spark, sf_dir)
    bad = F.col("seq") % 100 == 99
    return R.station_health(obs.where(~bad), obs.where(bad), NOW_US)


@C.add(
    "checkpoint_attempts",
    """SELECT o_custkey AS checkpoint_id, o_orderkey AS attempt_no, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey)
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'processed' ELSE 'redelivery' END AS kind FROM orders""",
)
def checkpoint_attempts(spark, sf_dir):
    attempts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("checkpoint_id"), F.col("o_orderkey").alias("attempt_no"))
    done = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("checkpoint_id"))
    return jobs.checkpoint_attempts(attempts, done)


def event_stream(spark, sf_dir):
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def observation_stream(spark, sf_dir):
    n = F.col("user_id") % 4
    rows = event_stream(spark, sf_dir).select(
        F.when(n % 2 == 0, "coops").otherwise("dart").alias("source_type"),
        F.when(n % 2 == 0, 9410000 + n).otherwise(21400 + n).cast("string").alias("station_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        (F.col("value") / 100.0 - 1.0).alias("value_m"),
        F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1).alias("measurement_type"),
    )
    return rows


@C.add(
    "stream_high_water",
    with_cte(ARRIVED, body="""SELECT source_type, station_id, arrival AS seq, ts_us FROM (
  SELECT *, max(ts_us) OVER (PARTITION BY source_type, station_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM arr)
WHERE mark IS NULL OR ts_us > mark OR (source_type = 'coops' AND ts_us = mark)"""),
)
def stream_high_water(spark, sf_dir):
    arrival = F.expr("ts_us div 3600000000") * 1_000_000 + (F.col("seq") * 7919) % 1_000_003
    rows = observation_stream(spark, sf_dir).withColumn("seq", arrival).drop("measurement_type")
    return jobs.run_to_table(jobs.high_water(rows), "high-water").select("source_type", "station_id", "seq", "ts_us")


@C.add(
    "stream_revisions",
    with_cte(REVISIONS, body="""SELECT event_id, seq, version, coalesce(ts_us - p_ts <= 2592000000000, false) AS is_revision FROM (
  SELECT *, lag(ts_us) OVER w AS p_ts, lag(version) OVER w AS p_v FROM rev WINDOW w AS (PARTITION BY event_id ORDER BY ts_us, seq))
WHERE p_ts IS NULL OR ts_us - p_ts > 2592000000000 OR p_v <> version"""),
)
def stream_revisions(spark, sf_dir):
    schema = table(spark, sf_dir, "orders").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir).select(
        F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("seq"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"), F.col("o_orderpriority").alias("version"),
    )
    return jobs.run_to_table(jobs.revisions(rows, live=False), "revisions")


@C.add(
    "stream_rolling_window",
    with_cte(OBS, body="""SELECT source_type, station_id, least(count(DISTINCT ts_us), 50000) AS n_samples, min(ts_us) AS first_us, max(ts_us) AS last_us FROM (
  SELECT *, max(ts_us) OVER (PARTITION BY source_type, station_id) AS ref FROM obs) WHERE ts_us >= ref - 21600000000 GROUP BY 1, 2"""),
)
def stream_rolling_window(spark, sf_dir):
    rows = observation_stream(spark, sf_dir).drop("measurement_type")
    states = jobs.run_to_table(jobs.rolling_windows(rows), "rolling")
    # The newest state of each station is the one whose window ends last.
    return states.groupBy("source_type", "station_id").agg(F.max(F.struct("last_us", "n_samples", "first_us")).alias("s")).select(
        "source_type", "station_id", "s.n_samples", "s.first_us", "s.last_us"
    )


@C.add(
    "stream_event_mode",
    with_cte(OBS, body="""SELECT station_id, poll, coalesce(observed >= 0 AND now_us - observed < 14400000000, false) AS event_mode FROM (
  SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS observed FROM (
    SELECT *, CASE WHEN mark_us IS NOT NULL AND now_us - mark_us < 14400000000 THEN mark_us WHEN all_std THEN -1 END AS said FROM (
      SELECT station_id, ts_us // 1800000000 AS poll, max(ts_us) AS now_us, max(ts_us) FILTER (measurement_type IN (2, 3)) AS mark_us, bool_and(measurement_type = 1) AS all_std
      FROM obs WHERE source_type = 'dart' GROUP BY 1, 2)))"""),
)
def stream_event_mode(spark, sf_dir):
    rows = observation_stream(spark, sf_dir).where(F.col("source_type") == "dart").select(
        "station_id", F.expr("ts_us div 1800000000").alias("poll"), "ts_us", "measurement_type"
    )
    return jobs.run_to_table(jobs.event_mode(rows), "event-mode")


@C.add("stream_alerts", MACHINE_SQL)
def stream_alerts(spark, sf_dir):
    """The alert machine as a stream over the written log of triggers and best scores."""
    folder = jobs.shared_folder(spark, "alert-log")
    alert_log(spark, sf_dir).write.parquet(folder)
    log = spark.readStream.schema(INPUT).parquet(folder)
    return jobs.run_to_table(jobs.alerts(log), "alerts")


@C.add(
    "windowed_metrics",
    """SELECT start_us, event_type, n FROM (SELECT epoch_us(ts) - epoch_us(ts) % 300000000 AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE start_us + 300000000 <= ((SELECT max(epoch_us(ts)) FROM events) // 1000) * 1000 - 21600000000""",
)
def windowed_metrics(spark, sf_dir):
    """Final windows only: the last six hours stay open until the watermark passes them."""
    rows = event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.run_to_table(jobs.windowed_metrics(rows, "event_type", "ts"), "metrics")


GUARD_SQL = with_cte(OBS, body=f"""SELECT timing_class, count(*) AS n, max(ts_us) AS newest_us FROM (
  SELECT ts_us, CASE WHEN ts_us < {CLOCK_US} - 21600000000 THEN 'late' WHEN ts_us > {CLOCK_US} + 900000000 THEN 'future' ELSE 'on_time' END AS timing_class
  FROM obs) GROUP BY 1""")


@C.add("stream_guard", GUARD_SQL)
def stream_guard(spark, sf_dir):
    """Late and future rows are a side output of the stream, counted, not lost."""
    folder = jobs.shared_folder(spark, "guard")
    rows = observation_stream(spark, sf_dir).drop("measurement_type")
    jobs.guard(rows, f"{folder}/rows", f"{folder}/checkpoint", lambda _: CLOCK_US).awaitTermination()
    out = jobs.guarded(spark, f"{folder}/rows", rows.schema)
    return out.groupBy("timing_class").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("newest_us"))


HEALTH_SQL = with_cte(OBS, body=f"""SELECT source_type, station_id, last_us, error_us, CASE WHEN error_us IS NOT NULL AND (last_us IS NULL OR error_us > last_us) THEN 'OFFLINE'
  WHEN {NOW_US} - last_us >= interval_sec * 2000000 THEN 'STALE' ELSE 'ONLINE' END AS status FROM (
  SELECT source_type, station_id, max(ts_us) AS last_us, arg_max(expected_interval_sec, ts_us) AS interval_sec FROM obs WHERE seq % 100 <> 99 AND ts_us <= {NOW_US} GROUP BY 1, 2)
FULL JOIN (SELECT source_type, station_id, max(ts_us) AS error_us FROM obs WHERE seq % 100 = 99 AND ts_us <= {NOW_US} GROUP BY 1, 2) USING (source_type, station_id)""")


@C.add("stream_station_health", HEALTH_SQL)
def stream_station_health(spark, sf_dir):
    """Health of each station when the clock has moved on to the report's time."""
    folder = jobs.shared_folder(spark, "health-log")
    columns = ("source_type", "station_id", "seq", "ts_us", "expected_interval_sec", "is_error")
    obs = observations(spark, sf_dir).where(F.col("ts_us") <= NOW_US).withColumn("is_error", F.col("seq") % 100 == 99).select(*columns)
    # A clock of its own moves the watermark to the report's time.
    clock = spark.range(1).select(
        F.lit("clock").alias("source_type"), F.lit("clock").alias("station_id"), F.lit(-1).cast("long").alias("seq"),
        F.lit(NOW_US + 1000).cast("long").alias("ts_us"), F.lit(None).cast(obs.schema["expected_interval_sec"].dataType).alias("expected_interval_sec"),
        F.lit(False).alias("is_error"),
    )
    obs.unionByName(clock).write.parquet(folder)
    log = spark.readStream.schema(obs.schema).parquet(folder)
    changes = jobs.run_to_table(jobs.station_health(log.where("NOT is_error"), log.where("is_error"), "0 seconds"), "health")
    last = changes.groupBy("source_type", "station_id").agg(F.max(F.struct("at_us", "status", "last_us", "error_us")).alias("s"))
    # The newest reading and error are facts of the log; the status is what the stream said last.
    seen = obs.groupBy("source_type", "station_id").agg(
        F.max(F.when(~F.col("is_error"), F.col("ts_us"))).alias("last_us"), F.max(F.when(F.col("is_error"), F.col("ts_us"))).alias("error_us")
    )
    return last.join(seen, ["source_type", "station_id"]).select("source_type", "station_id", "last_us", "error_us", F.col("s.status").alias("status"))
