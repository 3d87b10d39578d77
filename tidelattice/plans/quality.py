"""Quality, validation and admission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import safe_float, safe_int
from ..operators import quality as Q
from ..functions.hashing import is_sha256
from . import Catalog
from .adapters import EPOCH_2024_US, OBS, QUAKES, observations, quakes, table, with_cte

C = Catalog()
NOW_US = EPOCH_2024_US + 15 * 86_400_000_000

FLAGS_SQL = OBS + """,
stepped AS (
  SELECT *, lag(ts_us) OVER w AS p_ts, lag(value_m) OVER w AS p_v, lag(expected_interval_sec) OVER w AS p_int,
    max(value_m) OVER h - min(value_m) OVER h AS variation, count(value_m) OVER h AS n_hour
  FROM obs
  WINDOW w AS (PARTITION BY source_type, station_id ORDER BY ts_us, payload_hash),
    h AS (PARTITION BY source_type, station_id ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)),
lims AS (
  SELECT *, (ts_us - p_ts) / 1000000.0::DOUBLE AS dt, abs(value_m - p_v) AS jump,
    CASE WHEN source_type = 'dart' THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS spike_m,
    CASE WHEN source_type = 'dart' THEN 60 ELSE 240 END AS spike_dt,
    CASE WHEN source_type = 'dart' THEN 0.001::DOUBLE ELSE 0.005::DOUBLE END AS rate_max,
    CASE WHEN source_type = 'dart' THEN 0.0001::DOUBLE ELSE 0.001::DOUBLE END AS flat_min,
    greatest(expected_interval_sec, p_int) * 2 AS gap
  FROM stepped),
flags AS (
  SELECT *,
    CASE WHEN p_ts IS NULL OR dt <= 0 THEN 2 WHEN dt <= gap THEN 1 WHEN dt <= 2 * gap THEN 3 ELSE 4 END AS timing,
    CASE WHEN value_m IS NULL THEN 9 WHEN source_type = 'dart' THEN 2 WHEN abs(value_m) <= 3 THEN 1
      WHEN abs(value_m) <= 4.5 THEN 3 ELSE 4 END AS range_flag,
    CASE WHEN value_m IS NULL THEN 9 WHEN p_v IS NULL OR dt <= 0 THEN 2 WHEN jump / dt <= rate_max THEN 1
      WHEN jump / dt <= 2 * rate_max THEN 3 ELSE 4 END AS rate_of_change,
    CASE WHEN value_m IS NULL THEN 9 WHEN p_v IS NULL OR dt <= 0 OR dt > spike_dt THEN 2 WHEN jump <= spike_m THEN 1
      WHEN jump <= 2 * spike_m THEN 3 ELSE 4 END AS spike,
    CASE WHEN value_m IS NULL THEN 9 WHEN n_hour < 2 THEN 2 WHEN variation >= flat_min THEN 1 ELSE 3 END AS flat_line
  FROM lims),
tallied AS (
  SELECT *, (timing IN (1,3,4))::INT + (range_flag IN (1,3,4))::INT + (rate_of_change IN (1,3,4))::INT
      + (spike IN (1,3,4))::INT + (flat_line IN (1,3,4))::INT AS n_checks,
    (timing = 3)::INT + (range_flag = 3)::INT + (rate_of_change = 3)::INT + (spike = 3)::INT + (flat_line = 3)::INT AS n_sus,
    (timing = 4)::INT + (range_flag = 4)::INT + (rate_of_change = 4)::INT + (spike = 4)::INT + (flat_line = 4)::INT AS n_bad
  FROM flags),
flagged AS (
  SELECT *, CASE WHEN n_checks = 0 THEN 1.0::DOUBLE
    ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (0.3::DOUBLE * n_sus + n_bad) / n_checks)) END AS confidence
  FROM tallied),
judged AS (SELECT *, confidence >= 0.5 AS usable FROM flagged)"""


def flagged(spark, sf_dir):
    return Q.quality_flags(observations(spark, sf_dir))


@C.add(
    "drop_sentinels",
    with_cte(OBS, body="""SELECT source_type, station_id, count(*) AS n, round(sum(v), 6) AS total FROM (
  SELECT *, CASE WHEN seq % 13 = 0 THEN 9999.0::DOUBLE WHEN seq % 17 = 0 THEN NULL ELSE value_m END AS v FROM obs)
WHERE v IS NOT NULL AND v < 9999 GROUP BY 1, 2"""),
)
def drop_sentinels(spark, sf_dir):
    v = F.when(F.col("seq") % 13 == 0, 9999.0).when(F.col("seq") % 17 == 0, None).otherwise(F.col("value_m"))
    kept = Q.drop_sentinels(observations(spark, sf_dir).withColumn("value_m", v))
    return kept.groupBy("source_type", "station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value_m"), 6).alias("total"))


@C.add(
    "safe_numbers",
    r"""WITH raw AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'nan' WHEN 2 THEN ' ' || CAST(event_id AS VARCHAR) || '.5 '
  WHEN 3 THEN CAST(event_id AS VARCHAR) WHEN 4 THEN event_type ELSE '1e999' END AS txt FROM events),
num AS (SELECT event_id, CASE WHEN regexp_matches(trim(txt), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
  THEN try_cast(trim(txt) AS DOUBLE) END AS d FROM raw)
SELECT event_id, CASE WHEN isfinite(d) THEN d END AS as_float, CASE WHEN isfinite(d) THEN CAST(trunc(d) AS BIGINT) END AS as_int FROM num""",
)
def safe_numbers(spark, sf_dir):
    k = F.col("event_id")
    m = k % 6
    text = (
        F.when(m == 0, " ")
        .when(m == 1, "nan")
        .when(m == 2, F.concat(F.lit(" "), k.cast("string"), F.lit(".5 ")))
        .when(m == 3, k.cast("string"))
        .when(m == 4, F.col("event_type"))
        .otherwise("1e999")
    )
    return table(spark, sf_dir, "events").select("event_id", safe_float(text).alias("as_float"), safe_int(text).alias("as_int"))


def reading_rules():
    return {
        "station_id format": F.col("station_id").rlike("^[0-9]{5,7}$"),
        "value_m above -0.98": F.col("value_m") >= -0.98,
        "value_m below 3": F.col("value_m") <= 3.0,
        "payload_hash format": is_sha256(F.col("payload_hash")),
    }


@C.add(
    "validate_split",
    with_cte(OBS, body="""SELECT CASE WHEN n = 0 THEN 'valid' ELSE 'quarantined' END AS side, detail AS reason_detail, count(*) AS n_rows FROM (
  SELECT (value_m < -0.98)::INT + (value_m > 3)::INT AS n,
    CASE WHEN value_m < -0.98 THEN 'value_m above -0.98' WHEN value_m > 3 THEN 'value_m below 3' ELSE '' END AS detail FROM obs)
GROUP BY 1, 2"""),
)
def validate_split(spark, sf_dir):
    valid, bad = Q.validate_split(observations(spark, sf_dir), reading_rules())
    sides = valid.select(F.lit("valid").alias("side"), F.lit("").alias("reason_detail")).unionByName(
        bad.select(F.lit("quarantined").alias("side"), "reason_detail")
    )
    return sides.groupBy("side", "reason_detail").agg(F.count(F.lit(1)).alias("n_rows"))


@C.add(
    "validate_feeds",
    with_cte(OBS, QUAKES, body="""SELECT feed, reason_detail, count(*) AS n_rows FROM (
  SELECT 'dart' AS feed, concat_ws('; ', CASE WHEN value_m * 5000 NOT BETWEEN 0 AND 12000 THEN 'height_m within 0..12000' END,
    CASE WHEN seq % 9 = 0 THEN 'measurement_type is 1, 2 or 3' END) AS reason_detail FROM obs WHERE source_type = 'dart'
  UNION ALL SELECT 'coops', CASE WHEN value_m * 16 NOT BETWEEN -15 AND 30 THEN 'water_level_m within -15..30' ELSE '' END FROM obs WHERE source_type = 'coops'
  UNION ALL SELECT 'seismic', concat_ws('; ', CASE WHEN magnitude * 1.5::DOUBLE NOT BETWEEN -2 AND 10 THEN 'magnitude within -2..10' END,
    CASE WHEN depth_km * 5 NOT BETWEEN -10 AND 1000 THEN 'depth_km within -10..1000' END,
    CASE WHEN lat * 1.5::DOUBLE NOT BETWEEN -90 AND 90 THEN 'lat within -90..90' END, CASE WHEN lon + 30 NOT BETWEEN -180 AND 180 THEN 'lon within -180..180' END,
    CASE WHEN event_id % 5 NOT IN (0, 1) THEN 'tsunami_flag is 0 or 1' END) FROM quakes)
GROUP BY 1, 2"""),
)
def validate_feeds(spark, sf_dir):
    """The bounds of each feed, on readings stretched so that some fail; valid rows have no reason."""
    obs = observations(spark, sf_dir)
    buoy = obs.where(F.col("source_type") == "dart").select(
        (F.col("value_m") * 5000).alias("height_m"), F.when(F.col("seq") % 9 == 0, 4).otherwise(F.col("measurement_type")).alias("measurement_type")
    )
    gauge = obs.where(F.col("source_type") == "coops").select((F.col("value_m") * 16).alias("water_level_m"))
    quake = quakes(spark, sf_dir).select(
        (F.col("magnitude") * 1.5).alias("magnitude"), (F.col("depth_km") * 5).alias("depth_km"), (F.col("lat") * 1.5).alias("lat"),
        (F.col("lon") + 30).alias("lon"), (F.col("event_id") % 5).alias("tsunami_flag"),
    )
    sides = []
    for feed, rows in (("dart", buoy), ("coops", gauge), ("seismic", quake)):
        valid, bad = Q.validate_split(rows, Q.feed_rules(feed))
        sides += [valid.select(F.lit(feed).alias("feed"), F.lit("").alias("reason_detail")), bad.select(F.lit(feed).alias("feed"), "reason_detail")]
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side)
    return out.groupBy("feed", "reason_detail").agg(F.count(F.lit(1)).alias("n_rows"))


@C.add(
    "admission_window",
    with_cte(OBS, body=f"""SELECT source_type, station_id, count(*) AS attempted,
  count(*) FILTER (ts_us BETWEEN {NOW_US} - 21600000000 AND {NOW_US} + 900000000) AS admitted,
  CASE WHEN count(*) FILTER (ts_us BETWEEN {NOW_US} - 21600000000 AND {NOW_US} + 900000000) = 0 THEN 'ALL_RECORDS_REJECTED'
    WHEN count(*) FILTER (ts_us BETWEEN {NOW_US} - 21600000000 AND {NOW_US} + 900000000) = count(*) THEN 'ALL_RECORDS_ADMITTED'
    ELSE 'SOME_RECORDS_ADMITTED' END AS status
FROM obs GROUP BY 1, 2"""),
)
def admission_window(spark, sf_dir):
    marked = Q.admit(observations(spark, sf_dir), NOW_US)
    counts = marked.groupBy("source_type", "station_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("admitted").alias("admitted")
    )
    return counts.withColumn("status", Q.admission_status(F.col("attempted"), F.col("admitted")))


@C.add(
    "late_and_future_guard",
    with_cte(OBS, body=f"""SELECT source_type, CASE WHEN ts_us < {NOW_US} - 21600000000 THEN 'late'
  WHEN ts_us > {NOW_US} + 900000000 THEN 'future' ELSE 'on_time' END AS timing_class, count(*) AS n FROM obs GROUP BY 1, 2"""),
)
def late_and_future_guard(spark, sf_dir):
    guarded = Q.guard_late_and_future(observations(spark, sf_dir), NOW_US)
    return guarded.groupBy("source_type", "timing_class").agg(F.count(F.lit(1)).alias("n"))


@C.add(
    "expected_interval",
    with_cte(OBS, body="""SELECT source_type, measurement_type, product, expected_interval_sec, count(*) AS n FROM obs GROUP BY ALL"""),
)
def expected_interval(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("source_type", "measurement_type", "product", "expected_interval_sec").agg(
        F.count(F.lit(1)).alias("n")
    )


def _flag_query(name: str, sql_name: str) -> None:
    sql = with_cte(FLAGS_SQL, body=f"SELECT seq, source_type, station_id, {sql_name} AS flag FROM judged")

    @C.add(name, sql)
    def build(spark, sf_dir):
        column = "range" if sql_name == "range_flag" else sql_name
        return flagged(spark, sf_dir).select("seq", "source_type", "station_id", F.col(column).alias("flag"))


for _name, _sql in (
    ("qc_timing", "timing"),
    ("qc_spike", "spike"),
    ("qc_rate_of_change", "rate_of_change"),
    ("qc_flat_line", "flat_line"),
    ("qc_gross_range", "range_flag"),
):
    _flag_query(_name, _sql)


@C.add(
    "qc_all",
    with_cte(FLAGS_SQL, body="""SELECT seq, timing, range_flag, rate_of_change, spike, flat_line, timing AS latency, n_checks,
  round(confidence, 6) AS confidence, usable FROM judged"""),
)
def qc_all(spark, sf_dir):
    return flagged(spark, sf_dir).select(
        "seq", "timing", F.col("range").alias("range_flag"), "rate_of_change", "spike", "flat_line", "latency", "n_checks",
        F.round("confidence", 6).alias("confidence"), "usable",
    )


@C.add(
    "qc_station_summary",
    with_cte(FLAGS_SQL, body="""SELECT source_type, station_id, count(*) AS n_records, count(*) FILTER (usable) AS n_usable,
  round(min(confidence), 6) AS min_confidence, count(*) FILTER (n_checks = 0) AS n_without_checks FROM judged GROUP BY 1, 2"""),
)
def qc_station_summary(spark, sf_dir):
    return Q.station_summary(flagged(spark, sf_dir)).withColumn("min_confidence", F.round("min_confidence", 6))


@C.add(
    "retained_window_qc",
    with_cte(FLAGS_SQL, body="""SELECT *, CASE WHEN n_fail > 0 THEN 'WORST_FLAG_FAIL' WHEN n_missing > 0 THEN 'WORST_FLAG_MISSING'
  WHEN n_suspect > 0 THEN 'WORST_FLAG_SUSPECT' WHEN n_not_evaluated > 0 THEN 'WORST_FLAG_NOT_EVALUATED'
  ELSE 'WORST_FLAG_PASS' END AS aggregate_condition, 'SUCCEEDED' AS execution_status, n_records - n_usable AS n_unusable FROM (
 SELECT source_type, station_id, ts_us // 21600000000 AS window_no, count(*) AS n_records,
  count(*) FILTER (worst = 1) AS n_pass, count(*) FILTER (worst = 2) AS n_not_evaluated, count(*) FILTER (worst = 3) AS n_suspect,
  count(*) FILTER (worst = 4) AS n_fail, count(*) FILTER (worst = 9) AS n_missing, count(*) FILTER (usable) AS n_usable,
  CAST(sum(5 - n_checks) AS BIGINT) AS n_unevaluated_checks, round(min(confidence), 6) AS confidence_min,
  round(avg(confidence), 10) AS confidence_mean, round(max(confidence), 6) AS confidence_max,
  array_to_string(list_sort(list(DISTINCT payload_hash)), ',') AS record_sha256s
 FROM (SELECT *, CASE WHEN 4 IN (timing, range_flag, rate_of_change, spike, flat_line) THEN 4
    WHEN 9 IN (timing, range_flag, rate_of_change, spike, flat_line) THEN 9
    WHEN 3 IN (timing, range_flag, rate_of_change, spike, flat_line) THEN 3
    WHEN 2 IN (timing, range_flag, rate_of_change, spike, flat_line) THEN 2 ELSE 1 END AS worst FROM judged)
 GROUP BY 1, 2, 3)"""),
)
def retained_window_qc(spark, sf_dir):
    window = F.expr("ts_us div 21600000000").alias("window_no")
    rows = flagged(spark, sf_dir).withColumn("window_no", window)
    out = Q.retained_window_summary(rows, ["source_type", "station_id", "window_no"])
    for c, digits in (("confidence_min", 6), ("confidence_mean", 10), ("confidence_max", 6)):
        out = out.withColumn(c, F.round(c, digits))
    return out.withColumn("record_sha256s", F.array_join("record_sha256s", ","))


@C.add(
    "input_refs",
    with_cte(OBS, body="""SELECT source_type, station_id, payload_hash, count(*) OVER (PARTITION BY source_type, station_id) AS n_distinct
FROM (SELECT DISTINCT source_type, station_id, payload_hash FROM obs)"""),
)
def input_refs(spark, sf_dir):
    return Q.record_hashes(observations(spark, sf_dir), Q.STATION).select(*Q.STATION, "payload_hash", "n_distinct")


@C.add(
    "provenance_status",
    with_cte(OBS, body="""SELECT source_type, station_id, day, count(*) AS n, count(*) FILTER (ok) AS hashed,
  CASE WHEN count(*) FILTER (ok) = count(*) THEN 'RESOLVED' WHEN count(*) FILTER (ok) = 0 THEN 'UNAVAILABLE' ELSE 'PARTIAL' END AS status
FROM (SELECT source_type, station_id, ts_us // 86400000000 AS day,
  NOT ((ts_us // 86400000000) % 3 = 0 OR ((ts_us // 86400000000) % 3 = 1 AND seq % 2 = 0)) AS ok FROM obs) GROUP BY 1, 2, 3"""),
)
def provenance_status(spark, sf_dir):
    day = F.expr("ts_us div 86400000000")
    lost = (day % 3 == 0) | ((day % 3 == 1) & (F.col("seq") % 2 == 0))
    rows = observations(spark, sf_dir).select(
        *Q.STATION, day.alias("day"), F.when(lost, F.lit("lost")).otherwise(F.col("payload_hash")).alias("payload_hash")
    )
    out = rows.groupBy(*Q.STATION, "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_sha256(F.col("payload_hash"))).alias("hashed")
    )
    return out.withColumn("status", Q.provenance_status(F.col("n"), F.col("hashed")))


@C.add(
    "cadence",
    with_cte(OBS, body="""SELECT source_type, station_id, count(*) AS n_samples, round(max(step), 6) AS max_sec,
  round(quantile_cont(step, 0.5), 6) AS median_sec,
  CASE WHEN quantile_cont(step, 0.5) IS NULL THEN 'UNKNOWN' WHEN max(step) > 3 * quantile_cont(step, 0.5) THEN 'IRREGULAR' ELSE 'NOMINAL' END AS cadence
FROM (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY source_type, station_id ORDER BY ts_us)) / 1000000.0::DOUBLE AS step FROM obs)
GROUP BY 1, 2"""),
)
def cadence(spark, sf_dir):
    out = Q.cadence(observations(spark, sf_dir), Q.STATION)
    return out.withColumn("max_sec", F.round("max_sec", 6)).withColumn("median_sec", F.round("median_sec", 6))


@C.add(
    "usable_station_count",
    with_cte(FLAGS_SQL, body="""SELECT day, count(*) FILTER (ok) AS n_usable, count(*) FILTER (ok) < 2 AS sensor_degraded FROM (
  SELECT ts_us // 86400000000 AS day, station_id, bool_or(usable) AS ok FROM judged WHERE source_type = 'dart' GROUP BY 1, 2) GROUP BY 1"""),
)
def usable_station_count(spark, sf_dir):
    dart = flagged(spark, sf_dir).where(F.col("source_type") == "dart").withColumn("day", F.expr("ts_us div 86400000000"))
    per_station = dart.groupBy("day", "station_id").agg(F.bool_or("usable").alias("ok"))
    out = per_station.groupBy("day").agg(F.count_if("ok").alias("n_usable"))
    return out.withColumn("sensor_degraded", F.col("n_usable") < 2)
