"""Feed, sink and archive queries over payloads written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..session import spread
from ..sources import feeds, sinks
from . import Catalog
from .adapters import EPOCH_2024_US, OBS, observations, table, with_cte
from .quality import reading_rules

C = Catalog()

# One raw line per reading, with every defect the parser must tell apart.
LINES = """lines AS (SELECT event_id, CAST(21400 + user_id % 4 AS VARCHAR) AS station_id, CASE event_id % 12
    WHEN 0 THEN '# header' WHEN 1 THEN '' WHEN 2 THEN strftime(ts, '%Y %m %d %H %M')
    WHEN 3 THEN strftime(ts, '%Y %m %d %H %M %S') || ' 1 MM' WHEN 4 THEN strftime(ts, '%Y %m %d %H %M %S') || ' 4 5000.1'
    WHEN 5 THEN strftime(ts, '%Y %m %d %H %M %S') || ' 1 9999.000' WHEN 6 THEN '2024 02 30 00 00 00 1 5000.1'
    WHEN 7 THEN '  ' || strftime(ts, '%y %m %d %H %M %S') || '   2  ' || CAST(5000 + event_id % 7 AS VARCHAR) || '.25 '
    ELSE strftime(ts, '%Y %m %d %H %M %S') || ' 1 ' || CAST(5000 + event_id % 9 AS VARCHAR) || '.5' END AS line, ts FROM events)"""


def lines(spark, sf_dir):
    k = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    stamp = F.date_format(ts, "yyyy MM dd HH mm ss")
    m = k % 12
    text = (
        F.when(m == 0, "# header")
        .when(m == 1, "")
        .when(m == 2, F.date_format(ts, "yyyy MM dd HH mm"))
        .when(m == 3, F.concat(stamp, F.lit(" 1 MM")))
        .when(m == 4, F.concat(stamp, F.lit(" 4 5000.1")))
        .when(m == 5, F.concat(stamp, F.lit(" 1 9999.000")))
        .when(m == 6, "2024 02 30 00 00 00 1 5000.1")
        .when(m == 7, F.concat(F.lit("  "), F.date_format(ts, "yy MM dd HH mm ss"), F.lit("   2  "), (5000 + k % 7).cast("string"), F.lit(".25 ")))
        .otherwise(F.concat(stamp, F.lit(" 1 "), (5000 + k % 9).cast("string"), F.lit(".5")))
    )
    station = (21400 + F.col("user_id") % 4).cast("string")
    return spread(table(spark, sf_dir, "events")).select("event_id", station.alias("station_id"), text.alias("value"))


@C.add(
    "read_dart_text",
    with_cte(LINES, body="""SELECT 'dart:' || station_id || ':' || strftime(ts, '%Y%m%d%H%M%S') || ':' || kind AS source_id, station_id,
  epoch_us(date_trunc('second', ts)) AS ts_us, kind AS measurement_type, height AS height_m, kind IN (2, 3) AS event_mode, sha256(trim(line)) AS payload_hash FROM (
  SELECT *, CASE WHEN event_id % 12 = 7 THEN 2 ELSE 1 END AS kind, CASE WHEN event_id % 12 = 7 THEN 5000.25::DOUBLE + event_id % 7 ELSE 5000.5::DOUBLE + event_id % 9 END AS height
  FROM lines WHERE event_id % 12 >= 7)"""),
)
def read_dart_text(spark, sf_dir):
    out = feeds.dart_records(feeds.parse_dart_lines(lines(spark, sf_dir)))
    return out.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@C.add(
    "dart_line_counts",
    with_cte(LINES, body="""SELECT station_id, count(*) FILTER (event_id % 12 >= 7) AS n_read, count(*) FILTER (event_id % 12 IN (2, 4, 6)) AS n_skipped,
  count(*) FILTER (event_id % 12 IN (3, 5)) AS n_missing FROM lines GROUP BY 1"""),
)
def dart_line_counts(spark, sf_dir):
    return feeds.reason_counts(feeds.parse_dart_lines(lines(spark, sf_dir)), ["station_id"])


COOPS = """rows_ AS (SELECT user_id, event_id // 100 AS pack, event_id, CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS t, ts,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'nan' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || 'e-2' END AS v FROM events)"""


def gauge_payloads(spark, sf_dir):
    """Small JSON payloads per station, at most 100 rows each; some are error payloads."""
    k = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    rows = table(spark, sf_dir, "events").select(
        (9_410_000 + F.col("user_id")).cast("string").alias("station_id"),
        F.floor(k / 100).cast("long").alias("pack"),
        F.struct(
            F.when(k % 9 == 0, "soon").otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm")).alias("t"),
            F.when(k % 7 == 0, "").when(k % 7 == 1, "nan").otherwise(F.concat(cents, F.lit("e-2"))).alias("v"),
            F.lit("0,0,0,0").alias("f"),
            F.lit("v").alias("q"),
        ).alias("row"),
    )
    grouped = rows.groupBy("station_id", "pack").agg(F.collect_list("row").alias("data"))
    good = F.to_json(F.struct(F.struct(F.lit("gauge").alias("name")).alias("metadata"), "data"))
    bad = F.lit('{"error": {"message": "No data was found"}}')
    return grouped.select("station_id", F.lit("water_level").alias("product"), F.when(F.col("pack") % 5 == 0, bad).otherwise(good).alias("value"))


@C.add(
    "read_coops",
    with_cte(COOPS, body="""SELECT 'coops:' || CAST(9410000 + user_id AS VARCHAR) || ':water_level:' || strftime(ts, '%Y%m%d%H%M') AS source_id,
  epoch_us(date_trunc('minute', ts)) AS ts_us, CASE WHEN event_id % 7 > 1 THEN CAST(v AS DOUBLE) END AS water_level_m, '0,0,0,0' AS flags, 'v' AS quality
FROM rows_ WHERE event_id % 9 <> 0 AND pack % 5 <> 0"""),
)
def read_coops(spark, sf_dir):
    out = feeds.parse_coops_payloads(gauge_payloads(spark, sf_dir))
    return out.select("source_id", F.unix_micros("ts").alias("ts_us"), "water_level_m", "flags", "quality")


def quake_payloads(spark, sf_dir):
    """GeoJSON collections of at most 50 earthquakes."""
    k = F.col("o_orderkey")
    at = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long")
    feature = F.struct(
        F.when(k % 17 != 0, F.concat(F.lit("us"), k)).alias("id"),
        F.struct(
            F.when(k % 13 != 0, (k % 45) / F.lit(10.0) + 4.0).alias("mag"),
            F.concat(F.lit("place "), k % 5).alias("place"),
            F.when(k % 19 != 0, at).alias("time"),
            F.when(k % 3 != 0, at + 60_000).alias("updated"),
            (k % 2).cast("int").alias("tsunami"),
            F.lit("earthquake").alias("type"),
        ).alias("properties"),
        F.struct(
            F.when(k % 4 == 0, F.array(F.lit(10.0), F.lit(20.0))).otherwise(
                F.array(((k * 13) % 360 - 180).cast("double"), ((k * 7) % 140 - 70).cast("double"), (k % 300).cast("double"))
            ).alias("coordinates")
        ).alias("geometry"),
    )
    grouped = table(spark, sf_dir, "orders").groupBy(F.floor(k / 50).alias("pack")).agg(F.collect_list(feature).alias("features"))
    return grouped.select(F.to_json(F.struct("features")).alias("value"))


@C.add(
    "read_seismic_geojson",
    """SELECT 'us' || o_orderkey AS event_id, 'seismic:us' || o_orderkey || ':' || strftime(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 MINUTE ELSE o_orderdate END, '%Y%m%d%H%M%S') || '000000' AS source_id,
  epoch_us(o_orderdate) AS ts_us, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(o_orderdate) + 60000000 END AS updated_us,
  CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 45) / 10.0::DOUBLE + 4.0::DOUBLE END AS magnitude, 'place ' || o_orderkey % 5 AS place, CAST(o_orderkey % 2 AS INT) AS tsunami_flag,
  CASE WHEN o_orderkey % 4 <> 0 THEN ((o_orderkey * 13) % 360 - 180)::DOUBLE END AS lon, CASE WHEN o_orderkey % 4 <> 0 THEN ((o_orderkey * 7) % 140 - 70)::DOUBLE END AS lat,
  CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 300)::DOUBLE END AS depth_km FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0""",
)
def read_seismic_geojson(spark, sf_dir):
    out = feeds.parse_seismic_payloads(quake_payloads(spark, sf_dir))
    return out.select(
        "event_id", "source_id", F.unix_micros("ts").alias("ts_us"), F.unix_micros("updated_ts").alias("updated_us"), "magnitude", "place",
        "tsunami_flag", "lon", "lat", "depth_km",
    )


@C.add(
    "event_version",
    """WITH v AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS place, epoch_us(o_orderdate) AS t FROM orders)
SELECT k AS event_id, sha256('{"depth":' || k % 700 || ',"kind":"earthquake","lat":' || (k % 180 - 90) || ',"lon":' || (c % 360 - 180) || ',"magnitude":' || k % 6
  || ',"place":"' || place || '","time":' || t || ',"tsunami":' || c % 2 || ',"updated":' || (t + c) || '}') AS version FROM v""",
)
def event_version(spark, sf_dir):
    from ..functions.hashing import event_version as fingerprint

    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    version = fingerprint(k % 6, t, t + c, c % 2, F.col("o_orderstatus"), F.lit("earthquake"), c % 360 - 180, k % 180 - 90, k % 700)
    return table(spark, sf_dir, "orders").select(k.alias("event_id"), version.alias("version"))


CSV = """csv AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(21000 + user_id AS VARCHAR) END AS sid,
  CASE WHEN event_id % 8 = 0 THEN 'later' WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS t,
  CASE event_id % 10 WHEN 0 THEN '9999.0' WHEN 1 THEN 'inf' ELSE CAST(5000 + event_id % 11 AS VARCHAR) || '.5' END AS h, ts FROM events)"""


@C.add(
    "read_station_csv",
    with_cte(CSV, body="""SELECT station_id, count(*) AS n, min(epoch_us(date_trunc('second', ts))) AS first_us, max(CAST(h AS DOUBLE)) AS top_m FROM (
  SELECT *, CAST(21000 + user_id AS VARCHAR) AS station_id FROM csv WHERE event_id % 8 <> 0 AND event_id % 10 > 1) GROUP BY 1 HAVING count(*) >= 10"""),
)
def read_station_csv(spark, sf_dir):
    k = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    sid = (21_000 + F.col("user_id")).cast("string")
    rows = table(spark, sf_dir, "events").select(
        F.when(k % 3 != 0, sid).otherwise("").alias("station_id"),
        F.when(k % 8 == 0, "later")
        .when(k % 2 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .alias("timestamp_utc"),
        F.when(k % 10 == 0, "9999.0").when(k % 10 == 1, "inf").otherwise(F.concat((5000 + k % 11).cast("string"), F.lit(".5"))).alias("height_m"),
        F.concat(F.lit("dart_"), sid, F.lit("_event.csv")).alias("file_name"),
    )
    out = feeds.clean_station_rows(rows)
    return out.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first_us"), F.max("height_m").alias("top_m")
    )


@C.add(
    "decode_envelopes",
    """SELECT event_type AS topic, CAST(user_id % 4 AS INT) AS "partition", event_id AS "offset", CASE WHEN event_id % 7 <= 3 THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN event_id % 7 IN (4, 5) THEN event_type END AS source_type, CASE WHEN event_id % 7 IN (4, 5) THEN '{"v":' || event_id || '}' WHEN event_id % 7 = 6 THEN '{"v":' || event_id || ',"w":[1]}' END AS record FROM events""",
)
def decode_envelopes(spark, sf_dir):
    k = F.col("event_id")
    inner = F.concat(F.lit('{"v":'), k, F.lit("}"))
    text = (
        F.when(k % 7 == 1, "[1, 2]")
        .when(k % 7 == 2, "not json {")
        .when(k % 7 == 6, F.concat(F.lit('{"v":'), k, F.lit(',"w":[1]}')))
        .when(k % 7 > 3, F.concat(F.lit('{"source_type":"'), F.col("event_type"), F.lit('","record":'), inner, F.lit("}")))
    )
    value = F.when(k % 7 == 3, F.unhex(F.lit("C328"))).otherwise(text.cast("binary"))
    rows = table(spark, sf_dir, "events").select(
        value.alias("value"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), k.alias("offset")
    )
    return feeds.decode_envelopes(rows)


@C.add(
    "append_observations",
    with_cte(OBS, body="""SELECT station_id, ts_us, payload_hash, seq FROM obs WHERE seq % 3 <> 0"""),
)
def append_observations(spark, sf_dir):
    """Rows an append would add: two thirds are new, and every row is delivered twice."""
    obs = observations(spark, sf_dir).select("station_id", "ts", "payload_hash", "seq")
    again = obs.unionByName(obs.withColumn("seq", F.col("seq") + 1_000_000_000))
    out = sinks.new_rows(again, obs.where(F.col("seq") % 3 == 0), sinks.OBSERVATION_KEY, "seq")
    return out.select("station_id", F.unix_micros("ts").alias("ts_us"), "payload_hash", "seq")


@C.add(
    "append_assessments",
    """SELECT o_custkey AS checkpoint_id, o_orderkey % 2 AS schema_version, min(o_orderkey) AS produced_us FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c.c_acctbal < 0 AND o_orderkey % 2 = 0) GROUP BY 1, 2""",
)
def append_assessments(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("checkpoint_id"), (F.col("o_orderkey") % 2).alias("schema_version"), F.col("o_orderkey").alias("produced_us")
    )
    stored = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("checkpoint_id"), F.lit(0).cast("long").alias("schema_version")
    )
    return sinks.new_rows(rows, stored, sinks.ASSESSMENT_KEY, "produced_us")


@C.add(
    "write_quarantine",
    with_cte(OBS, body="""SELECT 'VALIDATION' AS reason_code, CASE WHEN value_m < -0.98 THEN 'value_m above -0.98' ELSE 'value_m below 3' END AS reason_detail,
  '{"station_id":"' || station_id || '","seq":' || seq || ',"ts_us":' || ts_us || '}' AS raw_fields FROM obs WHERE value_m < -0.98 OR value_m > 3"""),
)
def write_quarantine(spark, sf_dir):
    _, bad = Q.validate_split(observations(spark, sf_dir), reading_rules())
    return sinks.quarantine_rows(bad.select("station_id", "seq", "ts_us", "reason_detail"), "VALIDATION")


@C.add(
    "archive_payloads",
    """SELECT sha256(p_name) AS payload_hash, p_name AS payload, substr(sha256(p_name), 1, 2) AS prefix FROM (SELECT DISTINCT p_name FROM part)""",
)
def archive_payloads(spark, sf_dir):
    return sinks.archive_rows(table(spark, sf_dir, "part").select(F.col("p_name").alias("payload")))


@C.add(
    "lookup_payloads",
    """WITH a AS (SELECT DISTINCT p_name, sha256(p_name) AS h FROM part WHERE p_size > 25),
w AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'bad' ELSE sha256(p_name) END AS h FROM part)
SELECT p_partkey, w.h <> 'bad' AS well_formed, a.p_name AS payload FROM w LEFT JOIN a USING (h)""",
)
def lookup_payloads(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    archive = sinks.archive_rows(part.where(F.col("p_size") > 25).select(F.col("p_name").alias("payload")))
    wanted = part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "bad").otherwise(F.sha2("p_name", 256)).alias("payload_hash"))
    found = sinks.lookup_payloads(wanted.select("payload_hash").distinct(), archive)
    return wanted.join(found, "payload_hash", "left").select("p_partkey", "well_formed", "payload")


ORIGIN_US = EPOCH_2024_US + 20 * 86_400_000_000


@C.add(
    "archive_manifest",
    with_cte(OBS, body=f"""SELECT station_id, count(*) AS data_rows, count(*) FILTER (measurement_type = 1) AS type_1, count(*) FILTER (measurement_type = 2) AS type_2,
  count(*) FILTER (measurement_type = 3) AS type_3, count(*) FILTER (seq % 50 = 0) AS sentinel_rows,
  count(*) FILTER (seq % 50 <> 0 AND ts_us BETWEEN {ORIGIN_US} - 3600000000 AND {ORIGIN_US} + 21600000000) AS event_rows,
  count(*) FILTER (seq % 50 <> 0 AND measurement_type = 1 AND ts_us BETWEEN {ORIGIN_US} - 2592000000000 AND {ORIGIN_US} - 3600000000) AS calibration_rows
FROM obs WHERE source_type = 'dart' AND ts_us BETWEEN {ORIGIN_US} - 2678400000000 AND {ORIGIN_US} + 604800000000 GROUP BY 1"""),
)
def archive_manifest(spark, sf_dir):
    rows = observations(spark, sf_dir).where(F.col("source_type") == "dart").select(
        "station_id", "ts_us", "measurement_type", F.when(F.col("seq") % 50 == 0, 9999.0).otherwise(F.col("value_m")).alias("height_m")
    )
    out = sinks.archive_manifest(rows, ORIGIN_US)
    kinds = [F.coalesce(F.try_element_at("type_counts", F.lit(str(i))), F.lit(0).cast("long")).alias(f"type_{i}") for i in (1, 2, 3)]
    return out.select("station_id", "data_rows", *kinds, "sentinel_rows", "event_rows", "calibration_rows")
