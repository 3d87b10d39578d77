"""The given tables seen as sensor feeds, in Spark and in SQL.

Each shape is written twice, once as DataFrame expressions and once as a SQL
common table expression, from the same integer arithmetic, so both engines see
equal input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import expected_interval_sec
from ..functions.geo import classify_zone, ZONE_BOXES

EPOCH_2024_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_cte(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge readings: even stations are tide gauges, odd ones buoys."""
    n = F.col("user_id") % 4
    coops = n % 2 == 0
    ts = F.col("ts").cast("timestamp")
    kind = F.when(
        ~coops, F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    )
    product = F.when(
        coops, F.when(F.col("event_type").isin("view", "click"), "water_level").otherwise("one_minute_water_level")
    )
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(coops, "coops").otherwise("dart").alias("source_type"),
        F.when(coops, 9410000 + n).otherwise(21400 + n).cast("string").alias("station_id"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("ts_us"),
        kind.cast("int").alias("measurement_type"),
        product.alias("product"),
        (F.col("value") / 100.0 - 1.0).alias("value_m"),
        F.sha2(F.concat_ws("|", F.col("event_id"), F.unix_micros(ts), F.col("event_type")), 256).alias("payload_hash"),
    )
    return rows.withColumn(
        "expected_interval_sec", expected_interval_sec(F.col("source_type"), F.col("measurement_type"), F.col("product"))
    )


OBS = """obs0 AS (
  SELECT event_id AS seq, user_id % 4 AS n, epoch_us(ts) AS ts_us, event_type, value / 100.0 - 1.0 AS value_m
  FROM events),
obs AS (
  SELECT seq, ts_us, value_m,
    CASE WHEN n % 2 = 0 THEN 'coops' ELSE 'dart' END AS source_type,
    CAST(CASE WHEN n % 2 = 0 THEN 9410000 + n ELSE 21400 + n END AS VARCHAR) AS station_id,
    CASE WHEN n % 2 = 1 THEN CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END END AS measurement_type,
    CASE WHEN n % 2 = 0 THEN CASE WHEN event_type IN ('view', 'click') THEN 'water_level'
      ELSE 'one_minute_water_level' END END AS product,
    CASE WHEN n % 2 = 1 THEN CASE event_type WHEN 'error' THEN 15 WHEN 'purchase' THEN 60 ELSE 900 END
      WHEN event_type IN ('view', 'click') THEN 360 ELSE 60 END AS expected_interval_sec,
    sha256(concat_ws('|', seq, ts_us, event_type)) AS payload_hash
  FROM obs0)"""


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earthquakes over the first twenty days of the readings."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("event_id"),
        (F.lit(4.0) + (k % 45) / F.lit(10.0)).alias("magnitude"),
        F.when(k % 11 != 0, (k % 300).cast("double")).alias("depth_km"),
        ((k * 7) % 140 - 70).cast("double").alias("lat"),
        ((k * 13) % 360 - 180).cast("double").alias("lon"),
        (F.lit(EPOCH_2024_US) + (k * 7919) % 1_728_000 * 1_000_000).alias("origin_us"),
    )


QUAKES = f"""quakes AS (
  SELECT o_orderkey AS event_id, 4.0::DOUBLE + (o_orderkey % 45) / 10.0::DOUBLE AS magnitude,
    CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 300)::DOUBLE END AS depth_km,
    ((o_orderkey * 7) % 140 - 70)::DOUBLE AS lat, ((o_orderkey * 13) % 360 - 180)::DOUBLE AS lon,
    {EPOCH_2024_US} + (o_orderkey * 7919) % 1728000 * 1000000 AS origin_us
  FROM orders)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station coordinates; a quarter of the stations is unknown to it."""
    k = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .where(k % 4 != 3)
        .select(
            F.when(k % 2 == 0, 9410000 + k).otherwise(21400 + k).cast("string").alias("station_id"),
            ((k * 37) % 120 - 60).cast("double").alias("lat"),
            ((k * 73) % 360 - 180).cast("double").alias("lon"),
        )
    )


REGISTRY = """registry AS (
  SELECT CAST(CASE WHEN s_suppkey % 2 = 0 THEN 9410000 + s_suppkey ELSE 21400 + s_suppkey END AS VARCHAR) AS station_id,
    ((s_suppkey * 37) % 120 - 60)::DOUBLE AS lat, ((s_suppkey * 73) % 360 - 180)::DOUBLE AS lon
  FROM supplier WHERE s_suppkey % 4 <> 3)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per supplier with many equal instants, ordered by (order, line)."""
    ts = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station_id"),
        F.unix_micros(ts).alias("ts_us"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_extendedprice").alias("value"),
    )


SERIES = """series AS (
  SELECT l_suppkey AS station_id, epoch_us(l_shipdate) AS ts_us, l_orderkey * 8 + l_linenumber AS seq,
    l_extendedprice AS value
  FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows with their components, one per reading."""
    k, u = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        k.alias("window_id"),
        F.when(u % 2 == 0, "coops").otherwise("dart").alias("source_type"),
        u.alias("station_id"),
        (u % 5).alias("basin"),
        F.unix_micros(ts).alias("ts_us"),
        ((k * 37) % 101 / F.lit(100.0)).alias("threshold_score"),
        ((k * 53) % 101 / F.lit(100.0)).alias("wavelet_score"),
        ((k * 71) % 101 / F.lit(100.0)).alias("bocpd_score"),
        F.when(k % 5 == 0, (k * 29) % 101 / F.lit(100.0)).alias("ml_score"),
        F.pmod(F.floor(F.col("value") * 100).cast("long"), F.lit(101)).alias("score_pct"),
        F.expr("(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) / 60000000.0D - 14400.0D").alias("minutes"),
    ).withColumn("score", F.col("score_pct") / F.lit(100.0))


SCORES = """scores AS (
  SELECT event_id AS window_id, CASE WHEN user_id % 2 = 0 THEN 'coops' ELSE 'dart' END AS source_type,
    user_id AS station_id, user_id % 5 AS basin, epoch_us(ts) AS ts_us,
    (event_id * 37) % 101 / 100.0::DOUBLE AS threshold_score, (event_id * 53) % 101 / 100.0::DOUBLE AS wavelet_score,
    (event_id * 71) % 101 / 100.0::DOUBLE AS bocpd_score,
    CASE WHEN event_id % 5 = 0 THEN (event_id * 29) % 101 / 100.0::DOUBLE END AS ml_score,
    CAST(floor(value * 100) AS BIGINT) % 101 AS score_pct,
    (CAST(floor(value * 100) AS BIGINT) % 101) / 100.0::DOUBLE AS score,
    (epoch_us(ts) - 1704067200000000) / 60000000.0::DOUBLE - 14400.0::DOUBLE AS minutes
  FROM events)"""


ZONE_SQL = "CASE " + " ".join(
    f"WHEN lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e} THEN '{name}'" for name, s, n, w, e in ZONE_BOXES
) + " WHEN abs(lat) <= 60 AND (lon > 100 OR lon < -60) THEN 'pacific_rim' ELSE 'unknown' END"


def zoned_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quakes(spark, sf_dir).withColumn("zone", classify_zone(F.col("lat"), F.col("lon")))


ZQUAKES = QUAKES + f""",
zquakes AS (SELECT *, {ZONE_SQL} AS zone FROM quakes)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(12742.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def bearing_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    raw = (
        f"degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2}))"
        f" - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))))"
    )
    return f"(CASE WHEN {raw} < 0 THEN {raw} + 360 ELSE {raw} END)"
