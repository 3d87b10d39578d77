"""Geo-temporal join and seismic context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins as J
from ..operators import series as S
from ..schemas import ESCALATION_DEPTH_KM, ESCALATION_MAGNITUDE, TRIGGER_MAGNITUDE
from ..session import spread
from . import Catalog
from .adapters import (
    OBS, QUAKES, REGISTRY, SERIES, ZONE_SQL, ZQUAKES, bearing_sql, haversine_sql, observations, quakes, registry, series,
    table, with_cte, zoned_quakes,
)

C = Catalog()
STATION = ["source_type", "station_id"]
GEO_SQL = QUAKES + ",\n" + REGISTRY


@C.add(
    "haversine_travel_bearing",
    with_cte(REGISTRY, QUAKES, body=f"""SELECT event_id, round({haversine_sql('lat', 'lon', '38.3::DOUBLE', '142.4::DOUBLE')}, 4) AS km,
  round({haversine_sql('lat', 'lon', '38.3::DOUBLE', '142.4::DOUBLE')} / 0.198::DOUBLE, 2) AS travel_sec,
  round({bearing_sql('lat', 'lon', '38.3::DOUBLE', '142.4::DOUBLE')}, 6) AS bearing FROM quakes"""),
)
def haversine_travel_bearing(spark, sf_dir):
    lat, lon, to = F.col("lat"), F.col("lon"), (F.lit(38.3), F.lit(142.4))
    km = geo.haversine_km(lat, lon, *to)
    return quakes(spark, sf_dir).select(
        "event_id", F.round(km, 4).alias("km"), F.round(geo.travel_time_sec(km), 2).alias("travel_sec"),
        F.round(geo.initial_bearing_deg(lat, lon, *to), 6).alias("bearing"),
    )


@C.add("classify_zone", with_cte(ZQUAKES, body="SELECT event_id, zone FROM zquakes"))
def classify_zone(spark, sf_dir):
    return zoned_quakes(spark, sf_dir).select("event_id", "zone")


@C.add(
    "seismic_trigger",
    with_cte(ZQUAKES, body="""SELECT event_id, magnitude >= 6.0 AND zone <> 'unknown' AS triggers,
  coalesce(magnitude >= 7.5 AND depth_km < 100, false) AS escalates FROM zquakes"""),
)
def seismic_trigger(spark, sf_dir):
    return zoned_quakes(spark, sf_dir).select(
        "event_id",
        ((F.col("magnitude") >= TRIGGER_MAGNITUDE) & (F.col("zone") != "unknown")).alias("triggers"),
        F.coalesce((F.col("magnitude") >= ESCALATION_MAGNITUDE) & (F.col("depth_km") < ESCALATION_DEPTH_KM), F.lit(False)).alias("escalates"),
    )


@C.add(
    "with_coordinates",
    with_cte(OBS, REGISTRY, body="""SELECT source_type, station_id, lat, lon, count(*) AS n FROM obs LEFT JOIN registry USING (station_id) GROUP BY ALL"""),
)
def with_coordinates(spark, sf_dir):
    out = J.with_coordinates(observations(spark, sf_dir), registry(spark, sf_dir))
    return out.groupBy(*STATION, "lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@C.add("station_registry", with_cte(REGISTRY, body="SELECT * FROM registry"))
def station_registry(spark, sf_dir):
    return registry(spark, sf_dir)


@C.add(
    "historical_events",
    with_cte(ZQUAKES, body="""SELECT event_id, magnitude AS mw, zone, origin_us FROM zquakes WHERE magnitude >= 8.0"""),
)
def historical_events(spark, sf_dir):
    return zoned_quakes(spark, sf_dir).where(F.col("magnitude") >= 8.0).select(
        "event_id", F.col("magnitude").alias("mw"), "zone", "origin_us"
    )


@C.add(
    "seismic_quiet",
    with_cte(OBS, QUAKES, body="""SELECT seq, NOT EXISTS (SELECT 1 FROM quakes q WHERE q.magnitude >= 6.5 AND q.origin_us >= obs.ts_us - 5400000000)
  AND NOT seq % 10 = 0 AS quiet FROM obs"""),
)
def seismic_quiet(spark, sf_dir):
    out = J.with_quiet(observations(spark, sf_dir), quakes(spark, sf_dir), F.col("seq") % 10 == 0)
    return out.select("seq", "quiet")


@C.add(
    "rayleigh_suspect",
    with_cte(OBS, GEO_SQL, body=f"""SELECT seq, bool_or(travel > 0 AND km <= 3000 AND km / 3.6::DOUBLE >= 10
  AND abs(travel - km / 3.6::DOUBLE) / (km / 3.6::DOUBLE) <= 0.2::DOUBLE) AS suspect FROM (
  SELECT o.seq, (o.ts_us - q.origin_us) / 1000000.0::DOUBLE AS travel, {haversine_sql('o.lat', 'o.lon', 'q.lat', 'q.lon')} AS km
  FROM (SELECT * FROM obs JOIN registry USING (station_id)) o LEFT JOIN quakes q
    ON q.origin_us BETWEEN o.ts_us - 1001000000 AND o.ts_us) GROUP BY 1"""),
)
def rayleigh_suspect(spark, sf_dir):
    readings = spread(observations(spark, sf_dir).select("seq", "station_id", "ts_us"))
    spikes = J.with_coordinates(readings, registry(spark, sf_dir)).where(F.col("lat").isNotNull())
    hits = J.rayleigh_suspects(spikes, quakes(spark, sf_dir), "seq").withColumn("hit", F.lit(True))
    out = spikes.select("seq").join(hits, "seq", "left")
    return out.select("seq", F.coalesce("hit", F.lit(False)).alias("suspect"))


ARRIVALS = """arrivals AS (
  SELECT l_orderkey AS event_id, l_suppkey AS station_id, min((l_partkey * 37) % 40000 * 1000000) AS ts_us,
    ((l_suppkey * 37) % 120 - 60)::DOUBLE AS lat, ((l_suppkey * 73) % 360 - 180)::DOUBLE AS lon
  FROM lineitem GROUP BY l_orderkey, l_suppkey)"""


def arrivals(spark, sf_dir):
    """First arrival of each event at each station; dealt by event, which all later steps keep together."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("station_id"), ((F.col("l_partkey") * 37) % 40000 * 1_000_000).alias("ts_us")
    )
    rows = J.dealt(line, ["event_id"]).groupBy("event_id", "station_id").agg(F.min("ts_us").alias("ts_us"))
    k = F.col("station_id")
    return rows.withColumn("lat", ((k * 37) % 120 - 60).cast("double")).withColumn("lon", ((k * 73) % 360 - 180).cast("double"))


@C.add(
    "spatial_coherence",
    with_cte(ARRIVALS, body=f"""SELECT event_id, count(*) AS n_others, count(*) FILTER (ok) AS n_confirming, count(*) FILTER (ok) >= 2 AS confirmed,
  least(1.0::DOUBLE, count(*) FILTER (ok) / 2.0::DOUBLE) AS coherence FROM (
  SELECT event_id, (ts_us - f_ts) / 1000000.0::DOUBLE BETWEEN greatest(km / 0.198::DOUBLE, 5) * (1 - 0.2::DOUBLE)
      AND greatest(km / 0.198::DOUBLE, 5) * (1 + 0.2::DOUBLE) AS ok FROM (
    SELECT a.*, f.ts_us AS f_ts, {haversine_sql('f.lat', 'f.lon', 'a.lat', 'a.lon')} AS km
    FROM arrivals a JOIN (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts_us, station_id) = 1) f
      USING (event_id) WHERE a.station_id <> f.station_id)) GROUP BY 1"""),
)
def spatial_coherence(spark, sf_dir):
    return J.spatial_coherence(arrivals(spark, sf_dir))


@C.add(
    "bind_to_event",
    with_cte(OBS, ZQUAKES, body="""SELECT o.seq, t.event_id, t.trigger_us FROM (SELECT *, seq % 5 AS basin FROM obs) o ASOF LEFT JOIN (
  SELECT event_id % 5 AS basin, origin_us AS trigger_us, max(event_id) AS event_id FROM zquakes WHERE magnitude >= 6.0 GROUP BY 1, 2) t
  ON o.basin = t.basin AND o.ts_us >= t.trigger_us""").replace(
        "SELECT o.seq, t.event_id, t.trigger_us",
        "SELECT o.seq, CASE WHEN o.ts_us < t.trigger_us + 43200000000 THEN t.event_id END AS event_id,\n"
        "  CASE WHEN o.ts_us < t.trigger_us + 43200000000 THEN t.trigger_us END AS trigger_us",
    ),
)
def bind_to_event(spark, sf_dir):
    rows = observations(spark, sf_dir).select("seq", "ts_us", (F.col("seq") % 5).alias("basin"))
    triggers = zoned_quakes(spark, sf_dir).where(F.col("magnitude") >= 6.0).select(
        (F.col("event_id") % 5).alias("basin"), F.col("origin_us").alias("trigger_us"), "event_id"
    )
    out = J.bind_to_event(rows, triggers, ["basin"], 43_200_000_000, ["seq"], 3_600_000_000)
    return out.select("seq", "event_id", "trigger_us")


SOURCES = """sources AS (SELECT p_partkey AS source_id, ((p_partkey * 11) % 140 - 70)::DOUBLE + (p_partkey % 7) / 7.0::DOUBLE AS lat,
  ((p_partkey * 29) % 360 - 180)::DOUBLE + (p_partkey % 9) / 9.0::DOUBLE AS lon, p_size AS zone,
  ((p_partkey * 17) % 360)::DOUBLE AS strike FROM part)"""


def sources(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("source_id"),
        (((k * 11) % 140 - 70).cast("double") + (k % 7) / F.lit(7.0)).alias("lat"),
        (((k * 29) % 360 - 180).cast("double") + (k % 9) / F.lit(9.0)).alias("lon"),
        F.col("p_size").alias("zone"),
        ((k * 17) % 360).cast("double").alias("strike"),
    )


@C.add(
    "nearest_sources",
    with_cte(QUAKES, SOURCES, body=f"""SELECT event_id, source_id, round(km, 4) AS km, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, source_id) AS rank FROM (
    SELECT q.event_id, s.source_id, {haversine_sql('q.lat', 'q.lon', 's.lat', 's.lon')} AS km
    FROM quakes q JOIN sources s ON s.lat BETWEEN q.lat - 5 AND q.lat + 5 WHERE q.magnitude >= 6.0) WHERE km <= 500) WHERE rank <= 45"""),
)
def nearest_sources(spark, sf_dir):
    big = spread(quakes(spark, sf_dir)).where(F.col("magnitude") >= 6.0)
    out = J.nearest_sources(big, sources(spark, sf_dir))
    return out.select("event_id", "source_id", F.round("km", 4).alias("km"), F.col("rank").cast("long").alias("rank"))


@C.add(
    "strike_consensus",
    with_cte(SOURCES, body="""SELECT source_id, zone, round(m, 6) AS mean_strike, least(abs(s - m), 180 - abs(s - m)) <= 30 AS kept FROM (
  SELECT source_id, s.zone, strike % 180 AS s, m FROM sources s JOIN (
    SELECT zone, degrees(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END / 2) AS m FROM (
      SELECT zone, atan2(sum(sin(radians((strike % 180) * 2))), sum(cos(radians((strike % 180) * 2)))) AS a FROM sources GROUP BY 1)) k
    ON k.zone = s.zone)"""),
)
def strike_consensus(spark, sf_dir):
    out = J.strike_consensus(sources(spark, sf_dir), "zone")
    return out.select("source_id", "zone", F.round("mean_strike", 6).alias("mean_strike"), "kept")


@C.add(
    "event_windows",
    with_cte(OBS, QUAKES, body="""SELECT 'event' AS side, event_id, count(*) AS n, round(max(abs(value_m)), 6) AS peak,
  round(min(ts_us - origin_us) / 1000000.0::DOUBLE, 3) AS first_sec
FROM obs JOIN quakes ON ts_us BETWEEN origin_us - 3600000000 AND origin_us + 21600000000 WHERE magnitude >= 6.0 GROUP BY 2
UNION ALL SELECT 'calibration', event_id, count(*), round(max(abs(value_m)), 6), round(min(ts_us - origin_us) / 1000000.0::DOUBLE, 3)
FROM obs JOIN quakes ON ts_us BETWEEN origin_us - 2592000000000 AND origin_us - 3600000000
WHERE magnitude >= 6.0 AND measurement_type = 1 GROUP BY 2"""),
)
def event_windows(spark, sf_dir):
    """The event window and the calibration window of every trigger, in all zones."""
    obs = observations(spark, sf_dir).select("ts_us", F.abs("value_m").alias("size"), "measurement_type")
    triggers = spread(quakes(spark, sf_dir)).where(F.col("magnitude") >= 6.0)

    def report(rows, side, before_us, after_us):
        spans = triggers.select("event_id", "origin_us", (F.col("origin_us") - before_us).alias("from_us"), (F.col("origin_us") + after_us).alias("to_us"))
        found = J.interval_aggregates(rows, spans, ["event_id", "origin_us"], 60_000_000, 14)
        return found.select("event_id", F.lit(side).alias("side"), "n", F.round("size", 6).alias("peak"),
                            F.round((F.col("first_us") - F.col("origin_us")) / F.lit(1_000_000.0), 3).alias("first_sec"))

    near = report(obs, "event", 3_600_000_000, 21_600_000_000)
    return near.unionByName(report(obs.where(F.col("measurement_type") == 1), "calibration", 30 * 86_400_000_000, -3_600_000_000))


@C.add(
    "usable_waveforms",
    """WITH g AS (SELECT DISTINCT l_suppkey AS station_id, l_partkey % 200 AS source_id FROM lineitem),
w AS (SELECT l_suppkey AS station_id, count(*) FILTER (l_linenumber <= 3) AS n_points FROM lineitem GROUP BY 1),
c AS (SELECT station_id, count(*) AS n_sources FROM g WHERE source_id < 15 GROUP BY 1)
SELECT station_id, n_points, n_sources, CASE WHEN coalesce(n_sources, 0) < 15 THEN 'Station not in propagation database'
  WHEN n_points < 256 THEN 'Insufficient data for inversion window' END AS reason,
  coalesce(n_sources, 0) >= 15 AND n_points >= 256 AS usable FROM w LEFT JOIN c USING (station_id)""",
)
def usable_waveforms(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    greens = line.select(F.col("l_suppkey").alias("station_id"), (F.col("l_partkey") % 200).alias("source_id"))
    waves = line.groupBy(F.col("l_suppkey").alias("station_id")).agg(F.count_if(F.col("l_linenumber") <= 3).alias("n_points"))
    selected = greens.select("source_id").where(F.col("source_id") < 15).distinct()
    return J.usable_stations(greens, waves, selected, 256)


RESIDUAL = SERIES + """,
o AS (SELECT station_id, ts_us, min_by(value, seq) AS v FROM series GROUP BY 1, 2),
p AS (SELECT l_suppkey AS station_id, epoch_us(l_shipdate) AS ts_us, avg(l_quantity) * 1300 AS pred FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2),
j AS (SELECT station_id, ts_us, v, pred, v - pred AS d, ts_us < 946684800000000 AS pre FROM o JOIN p USING (station_id, ts_us)),
off AS (SELECT station_id, CASE WHEN count(*) FILTER (pre) > 5 THEN median(d) FILTER (pre) ELSE median(d) END AS off FROM j GROUP BY 1)"""


@C.add(
    "residual_vs_prediction",
    with_cte(RESIDUAL, body="""SELECT station_id, ts_us, round(d - off, 4) AS residual, round((ts_us - 946684800000000) / 60000000.0::DOUBLE, 3) AS minutes
FROM j JOIN off USING (station_id)"""),
)
def residual_vs_prediction(spark, sf_dir):
    from ..operators.tide import residual_vs_prediction as against

    obs = S.dedup_series(series(spark, sf_dir), ["station_id"], "first")
    pred = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linenumber") % 2 == 1)
        .groupBy(F.col("l_suppkey").alias("station_id"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"))
        .agg((F.avg("l_quantity") * 1300).alias("prediction"))
    )
    out = against(obs, pred, ["station_id"], 946_684_800_000_000)
    return out.select("station_id", "ts_us", F.round("residual", 4).alias("residual"), F.round("minutes", 3).alias("minutes"))


@C.add(
    "latest_revision",
    with_cte(QUAKES, body="""SELECT l.event_id, l.revision_id, l.updated_us FROM (
  SELECT o_custkey AS event_id, o_orderkey AS revision_id, epoch_us(o_orderdate) AS updated_us,
   row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) DESC, o_orderkey % 4 DESC, o_orderkey DESC) AS r
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '2000-01-01') l WHERE r = 1"""),
)
def latest_revision(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"),
        F.when(F.col("o_orderstatus") != "P", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("updated_us"),
        (F.col("o_orderkey") % 4).alias("partition"),
        F.col("o_orderkey").alias("offset"),
        F.col("o_orderkey").alias("revision_id"),
    )
    valid = rows.where(F.col("updated_us") <= 946_684_800_000_000)
    return J.latest_by(valid, ["event_id"], ["updated_us", "partition", "offset"], ["revision_id"]).select(
        "event_id", "revision_id", "updated_us"
    )


@C.add(
    "azimuthal_spread",
    with_cte(ARRIVALS, QUAKES, body=f"""SELECT event_id, count(*) AS n_stations,
  round(CASE WHEN count(*) < 2 THEN 0 ELSE 360 - greatest(max(gap), min(b) + 360 - max(b)) END, 6) AS spread_deg FROM (
  SELECT event_id, b, b - lag(b) OVER (PARTITION BY event_id ORDER BY b, station_id) AS gap FROM (
    SELECT a.event_id, a.station_id, {bearing_sql('q.lat', 'q.lon', 'a.lat', 'a.lon')} AS b FROM arrivals a JOIN quakes q USING (event_id))) GROUP BY 1"""),
)
def azimuthal_spread(spark, sf_dir):
    at = arrivals(spark, sf_dir).select("event_id", "station_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    both = at.join(quakes(spark, sf_dir).select("event_id", "lat", "lon"), "event_id")
    b = geo.initial_bearing_deg(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    out = J.azimuthal_spread(both.select("event_id", "station_id", b.alias("bearing")))
    return out.withColumn("spread_deg", F.round("spread_deg", 6))
