"""Series hygiene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..session import cut_lineage
from . import Catalog
from .adapters import EPOCH_2024_US, OBS, SERIES, observations, series, table, with_cte

C = Catalog()
KEY = ["station_id"]
STATION = ["source_type", "station_id"]

DEDUP_SQL = SERIES + """,
one AS (SELECT station_id, ts_us, min_by(value, seq) AS value FROM series GROUP BY 1, 2)"""

HAMPEL_SQL = DEDUP_SQL + """,
near AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts_us) AS rn, count(*) OVER (PARTITION BY station_id) AS n,
  list(value) OVER (PARTITION BY station_id ORDER BY ts_us ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM one),
mids AS (SELECT *, list_aggregate(l, 'median') AS mid FROM near),
mads AS (SELECT *, 1.4826::DOUBLE * list_aggregate(list_transform(l, lambda x: abs(x - mid)), 'median') AS scale FROM mids),
hampel AS MATERIALIZED (SELECT station_id, ts_us, rn, n, value, scale >= 1e-12 AND abs(value - mid) > 3 * scale AS spike,
  CASE WHEN scale >= 1e-12 AND abs(value - mid) > 3 * scale THEN mid ELSE value END AS cleaned FROM mads)"""

SHIFT_SQL = HAMPEL_SQL + """,
dts AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY station_id ORDER BY rn) AS dt FROM hampel),
med AS (SELECT station_id, quantile_cont(dt::DOUBLE, 0.5) AS m FROM dts GROUP BY 1),
gapped AS (SELECT dts.*, n >= 11 AND m > 0 AND coalesce(dt > 6 * m, false) AS gap FROM dts JOIN med USING (station_id)),
segs AS MATERIALIZED (SELECT *, sum(gap::INT) OVER (PARTITION BY station_id ORDER BY rn) AS seg FROM gapped),
edges AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY station_id, seg ORDER BY rn) AS from_start,
  row_number() OVER (PARTITION BY station_id, seg ORDER BY rn DESC) AS from_end FROM segs),
heads AS (SELECT station_id, seg, median(cleaned) AS head FROM edges WHERE from_start <= 5 GROUP BY 1, 2),
tails AS (SELECT station_id, seg, median(cleaned) AS tail FROM edges WHERE from_end <= 5 GROUP BY 1, 2),
shifts AS (SELECT h.station_id, h.seg, sum(coalesce(head - tail, 0)) OVER (PARTITION BY h.station_id ORDER BY h.seg) AS total
  FROM heads h LEFT JOIN tails t ON t.station_id = h.station_id AND t.seg = h.seg - 1),
levelled AS (SELECT s.*, cleaned - total AS levelled FROM segs s JOIN shifts USING (station_id, seg))"""


def one_per_instant(spark, sf_dir):
    return S.dedup_series(series(spark, sf_dir), KEY, "first")


@C.add(
    "dedup_series",
    with_cte(SERIES, body="""SELECT station_id, ts_us, min_by(value, seq) AS v_first, max_by(value, seq) AS v_last, min(value) AS v_min,
  max(value) AS v_max, round(avg(value), 9) AS v_mean, count(*) AS copies FROM series GROUP BY 1, 2"""),
)
def dedup_series(spark, sf_dir):
    out = S.dedup_policies(series(spark, sf_dir), KEY)
    return out.select(
        "station_id", "ts_us", F.col("first").alias("v_first"), F.col("last").alias("v_last"), F.col("min").alias("v_min"),
        F.col("max").alias("v_max"), F.round("mean", 9).alias("v_mean"), "copies",
    )


@C.add(
    "duplicate_stats",
    with_cte(SERIES, body="""SELECT station_id, CAST(sum(c) AS BIGINT) AS rows_in, count(*) AS rows_out, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
  count(*) FILTER (spread > 0) AS conflicting_instants, round(max(spread), 6) AS largest_spread
FROM (SELECT station_id, ts_us, count(*) AS c, max(value) - min(value) AS spread FROM series GROUP BY 1, 2) GROUP BY 1"""),
)
def duplicate_stats(spark, sf_dir):
    return S.duplicate_stats(series(spark, sf_dir), KEY).withColumn("largest_spread", F.round("largest_spread", 6))


@C.add("hampel_filter", with_cte(HAMPEL_SQL, body="SELECT station_id, ts_us, spike, round(cleaned, 6) AS cleaned FROM hampel"))
def hampel_filter(spark, sf_dir):
    out = S.hampel(S.number_series(one_per_instant(spark, sf_dir), KEY), KEY)
    return out.select("station_id", "ts_us", "spike", F.round("cleaned", 6).alias("cleaned"))


@C.add("correct_level_shifts", with_cte(SHIFT_SQL, body="SELECT station_id, ts_us, round(levelled, 4) AS levelled FROM levelled"))
def correct_level_shifts(spark, sf_dir):
    numbered = S.number_series(one_per_instant(spark, sf_dir), KEY, total="n")
    out = S.correct_level_shifts(cut_lineage(S.hampel(numbered, KEY)), KEY)
    return out.select("station_id", "ts_us", F.round("levelled", 4).alias("levelled"))


@C.add(
    "clean_calibration",
    with_cte(SHIFT_SQL + """,
hrs AS (SELECT *, (ts_us - min(ts_us) OVER (PARTITION BY station_id)) / 3600000000.0::DOUBLE AS hours FROM levelled),
slopes AS (SELECT station_id, regr_slope(levelled, hours) AS slope FROM hrs GROUP BY 1)""",
        body="SELECT station_id, ts_us, round(levelled - coalesce(slope, 0) * hours, 3) AS clean FROM hrs JOIN slopes USING (station_id)"),
)
def clean_calibration(spark, sf_dir):
    out = S.clean_calibration(one_per_instant(spark, sf_dir), KEY)
    return out.select("station_id", "ts_us", F.round("clean", 3).alias("clean"))


@C.add(
    "rolling_station_window",
    with_cte(OBS, body="""SELECT source_type, station_id, ts_us, round(value_m, 6) AS value_m, n AS n_samples, n >= 10 AS sufficient
FROM (SELECT *, count(*) OVER p AS n FROM (
  SELECT source_type, station_id, ts_us, min_by(value_m, seq) AS value_m FROM (
    SELECT *, max(ts_us) OVER (PARTITION BY source_type, station_id) AS ref FROM obs) WHERE ts_us >= ref - 21600000000 GROUP BY 1, 2, 3)
  WINDOW p AS (PARTITION BY source_type, station_id))"""),
)
def rolling_station_window(spark, sf_dir):
    return S.rolling_window(observations(spark, sf_dir), STATION).withColumn("value_m", F.round("value_m", 6))


@C.add(
    "sample_windows",
    with_cte(OBS, body="""SELECT source_type, station_id, window_no, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, round(max(value_m), 6) AS top
FROM (SELECT o.*, (rn - 1) // per AS window_no FROM (
    SELECT *, row_number() OVER (PARTITION BY source_type, station_id ORDER BY ts_us) AS rn FROM obs) o
  JOIN (SELECT source_type, station_id, CAST(greatest(1, floor(21600.0::DOUBLE / quantile_cont(dt, 0.5))) AS BIGINT) AS per FROM (
      SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY source_type, station_id ORDER BY ts_us)) / 1000000.0::DOUBLE AS dt FROM obs)
    GROUP BY 1, 2) USING (source_type, station_id)) GROUP BY 1, 2, 3 HAVING count(*) >= 10"""),
)
def sample_windows(spark, sf_dir):
    placed = S.sample_windows(observations(spark, sf_dir).select(*STATION, "ts_us", "value_m"), STATION, 6.0)
    return placed.groupBy(*STATION, "window_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.round(F.max("value_m"), 6).alias("top")
    )


ORIGIN_US = EPOCH_2024_US + 10 * 86_400_000_000


@C.add(
    "growing_windows",
    with_cte(OBS, body=f"""SELECT source_type, station_id, k AS prefix_no, count(*) AS n, round(max(abs(value_m)), 6) AS peak FROM obs
JOIN range(1, 73) r(k) ON (ts_us - {ORIGIN_US}) / 60000000.0::DOUBLE <= 5 * k
WHERE (ts_us - {ORIGIN_US}) / 60000000.0::DOUBLE BETWEEN 0 AND 360 GROUP BY 1, 2, 3"""),
)
def growing_windows(spark, sf_dir):
    """Prefix counts and peaks by folding step totals, so no sample is repeated per prefix."""
    from pyspark.sql import Window

    placed = S.growing_windows(observations(spark, sf_dir), STATION, ORIGIN_US)
    steps = placed.groupBy(*STATION, "first_prefix").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("value_m")).alias("peak")
    )
    # At most one row per step exists now, so spreading it over its prefixes is bounded by 72 x 72.
    spread = steps.withColumn("prefix_no", F.explode(F.sequence(F.col("first_prefix"), F.lit(72).cast("long"))))
    return spread.groupBy(*STATION, "prefix_no").agg(F.sum("n").alias("n"), F.round(F.max("peak"), 6).alias("peak"))


@C.add(
    "series_equal",
    with_cte(SERIES, body="""SELECT station_id, side, count(*) AS n_rows FROM (
  (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL
  (SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))) GROUP BY 1, 2""").replace(
        "FROM lineitem)",
        """FROM lineitem),
a AS (SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY ts_us) AS rn, ts_us, v FROM (
  SELECT station_id, ts_us, min_by(value, seq) AS v FROM series GROUP BY 1, 2)),
b AS (SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY ts_us) AS rn, ts_us, v FROM (
  SELECT station_id, ts_us, max_by(value, seq) AS v FROM series GROUP BY 1, 2))""",
    ),
)
def series_equal(spark, sf_dir):
    a = S.dedup_series(series(spark, sf_dir), KEY, "first")
    b = S.dedup_series(series(spark, sf_dir), KEY, "last")
    return S.series_difference(a, b, KEY, "value").groupBy("station_id", "side").agg(F.count(F.lit(1)).alias("n_rows"))


@C.add(
    "data_gap",
    with_cte(OBS, body=f"""SELECT source_type, station_id, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM obs
WHERE ts_us < {ORIGIN_US} OR ts_us >= {ORIGIN_US} + 7200000000 GROUP BY 1, 2"""),
)
def data_gap(spark, sf_dir):
    kept = S.drop_gap(observations(spark, sf_dir), ORIGIN_US, 7200)
    return kept.groupBy(*STATION).agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@C.add(
    "contiguous_segments",
    """WITH seg AS (SELECT DISTINCT p_size AS zone, CAST(floor(p_retailprice) AS BIGINT) AS idx FROM part),
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY zone ORDER BY idx) AS island FROM seg),
runs AS (SELECT zone, min(idx) AS first_index, max(idx) AS last_index, count(*) AS run_length FROM isl GROUP BY zone, island)
SELECT *, row_number() OVER (PARTITION BY zone ORDER BY run_length DESC, first_index) AS run_rank FROM runs""",
)
def contiguous_segments(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("zone"), F.floor("p_retailprice").cast("long").alias("idx"))
    return S.contiguous_segments(part, "zone", "idx").withColumn("run_rank", F.col("run_rank").cast("long"))


@C.add(
    "canonical_order",
    with_cte(OBS, body="""SELECT seq, row_number() OVER (PARTITION BY source_type, station_id ORDER BY ts_us, payload_hash) AS place FROM obs"""),
)
def canonical_order(spark, sf_dir):
    from ..operators.partitioned import number_rows, time_bucket

    rows = observations(spark, sf_dir).select("seq", *STATION, "ts_us", "payload_hash")
    return number_rows(rows, STATION, ["ts_us", "payload_hash"], time_bucket("ts_us", 21_600), "place").select("seq", "place")


@C.add(
    "union_observations",
    with_cte(OBS, body="""SELECT source_type, station_id, count(*) AS n, round(avg(value_m), 10) AS mean_m, min(expected_interval_sec) AS min_interval FROM obs GROUP BY 1, 2"""),
)
def union_observations(spark, sf_dir):
    obs = observations(spark, sf_dir)
    common = ["source_type", "station_id", "ts_us", "value_m", "expected_interval_sec", "payload_hash"]
    dart = obs.where(F.col("source_type") == "dart").select(*common, "measurement_type")
    coops = obs.where(F.col("source_type") == "coops").select(*common, "product")
    both = dart.unionByName(coops, allowMissingColumns=True)
    return both.groupBy(*STATION).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value_m"), 10).alias("mean_m"), F.min("expected_interval_sec").alias("min_interval")
    )
