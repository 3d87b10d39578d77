"""Source inversion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.evidence import ensemble_spread
from ..operators import inversion as I
from ..operators import joins as J
from ..session import cut_lineage
from . import Catalog
from .adapters import QUAKES, haversine_sql, quakes, table, with_cte
from .context import SOURCES, sources

C = Catalog()
K = 6
AREAS = [5.0e9] * K
RIGIDITY = [4.0e10] * K


def greens(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 20).alias("station_id"), (F.col("l_orderkey") % 64).alias("t"), (F.col("l_partkey") % K).alias("source_id")
    ).agg((F.avg("l_quantity") * 0.0199731).alias("h"))


def waveforms(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.year("l_shipdate").cast("long").alias("event_id"), (F.col("l_suppkey") % 20).alias("station_id"), (F.col("l_orderkey") % 64).alias("t")
    ).agg((F.avg("l_extendedprice") * 1.00137e-5).alias("d"))


_PAIRS = I.pairs(K)
BLOCKS = f"""g AS (SELECT l_suppkey % 20 AS station_id, l_orderkey % 64 AS t, l_partkey % {K} AS source_id, avg(l_quantity) * 0.0199731::DOUBLE AS h FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS event_id, l_suppkey % 20 AS station_id, l_orderkey % 64 AS t, avg(l_extendedprice) * 1.00137e-5::DOUBLE AS d FROM lineitem GROUP BY 1, 2, 3),
v AS (SELECT station_id, t, {', '.join(f'coalesce(sum(h) FILTER (source_id = {i}), 0) AS h{i}' for i in range(K))} FROM g GROUP BY 1, 2)"""


@C.add(
    "gram_blocks",
    with_cte(BLOCKS, body=f"""SELECT event_id, station_id, count(*) AS n, round(sum(d * d), 5) AS dd, unnest(range({len(_PAIRS) + K})) AS k,
  unnest([{', '.join([f'round(sum(h{i} * h{j}), 5)' for i, j in _PAIRS] + [f'round(sum(h{i} * d), 5)' for i in range(K)])}]) AS value
FROM w JOIN v USING (station_id, t) GROUP BY 1, 2"""),
)
def gram_blocks(spark, sf_dir):
    out = I.gram_blocks(greens(spark, sf_dir), waveforms(spark, sf_dir), range(K))
    return out.select(
        "event_id", "station_id", "n", F.round("dd", 5).alias("dd"), F.posexplode(F.concat("gram", "rhs")).alias("k", "value")
    ).select("event_id", "station_id", "n", "dd", F.col("k").cast("long").alias("k"), F.round("value", 5).alias("value"))


def blocks(spark, sf_dir):
    return cut_lineage(I.gram_blocks(greens(spark, sf_dir), waveforms(spark, sf_dir), range(K)))


@C.add("invert_sources")
def invert_sources(spark, sf_dir):
    return I.invert_sources(blocks(spark, sf_dir), K, AREAS, RIGIDITY)


@C.add("bootstrap_inversion")
def bootstrap_inversion(spark, sf_dir):
    samples = I.bootstrap_inversion(blocks(spark, sf_dir), K)
    mw = I.moment_magnitude(F.col("weights"), AREAS, RIGIDITY)
    return samples.withColumn("mw", mw).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_iterations"), *[F.percentile("mw", p).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))]
    )


@C.add("leave_one_out")
def leave_one_out(spark, sf_dir):
    return I.leave_one_out(blocks(spark, sf_dir), K)


@C.add("bootstrap_patterns")
def bootstrap_patterns(spark, sf_dir):
    """Ranked source patterns of the resampled inversions, with misfit over all data."""
    held = blocks(spark, sf_dir)
    samples = cut_lineage(I.bootstrap_inversion(held, K))
    return I.pattern_posterior(samples, K, I.sum_blocks(held, ["event_id"], K))


W = """lw AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS event_id, l_orderkey % 200 AS iteration, l_partkey % 6 AS source_id,
  greatest(0.0::DOUBLE, round(avg(l_discount) - 0.05::DOUBLE, 6) * 0.7310585::DOUBLE) AS w FROM lineitem GROUP BY 1, 2, 3),
wide AS (SELECT event_id, iteration, """ + ", ".join(f"coalesce(max(w) FILTER (source_id = {i}), 0) AS w{i}" for i in range(6)) + """ FROM lw GROUP BY 1, 2)"""


def long_weights(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.year("l_shipdate").cast("long").alias("event_id"), (F.col("l_orderkey") % 200).alias("iteration"), (F.col("l_partkey") % 6).alias("source_id")
    ).agg(F.greatest(F.lit(0.0), F.round(F.avg("l_discount") - 0.05, 6) * 0.7310585).alias("w"))


def wide_weights(spark, sf_dir):
    cells = [F.coalesce(F.max(F.when(F.col("source_id") == i, F.col("w"))), F.lit(0.0)) for i in range(6)]
    return long_weights(spark, sf_dir).groupBy("event_id", "iteration").agg(F.array(*cells).alias("weights"))


@C.add(
    "pattern_posterior",
    with_cte(W, body="""SELECT event_id, active, round(share, 6) AS share, round(total, 6) AS total_weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY share DESC, active) AS rank FROM (
    SELECT event_id, active, count(*) / max(n_all) AS share, """ + " + ".join(f"avg(w{i})" for i in range(6)) + """ AS total FROM (
      SELECT *, count(*) OVER (PARTITION BY event_id) AS n_all, concat_ws(',', """ + ", ".join(f"CASE WHEN w{i} > 1e-10 THEN '{i}' END" for i in range(6)) + """) AS active FROM wide)
    GROUP BY 1, 2))"""),
)
def pattern_posterior(spark, sf_dir):
    out = I.pattern_posterior(wide_weights(spark, sf_dir), 6)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "event_id", "active", F.round("share", 6).alias("share"), F.round(total, 6).alias("total_weight"), F.col("rank").cast("long").alias("rank")
    )


COAST = W + """,
f AS (SELECT DISTINCT p_size % 5 AS site_id, p_partkey % 6 AS source_id, ((p_size % 5) * 7 + (p_partkey % 6) * 3) % 11 / 10.0::DOUBLE AS peak_m,
  (((p_size % 5) * 13 + (p_partkey % 6) * 17) % 100 * 60)::DOUBLE AS travel_sec FROM part),
per AS (SELECT event_id, iteration, site_id, greatest(0, sum(w * peak_m) * CASE WHEN site_id = 2 THEN 1.1::DOUBLE ELSE 1 END) AS a,
  min(CASE WHEN w > 1e-10 THEN travel_sec END) AS arr FROM lw JOIN f USING (source_id) GROUP BY 1, 2, 3)"""


def coast(spark, sf_dir):
    site, src = F.col("p_size") % 5, F.col("p_partkey") % 6
    factors = table(spark, sf_dir, "part").select(
        site.alias("site_id"), src.alias("source_id"), ((site * 7 + src * 3) % 11 / F.lit(10.0)).alias("peak_m"),
        ((site * 13 + src * 17) % 100 * 60).cast("double").alias("travel_sec"),
    ).distinct()
    tides = factors.select("site_id").distinct().where(F.col("site_id") == 2).withColumn("correction", F.lit(0.1))
    return I.coastal_proxies(long_weights(spark, sf_dir), factors, tides)


@C.add(
    "coastal_proxies",
    with_cte(COAST, body="""SELECT event_id, site_id, round(quantile_cont(a, 0.1), 6) AS p10_m, round(quantile_cont(a, 0.5), 6) AS p50_m, round(quantile_cont(a, 0.9), 6) AS p90_m,
  round(coalesce(quantile_cont(arr, 0.5), 0), 6) AS arrival_sec, round(coalesce((max(arr) - min(arr)) / 60, 0), 6) AS arrival_spread_min FROM per GROUP BY 1, 2"""),
)
def coastal_proxies(spark, sf_dir):
    sites, _ = coast(spark, sf_dir)
    for c in ("p10_m", "p50_m", "p90_m", "arrival_sec", "arrival_spread_min"):
        sites = sites.withColumn(c, F.round(c, 6))
    return sites


@C.add(
    "ensemble_spread",
    with_cte(COAST, body="""SELECT event_id, CASE WHEN p10 <= 0 THEN 'HIGH' WHEN p90 / p10 < 2 THEN 'LOW' WHEN p90 / p10 <= 5 THEN 'MODERATE' ELSE 'HIGH' END AS spread FROM (
  SELECT event_id, quantile_cont(m, 0.1) AS p10, quantile_cont(m, 0.9) AS p90 FROM (SELECT event_id, iteration, max(a) AS m FROM per GROUP BY 1, 2) GROUP BY 1)"""),
)
def ensemble_spread_query(spark, sf_dir):
    from ..operators.partitioned import exact_percentiles

    _, largest = coast(spark, sf_dir)
    shape = exact_percentiles(largest, ["event_id"], "max_amplitude_m", {"p10": 0.1, "p90": 0.9})
    return shape.select("event_id", ensemble_spread(F.col("p10"), F.col("p90")).alias("spread"))


@C.add(
    "moment_magnitude",
    with_cte(W, body="SELECT event_id, iteration, round(CASE WHEN m > 0 THEN greatest(0, (2.0::DOUBLE / 3) * (log10(m) - 9.1::DOUBLE)) ELSE 0 END, 6) AS mw FROM (SELECT *, ("
        + " + ".join(f"w{i}" for i in range(6)) + ") * 2e20 AS m FROM wide)"),
)
def moment_magnitude(spark, sf_dir):
    mw = I.moment_magnitude(F.col("weights"), AREAS, RIGIDITY)
    return wide_weights(spark, sf_dir).select("event_id", "iteration", F.round(mw, 6).alias("mw"))


NEAR = f"""near AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, source_id) AS rank FROM (
  SELECT q.event_id, q.magnitude, s.*, {haversine_sql('q.lat', 'q.lon', 's.lat', 's.lon')} AS km
  FROM quakes q JOIN sources s ON s.lat BETWEEN q.lat - 5 AND q.lat + 5 WHERE q.magnitude >= 6.0) WHERE km <= 500)"""


def near_sources(spark, sf_dir, at=None, carried=()):
    big = quakes(spark, sf_dir).where(F.col("magnitude") >= 6.0)
    near = J.nearest_sources(big, sources(spark, sf_dir) if at is None else at, carried=carried)
    return near.join(J.broadcast_if_small(big.select("event_id", "magnitude")), "event_id")


@C.add(
    "seismic_only_weights",
    with_cte(QUAKES, SOURCES, NEAR, body="""SELECT event_id, source_id, round(pow(10, 0.5::DOUBLE * magnitude - 3) * exp(-km * km / (2 * s * s)), 6) AS weight FROM (
  SELECT *, greatest(1.0::DOUBLE, pow(10, 0.69::DOUBLE * magnitude - 3.22::DOUBLE) / 3) AS s FROM near WHERE rank <= 45)"""),
)
def seismic_only_weights(spark, sf_dir):
    return I.seismic_only_weights(near_sources(spark, sf_dir)).select("event_id", "source_id", F.round("weight", 6).alias("weight"))


@C.add(
    "select_sources",
    with_cte(QUAKES, SOURCES, NEAR, body="""SELECT event_id, source_id, zone, segment, rk AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, source_id) AS rk FROM (
    SELECT *, dense_rank() OVER (PARTITION BY event_id ORDER BY len DESC, zone, start) AS best FROM (
      SELECT i.*, (SELECT count(DISTINCT segment) FROM isl j WHERE j.event_id = i.event_id AND j.zone = i.zone AND j.island = i.island) AS len,
        (SELECT min(segment) FROM isl j WHERE j.event_id = i.event_id AND j.zone = i.zone AND j.island = i.island) AS start FROM isl i)) WHERE best = 1) WHERE rk <= 15""").replace(
        "SELECT event_id, source_id, zone, segment, rk AS rank FROM (",
        """, seg AS (SELECT *, source_id % 40 AS segment, strike % 180 AS st FROM (SELECT event_id, source_id, zone % 3 AS zone, strike, km FROM near WHERE rank <= 45)),
mean AS (SELECT event_id, degrees(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END / 2) AS m FROM (
  SELECT event_id, atan2(sum(sin(radians(st * 2))), sum(cos(radians(st * 2)))) AS a FROM seg GROUP BY 1)),
jud AS (SELECT s.*, least(abs(st - m), 180 - abs(st - m)) <= 30 AS kept FROM seg s JOIN mean USING (event_id)),
ori AS (SELECT * FROM jud WHERE kept OR NOT (SELECT bool_or(kept) FROM jud k WHERE k.event_id = jud.event_id)),
isl AS (SELECT *, segment - dense_rank() OVER (PARTITION BY event_id, zone ORDER BY segment) AS island FROM ori)
SELECT event_id, source_id, zone, segment, rk AS rank FROM (""", 1),
)
def select_sources(spark, sf_dir):
    k = F.col("source_id")
    faults = sources(spark, sf_dir).withColumn("segment", k % 40).withColumn("zone", F.col("zone") % 3)
    near = near_sources(spark, sf_dir, faults, I.carried_faults(faults)).drop("rank")
    out = I.select_sources(near, faults)
    return out.select("event_id", "source_id", "zone", "segment", F.col("rank").cast("long").alias("rank"))
