"""Geo-temporal and interval joins as equi-joins on cells and buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import haversine_km, travel_time_sec
from ..schemas import (
    COHERENCE_FLOOR_SEC,
    COHERENCE_MIN_STATIONS,
    COHERENCE_TOLERANCE,
    EARTH_RADIUS_KM,
    MAX_SOURCES,
    QUIET_LOOKBACK_MIN,
    QUIET_MAGNITUDE,
    RAYLEIGH_MAX_KM,
    RAYLEIGH_MIN_TRAVEL_SEC,
    RAYLEIGH_SPEED_KM_S,
    RAYLEIGH_TOLERANCE,
    SOURCE_RADIUS_KM,
)
from ..session import cut_lineage
from .partitioned import BUCKET, broadcast_if_small, running_sum, time_bucket

# Events of a cube that one group holds, and products of events and sources formed at once.
EVENTS_PER_GROUP, PRODUCTS_AT_ONCE = 20_000, 4_000_000
# Rows of a task that deals its own rows by key.
ROWS_PER_TASK = 1_000_000

def with_coordinates(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Station coordinates; unknown stations keep nulls."""
    return df.join(broadcast_if_small(registry.select("station_id", "lat", "lon")), "station_id", "left")


def with_quiet(df: DataFrame, quakes: DataFrame, monitoring: Column | None = None) -> DataFrame:
    """`quiet` unless a large event lies after t - 90 min.

    The rule has no upper bound on the origin, so the newest large origin decides
    for every row: one aggregate, used as a scalar, and no join.
    """
    newest = quakes.where(F.col("magnitude") >= QUIET_MAGNITUDE).agg(F.max("origin_us")).scalar()
    cutoff = F.col("ts_us") - QUIET_LOOKBACK_MIN * 60_000_000
    quiet = newest.isNull() | (newest < cutoff)
    if monitoring is not None:
        quiet = quiet & ~monitoring
    return df.withColumn("quiet", quiet)


def with_quiet_then(df: DataFrame, quakes: DataFrame) -> DataFrame:
    """`quiet` by the earthquakes known at each row's time: none large in the 90 minutes before it.

    Readings and large origins are interleaved in time order, in buckets as long as the
    look-back; only the bucket before can still matter, and it hands over its newest origin.
    """
    rows = df.withColumn("_origin", F.lit(None).cast("long"))
    large = quakes.where(F.col("magnitude") >= QUIET_MAGNITUDE).select(F.col("origin_us").alias("ts_us"), F.col("origin_us").alias("_origin"))
    both = rows.unionByName(large, allowMissingColumns=True).withColumn(BUCKET, time_bucket("ts_us", QUIET_LOOKBACK_MIN * 60))
    carried = both.where("_origin is not null").groupBy((F.col(BUCKET) + 1).alias(BUCKET)).agg(F.max("_origin").alias("_carried"))
    inside = Window.partitionBy(BUCKET).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, 0)
    newest = F.greatest(F.max("_origin").over(inside), F.col("_carried"))
    seen = both.join(broadcast_if_small(carried), BUCKET, "left").withColumn("_newest", newest)
    quiet = F.col("_newest").isNull() | (F.col("_newest") < F.col("ts_us") - QUIET_LOOKBACK_MIN * 60_000_000)
    return seen.where(F.col("_origin").isNull()).withColumn("quiet", quiet).drop(BUCKET, "_origin", "_carried", "_newest")


def rayleigh_suspects(spikes: DataFrame, quakes: DataFrame, key: str) -> DataFrame:
    """Keys of spikes whose delay fits a surface wave from some earthquake.

    Each (place, earthquake) within reach is one interval of arrival times. Starts,
    ends and spikes of a place are put in one time order and a running count of open
    intervals answers each spike, so no spike meets an earthquake; a busy place is
    split into time buckets.
    """
    at = spikes.where(F.col("lat").isNotNull()).select(key, F.col("ts_us").cast("double").alias("_t"), "lat", "lon")
    waves = arrival_intervals(at.select("lat", "lon").distinct(), quakes)
    # At equal times starts come before spikes and spikes before ends: both ends belong to an interval.
    marks = waves.select("lat", "lon", F.explode(F.array(F.struct(F.col("from_us").alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_d")),
                                                         F.struct(F.col("to_us").alias("_t"), F.lit(2).alias("_o"), F.lit(-1).alias("_d")))).alias("_m")).select("lat", "lon", "_m.*")
    both = marks.unionByName(at.withColumn("_o", F.lit(1)).withColumn("_d", F.lit(0)), allowMissingColumns=True)
    bucket = F.floor(F.col("_t") / F.lit(86_400_000_000.0)).cast("long")
    counted = running_sum(both, ["lat", "lon"], ["_t", "_o"], bucket, F.col("_d"), "_open")
    return counted.where((F.col("_o") == 1) & (F.col("_open") > 0)).select(key).distinct()


def arrival_intervals(places: DataFrame, quakes: DataFrame) -> DataFrame:
    """(lat, lon, from_us, to_us): when surface waves of earthquakes within reach may arrive at a place.

    Places and earthquakes meet by bands of latitude that are wider than the reach.
    """
    band_deg = 30.0
    band = F.floor(F.col("lat") / band_deg).cast("int")
    near = places.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    far = quakes.select("origin_us", F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon"), band.alias("_band"))
    # Latitude alone bounds the distance from below (111 km a degree).
    met = far.join(broadcast_if_small(near), "_band").where(F.abs(F.col("lat") - F.col("_qlat")) * 111.0 <= RAYLEIGH_MAX_KM)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_qlat"), F.col("_qlon"))
    met = met.withColumn("_km", km).withColumn("_sec", F.col("_km") / RAYLEIGH_SPEED_KM_S)
    fits = met.where((F.col("_km") <= RAYLEIGH_MAX_KM) & (F.col("_sec") >= RAYLEIGH_MIN_TRAVEL_SEC))
    start, end = (F.col("origin_us") + F.col("_sec") * (x * 1e6) for x in (1 - RAYLEIGH_TOLERANCE, 1 + RAYLEIGH_TOLERANCE))
    return fits.select("lat", "lon", start.alias("from_us"), end.alias("to_us"))


def spatial_coherence(arrivals: DataFrame, event: str = "event_id") -> DataFrame:
    """Per event, how many later stations fit the travel time from the first one."""
    first = arrivals.groupBy(event).agg(F.min(F.struct("ts_us", "station_id", "lat", "lon")).alias("first"))
    pairs = arrivals.join(first, event).where(F.col("station_id") != F.col("first.station_id"))
    km = haversine_km(F.col("first.lat"), F.col("first.lon"), F.col("lat"), F.col("lon"))
    expected = F.greatest(travel_time_sec(km), F.lit(COHERENCE_FLOOR_SEC))
    delay = (F.col("ts_us") - F.col("first.ts_us")) / F.lit(1_000_000.0)
    fits = delay.between(expected * (1 - COHERENCE_TOLERANCE), expected * (1 + COHERENCE_TOLERANCE))
    return pairs.groupBy(event).agg(F.count(F.lit(1)).alias("n_others"), F.count_if(fits).alias("n_confirming")).withColumn(
        "confirmed", F.col("n_confirming") >= COHERENCE_MIN_STATIONS
    ).withColumn("coherence", F.least(F.lit(1.0), F.col("n_confirming") / F.lit(float(COHERENCE_MIN_STATIONS))))


def bind_to_event(
    rows: DataFrame, triggers: DataFrame, keys: Sequence[str], active_us: int, order: Sequence[str], bucket_us: int
) -> DataFrame:
    """Attach the newest trigger still active at each row's instant.

    Triggers are copied into the time buckets they can reach and interleaved with
    the rows, so one sort per (key, bucket) answers every row; no pair is emitted.
    """
    first = F.floor(F.col("trigger_us") / bucket_us).cast("long")
    last = F.floor((F.col("trigger_us") + F.lit(active_us - 1)) / bucket_us).cast("long")
    marks = triggers.select(
        *keys,
        F.explode(F.sequence(first, last)).alias("_bucket"),
        F.col("trigger_us").alias("ts_us"),
        F.struct("trigger_us", "event_id").alias("_mark"),
        F.lit(0).alias("_side"),
    )
    placed = rows.withColumn("_bucket", F.floor(F.col("ts_us") / bucket_us).cast("long")).withColumn("_side", F.lit(1))
    both = placed.unionByName(marks, allowMissingColumns=True)
    along = Window.partitionBy(*keys, "_bucket").orderBy("ts_us", "_side", "_mark", *order)
    newest = F.last("_mark", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("_active", newest).where(F.col("_side") == 1)
    live = F.col("ts_us") < F.col("_active.trigger_us") + active_us
    return (
        seen.withColumn("event_id", F.when(live, F.col("_active.event_id")))
        .withColumn("trigger_us", F.when(live, F.col("_active.trigger_us")))
        .drop("_bucket", "_side", "_mark", "_active")
    )


def _cell(lat: Column, lon: Column, size_km: float) -> list[Column]:
    """Cube of edge `size_km` holding the point on the sphere; no poles, no date line."""
    flat = F.cos(F.radians(lat)) * EARTH_RADIUS_KM
    xyz = (flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat)) * EARTH_RADIUS_KM)
    return [F.floor(c / size_km).cast("int") for c in xyz]


def nearest_sources(
    events: DataFrame, sources: DataFrame, radius_km: float = SOURCE_RADIUS_KM, k: int = 3 * MAX_SOURCES, carried: Sequence[str] = ()
) -> DataFrame:
    """Up to `k` sources within the radius of each event, nearest first, with the columns `carried` of each source.

    Events and sources meet by cubes as wide as the radius. A group holds the events of
    one cube, at most about `EVENTS_PER_GROUP` of them, and the sources in reach; it passes
    on only what may be among the nearest `k` of an event, so no pair beyond that is a row.
    These pairs are dealt by event once, over partitions that hold about `ROWS_PER_TASK` of
    them however many there are; what follows by event moves them no more.
    """
    cx, cy, cz = _cell(F.col("lat"), F.col("lon"), radius_km)
    cube = ["_x", "_y", "_z"]
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    # Of sources at one place only the first k are ever among the nearest k.
    at_place = Window.partitionBy("lat", "lon").orderBy("source_id")
    first = sources.where(known).select("source_id", "lat", "lon", *carried).withColumn("_n", F.row_number().over(at_place)).where(F.col("_n") <= k)
    spread = (
        first.select("source_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), *carried, *[c.alias(n) for c, n in zip((cx, cy, cz), "abc")])
        .withColumn("_x", F.explode(F.transform(step, lambda d: F.col("a") + d)))
        .withColumn("_y", F.explode(F.transform(step, lambda d: F.col("b") + d)))
        .withColumn("_z", F.explode(F.transform(step, lambda d: F.col("c") + d)))
        .drop("a", "b", "c")
    )
    at = events.where(known).select("event_id", "lat", "lon", cx.alias("_x"), cy.alias("_y"), cz.alias("_z"))
    counted = cut_lineage(at.groupBy(*cube).agg(F.count(F.lit(1)).alias("_n")))
    default = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(default, -(-(counted.agg(F.sum("_n")).first()[0] or 0) * k // ROWS_PER_TASK))
    shares = broadcast_if_small(counted.select(*cube, F.ceil(F.col("_n") / F.lit(EVENTS_PER_GROUP)).cast("int").alias("_shares")))
    here = at.join(shares, cube).withColumn("_share", F.pmod(F.xxhash64("event_id"), F.col("_shares")).cast("int")).drop("_shares")
    there = spread.join(shares, cube).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    # Rounding of a product of unit vectors; it only lets a few more rows through.
    slack, least = 1e-12, math.cos(radius_km / EARTH_RADIUS_KM) if radius_km < math.pi * EARTH_RADIUS_KM else -1.0

    def near_pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        if len(right):
            place, origin = _unit(right["s_lat"], right["s_lon"]), _unit(left["lat"], left["lon"])
            rows = max(1, PRODUCTS_AT_ONCE // len(right))
            for start in range(0, len(left), rows):
                close = origin[start : start + rows] @ place.T
                bound = np.full(len(close), least) if len(right) <= k else np.maximum(np.partition(close, len(right) - k, axis=1)[:, len(right) - k], least)
                i, j = np.nonzero(close >= bound[:, None] - slack)
                found.append((i + start, j))
        i, j = (np.concatenate(x) for x in zip(*found))
        one, other = left.iloc[i][["event_id", "lat", "lon"]].reset_index(drop=True), right.iloc[j][["source_id", "s_lat", "s_lon", *carried]].reset_index(drop=True)
        return pd.concat([one, other], axis=1)

    schema = T.StructType([*[here.schema[c] for c in ("event_id", "lat", "lon")], *[there.schema[c] for c in ("source_id", "s_lat", "s_lon", *carried)]])
    by_group = [*cube, "_share"]
    if parts > default:
        here, there = here.repartition(parts, *by_group), there.repartition(parts, *by_group)
    pairs = here.groupBy(*by_group).cogroup(there.groupBy(*by_group)).applyInPandas(near_pairs, schema)
    near = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))).where(
        F.col("km") <= radius_km
    ).select("event_id", "source_id", "km", *carried).repartition(parts, "event_id")
    by_distance = Window.partitionBy("event_id").orderBy("km", "source_id")
    return near.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k).select("event_id", "source_id", "km", "rank", *carried)


def _unit(lat: pd.Series, lon: pd.Series) -> np.ndarray:
    y, x = np.radians(lat.to_numpy(dtype=float)), np.radians(lon.to_numpy(dtype=float))
    return np.column_stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])


def event_windows(rows: DataFrame, events: DataFrame, before_us: int, after_us: int, bucket_us: int) -> DataFrame:
    """Rows inside [origin - before, origin + after] of each event, by bucket equi-join."""
    first = F.floor((F.col("origin_us") - before_us) / bucket_us).cast("long")
    last = F.floor((F.col("origin_us") + after_us) / bucket_us).cast("long")
    spans = events.select("event_id", "origin_us", F.explode(F.sequence(first, last)).alias("_bucket"))
    placed = rows.withColumn("_bucket", F.floor(F.col("ts_us") / bucket_us).cast("long"))
    since = F.col("ts_us") - F.col("origin_us")
    return (
        placed.join(broadcast_if_small(spans), "_bucket")
        .where(since.between(-before_us, after_us))
        .withColumn("seconds_from_origin", since / F.lit(1_000_000.0))
        .drop("_bucket")
    )


def interval_aggregates(rows: DataFrame, spans: DataFrame, keys: Sequence[str], base_us: int, levels: int) -> DataFrame:
    """Count, largest size and first and last instant of the rows inside each span, without pairs.

    `rows` have ts_us and size, `spans` the `keys`, from_us and to_us (both inside).
    Rows are folded once per bucket of `base_us` and again per block of 2, 4, ...
    buckets. A span is covered by at most two whole blocks of each size, which it
    meets by number, and by two border buckets, where it meets single instants. Spans
    longer than 2^levels buckets meet more than two of the largest blocks.
    """
    def folded(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))

    instants = rows.groupBy("ts_us").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    instants = instants.select(F.floor(F.col("ts_us") / base_us).cast("long").alias("_at"), "n", "size", F.col("ts_us").alias("first_us"), F.col("ts_us").alias("last_us"))
    sizes = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    blocks = folded(folded(instants, "_at").withColumn("_level", sizes).withColumn("_at", F.expr("shiftright(_at, _level)")), "_level", "_at")

    first, last = (F.floor(F.col(c) / base_us).cast("long") for c in ("from_us", "to_us"))
    cut = spans.where("from_us <= to_us").withColumn("_a", first).withColumn("_b", last)
    # Border buckets: single instants decide.
    borders = cut.withColumn("_at", F.explode(F.array_distinct(F.array("_a", "_b"))))
    inside = borders.join(instants, "_at").where("first_us BETWEEN from_us AND to_us").select(*keys, "n", "size", "first_us", "last_us")
    # Whole buckets (_a, _b): climbing the levels, an odd left end and an even right end stand alone.
    steps = F.expr(f"""aggregate(sequence(0, {levels}),
        named_struct('l', _a + 1, 'r', _b - 1, 'taken', cast(array() as array<struct<level:int,at:bigint>>)),
        (s, k) -> if(s.l > s.r, s, if(k = {levels},
            named_struct('l', s.r + 1, 'r', s.r, 'taken', concat(s.taken, transform(sequence(s.l, s.r), x -> named_struct('level', k, 'at', x)))),
            named_struct('l', shiftright(s.l + 1, 1), 'r', shiftright(s.r - 1, 1), 'taken', concat(s.taken,
                if(s.l % 2 != 0, array(named_struct('level', k, 'at', s.l)), cast(array() as array<struct<level:int,at:bigint>>)),
                if(s.r % 2 = 0 AND s.r >= s.l, array(named_struct('level', k, 'at', s.r)), cast(array() as array<struct<level:int,at:bigint>>)))))),
        s -> s.taken)""")
    whole = cut.select(*keys, F.explode(steps).alias("_t")).select(*keys, F.col("_t.level").alias("_level"), F.col("_t.at").alias("_at"))
    met = whole.join(broadcast_if_small(blocks), ["_level", "_at"]).select(*keys, "n", "size", "first_us", "last_us")
    return folded(inside.unionByName(met), *keys)


def usable_stations(greens: DataFrame, waveforms: DataFrame, selected: DataFrame, n_timepoints: int) -> DataFrame:
    """Stations every selected source reaches and whose waveform is long enough, with the reason if not."""
    needed = selected.agg(F.count(F.lit(1))).scalar()
    covered = greens.join(broadcast_if_small(selected), "source_id", "left_semi").groupBy("station_id").agg(
        F.countDistinct("source_id").alias("n_sources")
    )
    out = waveforms.join(covered, "station_id", "left")
    reason = F.when(F.coalesce("n_sources", F.lit(0)) < needed, "Station not in propagation database").when(
        F.col("n_points") < n_timepoints, "Insufficient data for inversion window"
    )
    return out.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Newest row per key as an aggregate, so copies collapse before the shuffle."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *payload)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in [*order, *payload]])


def dealt(rows: DataFrame, keys: Sequence[str], each: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of equal keys in one partition, about `each` rows in a partition however many there are.

    Aggregates, joins and windows that follow on these keys need no other shuffle, so the
    rows that their tables and sorts hold in a task do not grow with the input.
    """
    default = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(default, -(-rows.count() // each)), *keys)


def azimuthal_spread(bearings: DataFrame, key: str = "event_id") -> DataFrame:
    """Angle the stations cover: 360 less the largest gap between sorted bearings, wrap included."""
    along = Window.partitionBy(key).orderBy("bearing", "station_id")
    gaps = bearings.withColumn("_gap", F.col("bearing") - F.lag("bearing").over(along))
    out = gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_stations"), F.max("_gap").alias("_g"), (F.min("bearing") + 360 - F.max("bearing")).alias("_wrap")
    )
    spread = F.when(F.col("n_stations") < 2, 0.0).otherwise(360.0 - F.greatest("_g", "_wrap"))
    return out.select(key, "n_stations", spread.alias("spread_deg"))


def strike_consensus(sources: DataFrame, key: str, tolerance_deg: float = 30.0, few: bool = False) -> DataFrame:
    """Axial mean strike per key and which sources lie within the tolerance of it.

    With `few` a key has few rows; they are then judged where they are, in windows by key,
    and meet no second copy of themselves.
    """
    from ..functions.geo import strike_distance_deg

    doubled = F.radians(F.pmod(F.col("strike"), F.lit(180.0)) * 2)

    def axial(total_sin: Column, total_cos: Column) -> Column:
        return (F.degrees(F.pmod(F.atan2(total_sin, total_cos), F.lit(2 * 3.141592653589793)) / 2)).alias("mean_strike")

    if few:
        own = Window.partitionBy(key)
        joined = sources.where(F.col(key).isNotNull()).select("*", axial(F.sum(F.sin(doubled)).over(own), F.sum(F.cos(doubled)).over(own)))
    else:
        joined = sources.join(sources.groupBy(key).agg(axial(F.sum(F.sin(doubled)), F.sum(F.cos(doubled)))), key)
    return joined.withColumn("kept", strike_distance_deg(F.col("strike"), F.col("mean_strike")) <= tolerance_deg)
