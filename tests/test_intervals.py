"""Joins by value and by interval against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidelattice.operators import joins as J
from tidelattice.operators import lineage as L


@pytest.mark.parametrize("n_history", [0, 2, 5, 400])
def test_nearest_by_value_equals_brute_force(spark, n_history):
    rng = random.Random(n_history)
    history = [(i, f"h{i}", rng.choice([round(rng.uniform(5, 9), 1), round(rng.uniform(5, 9), 4), 7.0])) for i in range(n_history)]
    events = [(i, rng.choice([round(rng.uniform(4, 10), 1), 7.0, 7.05])) for i in range(150)]
    past = spark.createDataFrame(history, "position long, name string, mw double")
    got = L.similar_events(spark.createDataFrame(events, "event_id long, magnitude double"), past, 3).collect()
    want = set()
    for e, m in events:
        for r, (d, _, name) in enumerate(sorted((round(abs(mw - m), 9), p, name) for p, name, mw in history)[:3]):
            want.add((e, r, name, d))
    assert {(r.event_id, r["rank"], r.name, r.difference) for r in got} == want and len(got) == len(want)


def test_interval_aggregates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-3_000, 20_000), rng.choice([0.5, 1.0, rng.random()])) for _ in range(600)]
    spans = [(i, a := rng.randrange(-4_000, 20_000), a + rng.choice([-5, 0, 1, 9, 10, 50, 333, 5_000, 40_000])) for i in range(300)]
    got = J.interval_aggregates(
        spark.createDataFrame(rows, "ts_us long, size double"), spark.createDataFrame(spans, "k long, from_us long, to_us long"), ["k"], 10, 5
    )
    want = set()
    for k, a, b in spans:
        inside = [(t, s) for t, s in rows if a <= t <= b]
        if inside:
            want.add((k, len(inside), max(s for _, s in inside), min(t for t, _ in inside), max(t for t, _ in inside)))
    assert {tuple(r) for r in got.collect()} == want


def test_surface_wave_suspects_equal_brute_force(spark):
    rng = random.Random(4)
    hour = 3_600_000_000
    places = [(0.0, 0.0), (35.0, 179.5), (-60.0, 10.0)]
    quakes = [(rng.randrange(0, 40 * hour), rng.uniform(-70, 70), rng.uniform(-180, 180)) for _ in range(300)]
    spikes = [(i, rng.randrange(0, 41 * hour), *rng.choice(places)) for i in range(800)] + [(900, 5 * hour, None, None)]
    frame = spark.createDataFrame(spikes, "k long, ts_us long, lat double, lon double")
    shakes = spark.createDataFrame(quakes, "origin_us long, lat double, lon double")
    got = {r.k for r in J.rayleigh_suspects(frame, shakes, "k").collect()}
    pairs = frame.where("lat is not null").alias("s").crossJoin(shakes.alias("q"))
    km = J.haversine_km(F.col("s.lat"), F.col("s.lon"), F.col("q.lat"), F.col("q.lon"))
    travel, expected = (F.col("s.ts_us") - F.col("q.origin_us")) / 1e6, F.col("km") / J.RAYLEIGH_SPEED_KM_S
    fits = (travel > 0) & (F.col("km") <= J.RAYLEIGH_MAX_KM) & (expected >= J.RAYLEIGH_MIN_TRAVEL_SEC) & (F.abs(travel - expected) / expected <= J.RAYLEIGH_TOLERANCE)
    want = {r.k for r in pairs.withColumn("km", km).where(fits).select("k").distinct().collect()}
    assert got == want and 0 < len(want) < len(spikes)


def test_quiet_by_the_earthquakes_known_then(spark):
    minute = 60_000_000
    quakes = spark.createDataFrame([(100 * minute, 9.0), (3000 * minute, 9.0), (50 * minute, 3.0)], "origin_us long, magnitude double")
    rows = spark.createDataFrame([(t * minute,) for t in (0, 60, 100, 190, 191, 2999, 3000, 5000)], "ts_us long")
    got = {r.ts_us // minute: r.quiet for r in J.with_quiet_then(rows, quakes).collect()}
    assert got == {0: True, 60: True, 100: False, 190: False, 191: True, 2999: True, 3000: False, 5000: True}
