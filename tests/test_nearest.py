"""Nearest sources against all pairs, and the rows that leave the groups."""

import numpy as np
import pandas as pd

from tidelattice.operators import inversion as I
from tidelattice.operators import joins as J


def points(rng, n, name):
    return pd.DataFrame({name: np.arange(n), "lat": np.degrees(np.arcsin(rng.uniform(-1, 1, n))), "lon": rng.uniform(-180, 180, n)})


def test_nearest_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    events, sources = points(rng, 60, "event_id"), points(rng, 4_000, "source_id")
    # Equal places and ties at the last rank, a repeated event, and places nobody knows.
    sources.loc[100:260, ["lat", "lon"]] = (10.0, 179.9)
    events.loc[0, ["lat", "lon"]], events.loc[1, ["lat", "lon"]] = (10.0, -179.9), (10.0, 179.9)
    events = pd.concat([events, events.iloc[:2]])
    monkeypatch.setattr(J, "EVENTS_PER_GROUP", 1)
    monkeypatch.setattr(J, "PRODUCTS_AT_ONCE", 500)
    got = J.nearest_sources(spark.createDataFrame(events), spark.createDataFrame(sources), 1_000.0, 20).toPandas()
    a, b = (np.radians(x[["lat", "lon"]].to_numpy(float)) for x in (events, sources))
    h = np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h)))
    all_pairs = pd.DataFrame([(e, s, round(km[i, s], 6)) for i, e in enumerate(events["event_id"]) for s in np.flatnonzero(km[i] <= 1_000)], columns=["event_id", "source_id", "km"])
    want = all_pairs.sort_values(["event_id", "km", "source_id"], kind="stable").groupby("event_id").head(20)
    order = ["event_id", "rank"]
    got = got.sort_values(order)
    assert list(zip(got["event_id"], got["source_id"])) == list(zip(want["event_id"], want["source_id"]))
    assert np.allclose(got["km"], want["km"], atol=1e-5)


def test_pairs_beyond_the_wanted_never_become_rows(spark):
    """All sources of a dense place were once paired with each event before they were ranked."""
    rng = np.random.default_rng(5)
    lat = rng.uniform(0, 1, 3_000)
    sources = spark.createDataFrame(pd.DataFrame({"source_id": range(3_000), "lat": lat, "lon": rng.uniform(0, 1, 3_000)}))
    events = spark.createDataFrame(pd.DataFrame({"event_id": range(50), "lat": 0.5, "lon": 0.5}))
    out = J.nearest_sources(events, sources, 500.0, 5)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    assert out.count() == 250


def faulty(rng, n_events=40, n_sources=300):
    """Nearby sources of events and what is known of them, with sources listed twice, ties of distance and nulls."""
    near = pd.DataFrame({"event_id": np.repeat(np.arange(n_events), 12), "source_id": rng.integers(0, n_sources, 12 * n_events)})
    near["km"] = rng.integers(1, 30, len(near)).astype(float)
    known = pd.DataFrame({"source_id": np.arange(n_sources), "zone": rng.integers(0, 2, n_sources), "segment": rng.integers(0, 9, n_sources), "strike": rng.integers(0, 360, n_sources).astype(float)})
    return near, known.astype({"zone": "Int64", "segment": "Int64"})


def selected(near, known, limit):
    """The rule written out event by event."""
    out = []
    for event, rows in near.merge(known, on="source_id").groupby("event_id"):
        doubled = np.radians(rows["strike"] % 180 * 2)
        mean = np.degrees(np.arctan2(np.nansum(np.sin(doubled)), np.nansum(np.cos(doubled))) % (2 * np.pi)) / 2
        off = (rows["strike"] % 180 - mean).abs()
        kept = np.minimum(off, 180 - off) <= 30
        rows = rows[kept] if kept.any() else rows
        runs = []
        for zone, z in rows[rows["segment"].notna()].groupby("zone"):
            numbers = sorted(set(z["segment"]))
            for first in [x for x in numbers if x - 1 not in numbers]:
                last = first
                while last + 1 in numbers:
                    last += 1
                runs.append((first - last - 1, zone, first, last))
        if runs:
            _, zone, first, last = min(runs)
            best = rows[(rows["zone"] == zone) & rows["segment"].between(first, last)].sort_values(["km", "source_id"]).head(limit)
            out += [(event, *r) for r in best[["source_id", "zone", "segment", "km"]].itertuples(index=False)]
    return sorted(out)


def test_selected_sources_equal_the_rule(spark):
    rng = np.random.default_rng(6)
    near, known = faulty(rng)
    known.loc[:9, "segment"] = pd.NA
    known = pd.concat([known, known.iloc[20:40]])
    schema = "source_id long, zone long, segment long, strike double"
    faults = spark.createDataFrame([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in known.itertuples(index=False)], schema)
    got = I.select_sources(spark.createDataFrame(near), faults, 4).collect()
    assert sorted((r.event_id, r.source_id, r.zone, r.segment, r.km) for r in got) == selected(near, known, 4)
    assert not I.carried_faults(faults)


def test_pairs_dealt_by_event_are_moved_once(spark):
    """Pairs of events and sources were shuffled by source and by event again, and judged in copies of themselves."""
    rng = np.random.default_rng(7)
    events, places = points(rng, 30, "event_id"), points(rng, 300, "source_id")
    _, known = faulty(rng)
    sources = spark.createDataFrame(places.merge(known.astype({"zone": "int64", "segment": "int64"}), on="source_id"))
    carried = I.carried_faults(sources)
    assert set(carried) == set(I.FAULT)
    at = spark.createDataFrame(events)
    brought, plain = J.nearest_sources(at, sources, 2_000.0, 20, carried).drop("rank"), J.nearest_sources(at, sources, 2_000.0, 20).drop("rank")
    got, want = (I.select_sources(n, sources, 5) for n in (brought, plain))
    names = ["event_id", "source_id", "zone", "segment", "km", "rank"]
    assert got.count() and sorted(got.select(*names).collect()) == sorted(want.select(*names).collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(event_id")
        assert moves(I.select_sources(brought.select("*"), sources, 5)) == moves(brought.select("*")) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
