"""Quality flags against a plain loop over a small fixture with every boundary."""

import numpy as np
import pandas as pd
import pytest

from tidelattice.operators import quality as Q

LIMITS = {"dart": (0.1, 60, 0.001, 0.0001), "coops": (0.3, 240, 0.005, 0.001)}


def banded(x, limit):
    return 1 if x <= limit else 3 if x <= 2 * limit else 4


def brute(rows):
    out, prev, seen = {}, None, []
    for r in rows:
        spike, window, rate, flat = LIMITS[r["source_type"]]
        v = r["value_m"]
        dt = None if prev is None else (r["ts_us"] - prev["ts_us"]) / 1e6
        f = {"timing": 2 if dt is None or dt <= 0 else banded(dt, 2 * max(r["expected_interval_sec"], prev["expected_interval_sec"]))}
        if v is None:
            f |= {"spike": 9, "rate_of_change": 9, "flat_line": 9, "range": 9}
        else:
            usable = dt is not None and prev["value_m"] is not None and dt > 0
            jump = abs(v - prev["value_m"]) if usable else None
            f["spike"] = 2 if not usable or dt > window else banded(jump, spike)
            f["rate_of_change"] = 2 if not usable else banded(jump / dt, rate)
            near = [s["value_m"] for s in seen if s["value_m"] is not None and 0 <= r["ts_us"] - s["ts_us"] <= 3_600_000_000] + [v]
            f["flat_line"] = 2 if len(near) < 2 else 1 if max(near) - min(near) >= flat else 3
            f["range"] = 2 if r["source_type"] == "dart" else 1 if abs(v) <= 3 else 3 if abs(v) <= 4.5 else 4
        out[r["seq"]] = f
        prev = r
        seen.append(r)
    return out


@pytest.mark.parametrize("bucket", [3600, 900, 6 * 3600, 10 * 86400])
def test_flags_equal_the_loop(spark, bucket):
    rng = np.random.default_rng(3)
    rows = []
    for source, station in (("dart", "21401"), ("dart", "21402"), ("coops", "9410001")):
        t = 0
        for i in range(220):
            t += int(rng.choice([0, 15, 60, 120, 360, 900, 1800, 3600, 7200, 90_000], p=[0.08, 0.2, 0.2, 0.1, 0.1, 0.12, 0.1, 0.05, 0.03, 0.02]))
            v = None if rng.random() < 0.05 else float(rng.choice([0.0, 0.0, 0.05, 0.1, 0.2, 0.35, 3.0, 4.5, 5.0]))
            rows.append({"seq": len(rows), "source_type": source, "station_id": station, "ts_us": t * 1_000_000, "value_m": v,
                         "expected_interval_sec": int(rng.choice([15, 60, 360, 900])), "payload_hash": f"{rng.integers(1 << 40):064x}"})
    want = {}
    for key in {(r["source_type"], r["station_id"]) for r in rows}:
        mine = sorted((r for r in rows if (r["source_type"], r["station_id"]) == key), key=lambda r: (r["ts_us"], r["payload_hash"]))
        want |= brute(mine)
    schema = "seq long, source_type string, station_id string, ts_us long, value_m double, expected_interval_sec int, payload_hash string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5)
    got = {r["seq"]: {c: r[c] for c in ("timing", "spike", "rate_of_change", "flat_line", "range")} for r in Q.quality_flags(df, bucket).collect()}
    assert got == want


def test_confidence(spark):
    rows = [(1, 1, 1, 1, 1), (3, 1, 1, 1, 1), (4, 4, 1, 1, 1), (2, 2, 2, 2, 2), (9, 9, 9, 9, 2), (4, 2, 2, 2, 2)]
    df = spark.createDataFrame(rows, "timing int, `range` int, rate_of_change int, spike int, flat_line int")
    got = [(r["n_checks"], round(r["confidence"], 6), r["usable"]) for r in Q.with_confidence(df).collect()]
    assert got == [(5, 1.0, True), (5, 0.94, True), (5, 0.6, True), (0, 1.0, True), (0, 1.0, True), (1, 0.0, False)]


def test_non_finite_fails_and_never_passes(spark):
    df = spark.createDataFrame(pd.DataFrame({"value_m": [1.0, float("nan"), float("inf"), -float("inf"), 9999.0]}))
    assert Q.drop_sentinels(df).count() == 1


def test_no_frame_slides_over_the_last_hour(spark):
    """A frame with a lower bound is built anew for every row: quadratic in the readings of an hour."""
    schema = "seq long, source_type string, station_id string, ts_us long, value_m double, expected_interval_sec int, payload_hash string"
    flagged = Q.quality_flags(spark.createDataFrame([(1, "dart", "21401", 0, 0.0, 15, "00")], schema))
    plan = flagged._jdf.queryExecution().analyzed().toString().lower()
    assert "windowspecdefinition" in plan and "rangeframe" not in plan


def test_flags_of_dense_readings_equal_the_loop(spark):
    rng = np.random.default_rng(8)
    rows = [{"seq": i, "source_type": "dart", "station_id": "21401", "ts_us": int(t) * 1_000_000, "value_m": None if rng.random() < 0.1 else float(rng.normal(0, 3e-5)),
             "expected_interval_sec": 15, "payload_hash": f"{rng.integers(1 << 40):064x}"} for i, t in enumerate(np.sort(rng.integers(0, 4 * 3600, 900)) - 5400)]
    rows.sort(key=lambda r: (r["ts_us"], r["payload_hash"]))
    schema = "seq long, source_type string, station_id string, ts_us long, value_m double, expected_interval_sec int, payload_hash string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3)
    got = {r["seq"]: {c: r[c] for c in ("timing", "spike", "rate_of_change", "flat_line", "range")} for r in Q.quality_flags(df).collect()}
    assert got == brute(rows)
