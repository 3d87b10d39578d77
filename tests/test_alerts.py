"""The alert machine: hand-made sequences, and the stream against the batch replay."""

import numpy as np
import pandas as pd

from tidelattice.operators import alerts as A
from tidelattice.streaming import jobs

HOUR = 3_600_000_000


def log(*rows):
    """(rank, hours, magnitude or score, depth or event-mode hours)"""
    out = []
    for i, (rank, hours, x, y) in enumerate(rows):
        ts = int(hours * HOUR)
        trigger = rank == A.TRIGGER
        out.append((1, ts // A.TICK_US, rank, ts, i if trigger else None, x if trigger else None, y if trigger else None,
                    None if trigger else x, None if trigger or y is None else int(y * HOUR)))
    return out


def run(spark, *rows):
    df = spark.createDataFrame(log(*rows), A.INPUT)
    return [(r["from_state"], r["to_state"]) for r in A.replay(df).orderBy("step").collect()]


def test_climbs_one_step_per_score_and_falls_back(spark):
    got = run(spark, (0, 0, 6.5, 10.0), (1, 1, 0.99, None), (1, 2, 0.99, None), (1, 3, 0.5, None), (1, 4, 0.2, None), (1, 5, 0.1, None))
    assert got == [("IDLE", "MONITOR"), ("MONITOR", "INVESTIGATE"), ("INVESTIGATE", "ASSESS"), ("ASSESS", "INVESTIGATE"), ("INVESTIGATE", "MONITOR")]


def test_large_shallow_event_escalates_at_once_and_only_a_decision_ends_it(spark):
    got = run(spark, (0, 0, 7.5, 99.9), (1, 20, 0.0, None), (2, 21, None, None), (0, 22, 7.6, None), (1, 23, 0.1, None))
    assert got == [("IDLE", "MONITOR"), ("MONITOR", "ESCALATE"), ("ESCALATE", "IDLE"), ("IDLE", "MONITOR")]


def test_unknown_depth_needs_confirmation(spark):
    """Event-mode readings older than the origin do not count; later ones latch."""
    got = run(spark, (0, 10, 8.0, None), (1, 11, 0.1, 9.0), (1, 12, 0.1, 11.5), (1, 13, 0.1, None), (1, 14, 0.1, None))
    assert got == [("IDLE", "MONITOR"), ("MONITOR", "INVESTIGATE"), ("INVESTIGATE", "ASSESS"), ("ASSESS", "ESCALATE")]


def test_evidence_in_the_tick_of_the_limit_counts_before_the_timeout(spark):
    assert run(spark, (0, 0, 6.0, 10.0), (1, 11.99, 0.1, None)) == [("IDLE", "MONITOR")]
    assert run(spark, (0, 0, 6.0, 10.0), (1, 12, 0.9, None)) == [("IDLE", "MONITOR"), ("MONITOR", "INVESTIGATE")]
    assert run(spark, (0, 0, 6.0, 10.0), (1, 12, 0.1, None)) == [("IDLE", "MONITOR"), ("MONITOR", "IDLE")]


def test_silence_ends_monitoring_at_the_limit(spark):
    got = A.replay(spark.createDataFrame(log((0, 0, 6.0, 10.0), (1, 13, 0.9, None)), A.INPUT)).orderBy("step").collect()
    assert [(r["from_state"], r["to_state"], r["ts_us"]) for r in got] == [("IDLE", "MONITOR", 0), ("MONITOR", "IDLE", 12 * HOUR)]
    # A score at the first threshold keeps the event, and a trigger after the end starts the next one.
    assert run(spark, (0, 0, 6.0, 10.0), (1, 1, 0.35, None), (1, 2, 0.2, None), (1, 13, 0.9, None))[-1] == ("MONITOR", "IDLE")
    assert run(spark, (0, 0, 6.0, 10.0), (0, 12.5, 6.1, 10.0))[-2:] == [("MONITOR", "IDLE"), ("IDLE", "MONITOR")]


def test_thresholds_are_inclusive_and_second_trigger_is_dropped(spark):
    got = run(spark, (0, 0, 6.0, 10.0), (1, 1, 0.35, None), (1, 2, 0.60, None), (1, 3, 0.85, None), (0, 4, 9.0, 1.0))
    assert [t for _, t in got] == ["MONITOR", "INVESTIGATE", "ASSESS", "ESCALATE"]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for basin in range(3):
        for i in range(300):
            ts = i * 900_000_000 + basin
            rank = int(rng.choice([0, 1, 2], p=[0.1, 0.85, 0.05]))
            quake = rank == 0
            rows.append((basin, ts // A.TICK_US, rank, ts, i if quake else None, float(rng.uniform(5.9, 8)) if quake else None,
                         float(rng.uniform(0, 200)) if quake else None, float(rng.random()) if rank == 1 else None, ts if rng.random() < 0.2 else None))
    df = spark.createDataFrame(rows, A.INPUT)
    batch = A.replay(df).toPandas()
    folder = str(tmp_path / "log")
    for part in range(4):
        df.where((df.tick >= part * 1200) & (df.tick < (part + 1) * 1200)).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(A.INPUT).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = jobs.run_to_table(jobs.alerts(source), "alerts-test").toPandas()
    order = ["basin", "step"]
    pd.testing.assert_frame_equal(batch.sort_values(order).reset_index(drop=True), stream.sort_values(order).reset_index(drop=True))
    assert len(batch) > 50


def test_a_timer_ends_silent_monitoring(spark, tmp_path):
    first = log((0, 100, 6.0, 10.0), (1, 101, 0.1, None))
    later = [(2, *row[1:]) for row in log((0, 130, 6.0, 10.0), (1, 131, 0.1, None))]
    folder = str(tmp_path / "log")
    for part in (first, later, [(2, *row[1:]) for row in log((1, 132, 0.1, None))]):
        spark.createDataFrame(part, A.INPUT).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(A.INPUT).option("maxFilesPerTrigger", 1).parquet(folder)
    got = jobs.run_to_table(jobs.alerts(source, live=True), "alerts-live").orderBy("basin", "step").collect()
    silent = [(r["from_state"], r["to_state"], r["ts_us"]) for r in got if r["basin"] == 1]
    assert silent == [("IDLE", "MONITOR", 100 * HOUR), ("MONITOR", "IDLE", 112 * HOUR)]
    assert [r["to_state"] for r in got if r["basin"] == 2] == ["MONITOR"]
