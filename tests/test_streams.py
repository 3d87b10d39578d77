"""Streams whose state ends by the clock, and the guard's side output across restarts."""

import os
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelattice.operators import replay as R
from tidelattice.streaming import jobs
from tidelattice.streaming import processors as P

HOUR = 3_600_000_000
READING = "source_type string, station_id string, seq long, ts_us long, value_m double"


def feed(spark, tmp_path, schema, *batches):
    """A stream of the batches in order, one per micro-batch."""
    folder = str(tmp_path / "feed")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
        for file in (tmp_path / "feed" / f"b{i}").glob("*.parquet"):
            os.utime(file, (1_000_000 + i, 1_000_000 + i))  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_silent_station_leaves_the_rolling_window(spark, tmp_path):
    """Only the clock moves for station 1: its samples go and its state is empty."""
    first = [("dart", "1", i, i * HOUR // 2, 0.5) for i in range(20)] + [("dart", "1", 30, 3 * HOUR, 0.7), ("dart", "2", 40, 0, 0.1)]
    later = [("dart", "2", 50 + i, 17 * HOUR + i, 0.1) for i in range(3)]
    out = jobs.run_to_table(jobs.rolling_windows(feed(spark, tmp_path, READING, first, later), True, "1 hour"), "r").toPandas()
    one = out[out.station_id == "1"]
    assert sorted(zip(one.n_samples, one.last_us)) == [(0, int(9.5 * HOUR)), (13, int(9.5 * HOUR))]
    two = out[out.station_id == "2"]
    assert (3, 17 * HOUR + 2) in set(zip(two.n_samples, two.last_us))


def test_rolling_window_over_batches_equals_one_pass(spark, tmp_path):
    rows = [("dart", "1", i, (i * 7919 % 4000) * 9_000_000, float(i)) for i in range(1500)]
    batches = [rows[:300], rows[300:900], rows[900:]]
    out = jobs.run_to_table(jobs.rolling_windows(feed(spark, tmp_path, READING, *batches)), "r").toPandas()
    kept: dict = {}
    want = []
    for part in batches:
        for *_, ts, v in part:
            kept.setdefault(ts, v)
        newest = max(kept)
        kept = {t: v for t, v in kept.items() if t >= newest - 6 * HOUR}
        want.append((len(kept), min(kept), newest))
    assert sorted(zip(out.n_samples, out.first_us, out.last_us)) == sorted(want)


def test_event_mode_ends_after_four_silent_hours(spark, tmp_path):
    schema = "station_id string, poll long, ts_us long, measurement_type int"
    # The watermark starts at the epoch, so the record begins after it.
    first = [("1", 0, HOUR, 2), ("2", 0, HOUR, 1)]
    later = [("2", 20, 11 * HOUR, 1)]
    out = jobs.run_to_table(jobs.event_mode(feed(spark, tmp_path, schema, first, later), True, "1 hour"), "e").collect()
    assert sorted((r.station_id, r.poll, r.event_mode) for r in out) == [("1", 0, False), ("1", 0, True), ("2", 0, False), ("2", 20, False)]


HEALTH = "source_type string, station_id string, seq long, ts_us long, expected_interval_sec int, is_error boolean"


def health(spark, tmp_path, *batches):
    log = feed(spark, tmp_path, HEALTH, *batches)
    return jobs.run_to_table(jobs.station_health(log.where("NOT is_error"), log.where("is_error"), "0 seconds"), "h")


def test_station_goes_stale_by_the_clock_alone(spark, tmp_path):
    first = [("dart", "1", 1, HOUR, 900, False), ("dart", "2", 2, 2 * HOUR, 900, True)]
    clock = [("clock", "clock", -1, 6 * HOUR, None, False)]
    out = health(spark, tmp_path, first, clock).collect()
    assert sorted((r.station_id, r.at_us, r.status) for r in out) == [("1", HOUR, "ONLINE"), ("1", 3 * HOUR // 2, "STALE"), ("2", 2 * HOUR, "OFFLINE")]


def test_health_changes_equal_the_batch_form_at_every_time(spark, tmp_path):
    rows, minute = [], 60_000_000
    for i in range(60):
        rows.append(("dart", str(i % 3), i, (1 + i * i * 37 % 2000) * minute, 900 if i % 2 else 60, i % 7 == 0))
    rows.sort(key=lambda r: r[3])
    clock = [("clock", "clock", -1, 2500 * minute, None, False)]
    changes = health(spark, tmp_path, rows, clock).where("station_id <> 'clock'").toPandas()
    log = spark.createDataFrame(rows, HEALTH)
    for now in (2 * minute, 333 * minute, 1000 * minute, 1999 * minute, 2400 * minute):
        known = log.where(F.col("ts_us") <= now)
        want = {r.station_id: r.status for r in R.station_health(known.where("NOT is_error"), known.where("is_error"), now).collect()}
        so_far = changes[changes.at_us <= now].sort_values("at_us", kind="stable").groupby("station_id").status.last().to_dict()
        assert so_far == want


def test_guard_counts_late_and_future_rows_across_a_restart(spark, tmp_path):
    """A batch that failed half-way is delivered again and counted once."""
    now = 100 * HOUR
    rows = [("dart", "1", i, t, 0.1) for i, t in enumerate([now, now - 7 * HOUR, now - 6 * HOUR, now + HOUR, now + 1, 0])]
    stream = feed(spark, tmp_path, READING, rows[:3], rows[3:])
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    calls = []

    def clock(batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return now

    with pytest.raises(Exception, match="lost"):
        jobs.guard(stream, folder, checkpoint, clock).awaitTermination()
    jobs.guard(stream, folder, checkpoint, clock).awaitTermination()
    assert calls == [0, 1, 1]
    got = jobs.guarded(spark, folder, stream.schema).toPandas()
    assert isinstance(got, pd.DataFrame) and sorted(zip(got.timing_class, got.seq)) == [("future", 3), ("late", 1), ("late", 5), ("on_time", 0), ("on_time", 2), ("on_time", 4)]


class Held:
    """A state store of one key that counts its accesses."""

    def __init__(self):
        self.value, self.accesses = None, 0

    def getValueState(self, *_):
        return self

    def registerTimer(self, _):
        pass

    def exists(self):
        return self.value is not None

    def get(self):
        self.accesses += 1
        return self.value

    def update(self, value):
        self.accesses += 1
        self.value = value


REVISION = "event_id long, seq long, ts_us long, version string"


def test_earthquakes_of_a_slot_share_one_state(spark, tmp_path):
    day = 86_400_000_000
    rows = [(i * 7 % 41 or None, i, (i * 3 // 4 + i % 5) * day, "abc"[i * i % 3]) for i in range(400)]
    batches = [rows[:150], rows[150:170], rows[170:]]
    out = jobs.run_to_table(jobs.revisions(feed(spark, tmp_path, REVISION, *batches), live=False, slots=2), "rev").collect()
    known, want = {}, []
    for event, seq, ts, version in (r for b in batches for r in sorted(b, key=lambda r: (r[2], r[1]))):
        old, seen = known.get(event, (None, None))
        if seen is not None and ts - seen > 30 * day:
            old = None
        if old != version:
            want.append((event, seq, version, old is not None))
        known[event] = (version, ts)
    order = lambda r: r[1]
    assert sorted(map(tuple, out), key=order) == sorted(want, key=order) and any(r[3] for r in want)


def test_a_batch_of_revisions_costs_one_read_and_one_write_of_state():
    store, processor = Held(), P.Revisions(False)
    processor.init(store)
    for turn in range(2):
        rows = pd.DataFrame([(i, i, turn * HOUR, str(turn)) for i in range(500)], columns=["event_id", "seq", "ts_us", "version"])
        out = pd.concat(processor.handleInputRows((0,), iter([rows]), None))
        assert out["event_id"].tolist() == list(range(500)) and set(out["is_revision"]) == {turn == 1}
    assert store.accesses == 3  # written, read, written


def test_silent_earthquakes_leave_a_live_slot():
    class Clock:
        now = 0

        def getCurrentProcessingTimeInMs(self):
            return self.now

    store, processor, clock = Held(), P.Revisions(True), Clock()
    processor.init(store)
    said = []
    for days, event in ((0, 1), (20, 2), (31, 2)):
        clock.now = days * 86_400_000
        rows = pd.DataFrame([(event, days, HOUR, "a")], columns=["event_id", "seq", "ts_us", "version"])
        said += pd.concat(processor.handleInputRows((0,), iter([rows]), clock))["event_id"].tolist()
    assert said == [1, 2] and list(store.value[0]) == [2]


def test_health_holds_few_bytes_of_a_reading():
    """A station's rows wait as plain numbers; frames with the key's texts took over 100 bytes a row."""
    n, store, processor = 200_000, Held(), P.Health()
    processor.init(store)

    def frames():
        for at in range(0, n, 5_000):
            ts = [(n - at - i) * 60_000_000 for i in range(5_000)]
            yield pd.DataFrame(
                {"source_type": ["dart" + str(at)] * 5_000, "station_id": [str(x) for x in ts], "ts_us": ts, "seq": ts, "cadence_us": 60_000_000, "is_error": [x % 1000 == 0 for x in range(5_000)]}
            )

    tracemalloc.start()
    out = sum(map(len, processor.handleInputRows(("dart", "1"), frames(), None)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out > 300 and store.value[0] == (n - 1) * 60_000_000
    assert peak < 80 * n
