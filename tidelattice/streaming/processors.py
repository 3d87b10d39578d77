"""Keyed state of the live feeds. Each processor has a batch twin that gives the same rows on closed input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import TRANSITIONS, Machine
from ..schemas import WINDOW_HOURS

EVENT_MODE_HOURS = 4
REVISION_DAYS = 30
DAY_US = 86_400_000_000
# Stands for a null whole number among the rows of a slot; sorts last.
NONE = (1 << 63) - 1


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Rows of a key that are Python objects at once.
ROWS_AT_ONCE = 16_384


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = [p for p in rows if len(p)]
    return pd.concat(parts).sort_values(by) if parts else pd.DataFrame()


def _slim_in_order(rows: Iterator[pd.DataFrame], by: list[str], columns: list[str]) -> pd.DataFrame:
    """The named columns of a key's rows in order: plain arrays, so a row takes a few bytes a column."""
    held: dict[str, list[np.ndarray]] = {c: [] for c in columns}
    for part in rows:
        for c in columns:
            held[c].append(part[c].to_numpy(copy=True))
    whole = {c: np.concatenate(parts) for c in columns if (parts := held.pop(c))}
    if not whole:
        return pd.DataFrame(columns=columns)
    order = np.lexsort([whole[c] for c in reversed(by)])
    return pd.DataFrame({c: whole.pop(c)[order] for c in columns}, copy=False)


def _slices(data: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (data.iloc[at : at + ROWS_AT_ONCE] for at in range(0, len(data), ROWS_AT_ONCE))


HIGH_WATER_OUT = _schema(source_type=T.StringType(), station_id=T.StringType(), seq=T.LongType(), ts_us=T.LongType(), value_m=T.DoubleType())


class HighWater(StatefulProcessor):
    """Rows newer than the station's mark; a gauge may repeat the mark's minute to revise it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", _schema(ts_us=T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = _slim_in_order(rows, ["seq"], ["seq", "ts_us", "value_m"])
        if data.empty:
            return
        mark = self.mark.get()[0] if self.mark.exists() else None
        before = data["ts_us"].cummax().shift()
        if mark is not None:
            before = before.fillna(mark).clip(lower=mark)
        newer = before.isna() | (data["ts_us"] > before) | ((key[0] == "coops") & (data["ts_us"] == before))
        top = int(data["ts_us"].max())
        self.mark.update((top if mark is None else max(mark, top),))
        for part in _slices(data[newer]):
            yield part.assign(source_type=key[0], station_id=key[1])[HIGH_WATER_OUT.names]

    def close(self) -> None:
        pass


REVISION_OUT = _schema(event_id=T.LongType(), seq=T.LongType(), version=T.StringType(), is_revision=T.BooleanType())


class Revisions(StatefulProcessor):
    """An earthquake passes when its version changes; forgotten after thirty days without a message.

    A key is a slot of earthquakes (`jobs.revisions`): a batch reads and writes the state of
    a slot once, not once for each earthquake. With `expire` the store also drops silent
    earthquakes by wall clock, at the slot's next message at the latest, and whole silent
    slots. That keeps a query alive without input, so a replay of closed input leaves it off.
    """

    def __init__(self, expire: bool) -> None:
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        longs, texts = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
        schema = _schema(event_ids=longs, versions=texts, seen_us=longs, heard_ms=longs)
        ttl = REVISION_DAYS * DAY_US // 1000 if self.expire else None
        self.known = handle.getValueState("known", schema, ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.expire else 0
        known: dict[int | None, tuple[str | None, int | None, int]] = {}
        if self.known.exists():
            for event, *held in zip(*self.known.get(), strict=True):
                if now - held[2] < REVISION_DAYS * DAY_US // 1000:
                    known[event] = tuple(held)
        data = _slim_in_order(rows, ["ts_us", "seq"], ["event_id", "seq", "ts_us", "version"])
        for part in _slices(data):
            out = []
            for numbers, new in zip(part[["event_id", "seq", "ts_us"]].to_numpy().tolist(), part["version"].tolist(), strict=True):
                event, seq, ts = (None if x == NONE else x for x in numbers)
                version, seen, _ = known.get(event, (None, None, 0))
                if seen is None or (ts is not None and ts - seen > REVISION_DAYS * DAY_US):
                    version = None
                if new != version:
                    out.append((event, seq, new, version is not None and ts is not None))
                known[event] = (new, ts, now)
            yield pd.DataFrame(out, columns=REVISION_OUT.names).astype({"event_id": "Int64", "seq": "Int64"})
        if known:
            self.known.update(([*known], *([held[i] for held in known.values()] for i in range(3))))

    def close(self) -> None:
        pass


ROLLING_OUT = _schema(
    source_type=T.StringType(), station_id=T.StringType(), n_samples=T.LongType(), first_us=T.LongType(), last_us=T.LongType()
)
WINDOW_US = WINDOW_HOURS * 3_600_000_000
SLOT_US = 900_000_000


class RollingWindow(StatefulProcessor):
    """The last six hours of a station, one sample per instant, first accepted wins.

    Samples are held in slots of 15 minutes; a batch reads and writes only the slots it
    touches and the one the window's start falls into. A small index counts the slots.
    With `timers` the state of a silent station ends when the watermark passes six
    hours after its newest sample; a row with no samples says so.
    """

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
        self.slots = handle.getMapState("slots", _schema(slot=T.LongType()), _schema(times=longs, values=doubles))
        self.index = handle.getValueState("index", _schema(newest_us=T.LongType(), slots=longs, sizes=longs))

    def _load(self, slot: int) -> dict[int, float]:
        if not self.slots.containsKey((slot,)):
            return {}
        times, values = self.slots.getValue((slot,))
        return dict(zip(times, values, strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, sizes = None, {}
        if self.index.exists():
            newest, slots, counts = self.index.get()
            sizes = dict(zip(slots, counts, strict=True))
        touched: dict[int, dict[int, float]] = {}
        data = _slim_in_order(rows, ["seq"], ["seq", "ts_us", "value_m"])
        newest = max(int(data["ts_us"].max()), newest or 0) if len(data) else newest
        for part in _slices(data):
            for ts, value in zip(part["ts_us"].tolist(), part["value_m"].tolist(), strict=True):
                slot = ts // SLOT_US
                if ts >= newest - WINDOW_US:
                    if slot not in touched:
                        touched[slot] = self._load(slot)
                    touched[slot].setdefault(ts, value)
        if newest is None:
            return
        start = newest - WINDOW_US
        edge = start // SLOT_US
        if edge in sizes and edge not in touched:
            touched[edge] = self._load(edge)
        for slot in [x for x in {*sizes, *touched} if x < edge]:
            touched.pop(slot, None)
            if sizes.pop(slot, None) is not None:
                self.slots.removeKey((slot,))
        for slot, held in touched.items():
            kept = {t: v for t, v in held.items() if t >= start}
            if kept:
                sizes[slot] = len(kept)
                self.slots.updateValue((slot,), (list(kept), list(kept.values())))
            elif sizes.pop(slot, None) is not None:
                self.slots.removeKey((slot,))
        order = sorted(sizes)
        self.index.update((newest, order, [sizes[x] for x in order]))
        first = min(touched[order[0]] if order[0] in touched else self._load(order[0]), key=lambda t: (t < start, t))
        if self.timers:
            self.handle.registerTimer((newest + WINDOW_US) // 1000 + 1)
        yield pd.DataFrame([(*key, sum(sizes.values()), first, newest)], columns=ROLLING_OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.index.exists():
            return
        newest, slots, _ = self.index.get()
        if (newest + WINDOW_US) // 1000 + 1 > expiredTimerInfo.getExpiryTimeInMs():
            return  # newer samples came after this timer was set
        for slot in slots:
            self.slots.removeKey((slot,))
        self.index.clear()
        yield pd.DataFrame([(*key, 0, None, newest)], columns=ROLLING_OUT.names).astype({"first_us": "Int64"})

    def close(self) -> None:
        pass


EVENT_MODE_OUT = _schema(station_id=T.StringType(), poll=T.LongType(), event_mode=T.BooleanType())
EVENT_MODE_US = EVENT_MODE_HOURS * 3_600_000_000


class EventMode(StatefulProcessor):
    """A buoy is in event mode after recent type 2 or 3 rows, until an all-type-1 poll or four silent hours.

    With `timers` the mode also ends when the watermark passes the four hours and the
    buoy stays silent; that row has the last poll's number.
    """

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.observed = handle.getValueState("observed", _schema(ts_us=T.LongType(), poll=T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        observed = self.observed.get()[0] if self.observed.exists() else None
        polls: dict[int, list[int | bool]] = {}
        # A poll folds to its newest row, newest marked row and whether all rows are standard.
        for part in rows:
            marked = part["measurement_type"].isin([2, 3])
            folded = part.assign(mark=part["ts_us"].where(marked, -1), standard=part["measurement_type"].eq(1)).groupby("poll").agg(
                now=("ts_us", "max"), mark=("mark", "max"), standard=("standard", "all")
            )
            for poll, now, mark, standard in folded.itertuples():
                known = polls.setdefault(int(poll), [-1, -1, True])
                known[:] = [max(known[0], int(now)), max(known[1], int(mark)), known[2] and bool(standard)]
        out = []
        for poll in sorted(polls):
            now, mark, standard = polls[poll]
            if mark >= 0 and now - mark < EVENT_MODE_US:
                observed = mark
            elif standard:
                observed = None
            if observed is not None and now - observed >= EVENT_MODE_US:
                observed = None
            out.append((key[0], poll, observed is not None))
        if observed is None:
            self.observed.clear()
        elif out:
            self.observed.update((observed, out[-1][1]))
            if self.timers:
                self.handle.registerTimer((observed + EVENT_MODE_US) // 1000 + 1)
        yield pd.DataFrame(out, columns=EVENT_MODE_OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.observed.exists():
            return
        observed, poll = self.observed.get()
        if (observed + EVENT_MODE_US) // 1000 + 1 > expiredTimerInfo.getExpiryTimeInMs():
            return
        self.observed.clear()
        yield pd.DataFrame([(key[0], poll, False)], columns=EVENT_MODE_OUT.names)

    def close(self) -> None:
        pass


HEALTH_OUT = _schema(
    source_type=T.StringType(), station_id=T.StringType(), at_us=T.LongType(), status=T.StringType(), last_us=T.LongType(), error_us=T.LongType()
)


class Health(StatefulProcessor):
    """Changes of a station's health from readings and poll errors under one key.

    An error newer than the newest reading makes it OFFLINE, two cadences without a
    reading STALE, a reading ONLINE. A timer at two cadences emits STALE when only the
    clock moves. Rows with neither a cadence nor an error move the clock alone.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState(
            "health", _schema(last_us=T.LongType(), seq=T.LongType(), cadence_us=T.LongType(), error_us=T.LongType(), status=T.StringType())
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.held.get()) if self.held.exists() else [-1, -1, 0, -1, ""]
        for part in _slices(_slim_in_order(rows, ["ts_us", "seq"], ["ts_us", "seq", "cadence_us", "is_error"])):
            out: list[tuple] = []
            for ts, seq, cadence, error in zip(*(part[c].tolist() for c in ("ts_us", "seq", "cadence_us", "is_error")), strict=True):
                if not error and not cadence > 0:
                    continue
                self._go_stale(key, state, ts, out)
                if error:
                    state[3] = max(state[3], ts)
                elif (ts, seq) > (state[0], state[1]):
                    state[:3] = [ts, seq, int(cadence)]
                self._say(key, state, ts, "OFFLINE" if state[3] > state[0] else "ONLINE", out)
            yield self._frame(out)
        self._keep(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = list(self.held.get()), []
        self._go_stale(key, state, expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        self._keep(state, again=False)
        yield self._frame(out)

    def _go_stale(self, key, state: list, now_us: int, out: list) -> None:
        due = state[0] + 2 * state[2]
        if state[4] == "ONLINE" and due <= now_us:
            self._say(key, state, due, "STALE", out)

    def _say(self, key, state: list, at_us: int, status: str, out: list) -> None:
        # A late row may leave a station as stale as it was.
        if status == "ONLINE" and state[4] == "STALE" and state[0] + 2 * state[2] <= at_us:
            return
        if status != state[4]:
            state[4] = status
            out.append((*key, int(at_us), status, *(None if x < 0 else int(x) for x in (state[0], state[3]))))

    def _keep(self, state: list, again: bool = True) -> None:
        if state[4]:
            self.held.update(tuple(state))
            if again and state[4] == "ONLINE":
                self.handle.registerTimer(-(-(state[0] + 2 * state[2]) // 1000))

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=HEALTH_OUT.names).astype({"last_us": "Int64", "error_us": "Int64"})

    def close(self) -> None:
        pass


class AlertMachine(StatefulProcessor):
    """The alert machine of one basin over the live log.

    With `timers` a monitored event also ends when the watermark passes its limit and
    the basin stays silent; a replay of closed input leaves that to the next row.
    """

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState(
            "machine",
            _schema(
                state=T.StringType(), event_id=T.LongType(), magnitude=T.DoubleType(), trigger_us=T.LongType(),
                confirmed=T.BooleanType(), score=T.DoubleType(), step=T.LongType(),
            ),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = Machine(*self.held.get()) if self.held.exists() else Machine()
        out = []
        for row in _in_order(rows, ["tick", "rank", "ts_us", "event_id"]).itertuples(index=False):
            out += [(key[0], *moved) for moved in machine.apply(row)]
        self._keep(machine)
        if self.timers and machine.state == "MONITOR":
            self.handle.registerTimer(machine.over_us() // 1000)
        yield pd.DataFrame(out, columns=TRANSITIONS.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = Machine(*self.held.get()) if self.held.exists() else Machine()
        out = [(key[0], *moved) for moved in machine.expire_before(expiredTimerInfo.getExpiryTimeInMs() * 1000)]
        self._keep(machine)
        yield pd.DataFrame(out, columns=TRANSITIONS.names)

    def _keep(self, machine: Machine) -> None:
        self.held.update(
            (machine.state, machine.event_id, machine.magnitude, machine.trigger_us, bool(machine.confirmed), float(machine.score), machine.step)
        )

    def close(self) -> None:
        pass
