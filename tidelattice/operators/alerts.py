"""The five-state alert machine over a replayed log, one machine per basin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import (
    ESCALATION_DEPTH_KM,
    ESCALATION_MAGNITUDE,
    MONITOR_TIMEOUT_HOURS,
    T1,
    T2,
    T3,
    TRIGGER_MAGNITUDE,
)

TICK_US = 60_000_000
# Order of a tick's rows: triggers, then the score, then decisions.
TRIGGER, SCORE, RESOLUTION = 0, 1, 2
UP = {"MONITOR": "INVESTIGATE", "INVESTIGATE": "ASSESS", "ASSESS": "ESCALATE"}
DOWN = {"INVESTIGATE": "MONITOR", "ASSESS": "INVESTIGATE"}
RISE_AT = {"MONITOR": T1, "INVESTIGATE": T2, "ASSESS": T3}
FALL_BELOW = {"INVESTIGATE": T1, "ASSESS": T2}

TRANSITIONS = T.StructType(
    [
        T.StructField("basin", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("from_state", T.StringType()),
        T.StructField("to_state", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ]
)

INPUT = T.StructType(
    [
        T.StructField("basin", T.LongType()),
        T.StructField("tick", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("magnitude", T.DoubleType()),
        T.StructField("depth_km", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("event_mode_us", T.LongType()),
    ]
)


@dataclass
class Machine:
    """State of one basin; small enough to live in a state store row."""

    state: str = "IDLE"
    event_id: int = -1
    magnitude: float = 0.0
    trigger_us: int = 0
    confirmed: bool = False
    score: float = 0.0
    step: int = 0

    def apply(self, row) -> list[tuple]:
        """Transitions one log row causes, in order.

        A limit that passed in an earlier tick has ended the event by now. In the tick
        of the limit itself the tick's evidence counts first.
        """
        out = self.expire_before(row.tick * TICK_US)
        if row.rank == TRIGGER:
            return out + self._trigger(row)
        if row.rank == RESOLUTION:
            return out + self._resolve(row.ts_us)
        if self.state == "IDLE":
            return out
        # Event-mode evidence older than the origin is not this event's evidence.
        self.confirmed |= pd.notna(row.event_mode_us) and row.event_mode_us >= self.trigger_us
        self.score = row.score
        out += self._evaluate(row.ts_us)
        return out + (self._expire(row.ts_us) if row.ts_us >= self.deadline_us() else [])

    def _move(self, ts_us: int, to: str, score: float | None, reason: str) -> tuple:
        moved = (self.step, int(ts_us), int(self.event_id), self.state, to, score, reason)
        self.step += 1
        self.state = to
        return moved

    def deadline_us(self) -> int:
        """When monitoring without evidence ends."""
        return self.trigger_us + MONITOR_TIMEOUT_HOURS * 3_600_000_000

    def expire_before(self, ts_us: int) -> list[tuple]:
        """End a monitored event whose limit is in a tick that is over at `ts_us`."""
        return self._expire(self.deadline_us()) if self.over_us() <= ts_us else []

    def over_us(self) -> int:
        """When the tick of the limit is over."""
        return (self.deadline_us() // TICK_US + 1) * TICK_US

    def _expire(self, ts_us: int) -> list[tuple]:
        if self.state != "MONITOR" or self.score >= T1:
            return []
        return [self._end(ts_us, self.score, "monitor timeout")]

    def _resolve(self, ts_us: int) -> list[tuple]:
        """Only an explicit decision ends an escalation."""
        return [self._end(ts_us, None, "resolved")] if self.state == "ESCALATE" else []

    def _end(self, ts_us: int, score: float | None, reason: str) -> tuple:
        done = self._move(ts_us, "IDLE", score, reason)
        self.event_id, self.magnitude, self.confirmed, self.score = -1, 0.0, False, 0.0
        return done

    def _trigger(self, row) -> list[tuple]:
        if self.state != "IDLE":
            return []
        self.event_id, self.magnitude, self.trigger_us = int(row.event_id), float(row.magnitude), int(row.ts_us)
        self.confirmed, self.score = False, 0.0
        out = [self._move(row.ts_us, "MONITOR", None, "seismic trigger")]
        if row.magnitude >= ESCALATION_MAGNITUDE and pd.notna(row.depth_km) and row.depth_km < ESCALATION_DEPTH_KM:
            out.append(self._move(row.ts_us, "ESCALATE", None, "seismic-only escalation"))
        return out

    def _evaluate(self, ts_us: int) -> list[tuple]:
        if self.state not in UP:
            return []
        override = self.magnitude >= ESCALATION_MAGNITUDE and self.confirmed
        if self.score >= RISE_AT[self.state]:
            return [self._move(ts_us, UP[self.state], self.score, "score reached threshold")]
        if override:
            return [self._move(ts_us, UP[self.state], self.score, "seismic override")]
        if self.state in DOWN and self.score < FALL_BELOW[self.state]:
            return [self._move(ts_us, DOWN[self.state], self.score, "score fell below threshold")]
        return []


def machine_input(scores: DataFrame, quakes: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Log rows for the machine: admissible triggers, one best score per basin and tick, and decisions.

    Folding a tick to its best score happens map-side, so a basin is bounded by
    its number of ticks, whatever the number of stations and readings behind it.
    """
    valid = scores.where(F.col("score").between(0.0, 1.0) & ~F.isnan("score"))
    ticks = valid.groupBy("basin", F.floor(F.col("ts_us") / TICK_US).cast("long").alias("tick")).agg(
        F.max("ts_us").alias("ts_us"), F.max("score").alias("score"), F.max(F.when(F.col("event_mode"), F.col("ts_us"))).alias("event_mode_us")
    )
    triggers = quakes.where((F.col("magnitude") >= TRIGGER_MAGNITUDE) & (F.col("zone") != "unknown")).select(
        "basin",
        F.floor(F.col("origin_us") / TICK_US).cast("long").alias("tick"),
        F.lit(TRIGGER).alias("rank"),
        F.col("origin_us").alias("ts_us"),
        "event_id",
        "magnitude",
        "depth_km",
    )
    both = triggers.unionByName(ticks.withColumn("rank", F.lit(SCORE)), allowMissingColumns=True)
    if resolutions is not None:
        decided = resolutions.select("basin", "ts_us", F.lit(RESOLUTION).alias("rank"), F.floor(F.col("ts_us") / TICK_US).cast("long").alias("tick"))
        both = both.unionByName(decided, allowMissingColumns=True)
    return both.select(*[F.col(f.name).cast(f.dataType) for f in INPUT.fields])


def replay(log: DataFrame) -> DataFrame:
    """Run each basin's machine over its log in order; one transition per row.

    The log is dealt by basin and sorted on disk where need be; a task streams over it
    and holds one batch of rows and one small machine, however long a basin's log is.
    """
    order = ["basin", "tick", "rank", "ts_us", "event_id"]
    dealt = log.select(*INPUT.names).repartition("basin").sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, basin = Machine(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.basin != basin:
                    machine, basin = Machine(), row.basin
                out += [(row.basin, *moved) for moved in machine.apply(row)]
            if out:
                yield pd.DataFrame(out, columns=TRANSITIONS.names)

    return dealt.mapInPandas(run, TRANSITIONS)


def confirmation_timeline(bound: DataFrame) -> DataFrame:
    """When each station first confirmed an event, and how many had by then.

    The latch is true from the first row on; the station set only grows.
    """
    first = bound.where(F.col("event_mode") & F.col("event_id").isNotNull()).groupBy("event_id", "station_id").agg(
        F.min("ts_us").alias("confirmed_us")
    )
    along = Window.partitionBy("event_id").orderBy("confirmed_us", "station_id")
    return first.withColumn("n_stations", F.row_number().over(along))


def escalations(transitions: DataFrame, scores: DataFrame, refs: DataFrame) -> DataFrame:
    """Packets: each step into ESCALATE with the event's timeline, best station and number of input references."""
    steps = transitions.groupBy("basin", "event_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "from_state", "to_state", "ts_us"))).alias("timeline"),
        F.min(F.when(F.col("to_state") == "ESCALATE", F.col("ts_us"))).alias("escalated_us"),
    ).where(F.col("escalated_us").isNotNull())
    tick = F.floor(F.col("escalated_us") / TICK_US).cast("long")
    best = scores.groupBy("basin", F.floor(F.col("ts_us") / TICK_US).cast("long").alias("tick")).agg(best_station().alias("best"))
    counted = escalation_refs(refs).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_refs"))
    out = steps.withColumn("tick", tick).join(best, ["basin", "tick"], "left").join(counted, "event_id", "left")
    packet = F.to_json(F.struct("event_id", "escalated_us", "timeline"))
    return out.withColumn("packet_hash", F.sha2(packet, 256)).drop("tick")


def escalation_refs(refs: DataFrame) -> DataFrame:
    """All input references of the packets, one row per event and hash, seismic sources first."""
    return refs.groupBy("event_id", "payload_hash").agg(F.min("source_rank").alias("source_rank"))


def best_station() -> Column:
    """Aggregate: the highest score; ties go to the first source and station in order."""
    return F.min(F.struct((-F.col("score")).alias("neg_score"), F.col("source_type"), F.col("station_id")))
