"""Structured Streaming jobs over any source with the right columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import guard_late_and_future, validate_split
from ..operators.alerts import TRANSITIONS
from ..sources.feeds import decode_envelopes
from ..sources.sinks import append_observations, new_rows, quarantine_rows
from . import processors as P

LATENESS = "6 hours"
# Slots that the earthquakes of a stream are dealt to.
REVISION_SLOTS = 4_096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, or a temporary one on a single machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="tidelattice-stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def keyed(df: DataFrame, keys: list[str], processor, out: T.StructType, time_mode: str = "None") -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", time_mode)


def high_water(rows: DataFrame) -> DataFrame:
    return keyed(rows, ["source_type", "station_id"], P.HighWater(), P.HIGH_WATER_OUT)


def revisions(rows: DataFrame, live: bool = True, slots: int = REVISION_SLOTS) -> DataFrame:
    """Changed versions; `live` adds the wall-clock expiry, which never lets a query end by itself.

    Earthquakes are dealt to slots that share one state; the number of slots stays for the life of a stream.
    """
    dealt = rows.select(
        F.pmod(F.xxhash64("event_id"), F.lit(slots)).alias("slot"), *[F.coalesce(c, F.lit(P.NONE)).alias(c) for c in ("event_id", "seq", "ts_us")], "version"
    )
    return keyed(dealt, ["slot"], P.Revisions(live), P.REVISION_OUT, "ProcessingTime" if live else "None")


def on_clock(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Rows with a watermark on their event time `ts_us`."""
    return rows.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", lateness)


def rolling_windows(rows: DataFrame, live: bool = False, lateness: str = LATENESS) -> DataFrame:
    """State of each station's window after each batch; `live` ends the state of silent stations."""
    if not live:
        return keyed(rows, ["source_type", "station_id"], P.RollingWindow(), P.ROLLING_OUT)
    return keyed(on_clock(rows, lateness), ["source_type", "station_id"], P.RollingWindow(True), P.ROLLING_OUT, "EventTime")


def event_mode(rows: DataFrame, live: bool = False, lateness: str = LATENESS) -> DataFrame:
    """Mode after each poll; `live` ends the mode of silent buoys."""
    if not live:
        return keyed(rows, ["station_id"], P.EventMode(), P.EVENT_MODE_OUT)
    return keyed(on_clock(rows, lateness), ["station_id"], P.EventMode(True), P.EVENT_MODE_OUT, "EventTime")


def station_health(readings: DataFrame, errors: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Health changes from two streams: readings (with `expected_interval_sec`) and poll errors.

    Both meet under the station's key; STALE comes from the clock, without any row.
    """
    columns = ["source_type", "station_id", "ts_us", "seq", "cadence_us", "is_error"]
    good = readings.withColumn("cadence_us", F.col("expected_interval_sec").cast("long") * 1_000_000).withColumn("is_error", F.lit(False))
    bad = errors.withColumn("cadence_us", F.lit(0).cast("long")).withColumn("is_error", F.lit(True))
    both = good.select(*columns).unionByName(bad.select(*columns))
    return keyed(on_clock(both, lateness), ["source_type", "station_id"], P.Health(), P.HEALTH_OUT, "EventTime")


def guard(rows: DataFrame, folder: str, checkpoint: str, now_us: Callable[[int], int], seconds: int | None = None) -> StreamingQuery:
    """Split a stream by timing: on-time rows, and late and future rows as a side output.

    `now_us` gives the clock of a batch. A batch is written once, in its own folder
    with a part per timing class, so a batch that is delivered again replaces itself
    and the side output's counts stay right across restarts.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        marked = guard_late_and_future(batch, now_us(batch_id))
        marked.write.mode("overwrite").partitionBy("timing_class").parquet(f"{folder}/batch={batch_id}")

    writer = rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def guarded(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What `guard` wrote: its rows with `batch` and `timing_class`; filters on these read only their parts."""
    parts = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("timing_class", T.StringType())])
    return spark.read.schema(parts).option("basePath", folder).parquet(folder)


def alerts(log: DataFrame, live: bool = False) -> DataFrame:
    """Transitions of each basin; `live` adds event-time timers that end silent monitoring."""
    if not live:
        return keyed(log, ["basin"], P.AlertMachine(), TRANSITIONS)
    timed = log.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", LATENESS)
    return keyed(timed, ["basin"], P.AlertMachine(timers=True), TRANSITIONS, "EventTime")


def windowed_metrics(events: DataFrame, label: str, ts: str, width: str = "5 minutes") -> DataFrame:
    """Counts per label and event-time window; a window is final once the watermark passes it."""
    return (
        events.withWatermark(ts, LATENESS)
        .groupBy(F.window(ts, width).alias("w"), label)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros(F.col("w.start")).alias("start_us"), label, "n")
    )


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and return what it wrote."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def ingest(
    messages: DataFrame,
    record: T.StructType,
    rules: Callable[[], Mapping[str, Column]],
    table: str,
    quarantine: str,
    checkpoint: str,
    seconds: int | None = 15,
) -> StreamingQuery:
    """Envelopes to the observation log: decode, validate, quarantine, append once.

    `record` needs station_id, ts and payload_hash. A batch that is delivered
    again finds its rows stored and adds none.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_envelopes(batch)
        lost = decoded.where(F.col("status") == "rejected").select(
            "topic", "partition", "offset", F.lit("undecodable message").alias("reason_detail")
        )
        rows = decoded.where(F.col("status") == "ok").select("offset", F.from_json("record", record).alias("r"))
        valid, bad = validate_split(rows.select(F.col("offset").alias("seq"), "r.*"), rules())
        append_observations(valid, table)
        once_per_batch(lost, f"{quarantine}/messages", batch_id, "TRANSPORT")
        once_per_batch(bad, f"{quarantine}/records", batch_id, "VALIDATION")

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def once_per_batch(rows: DataFrame, path: str, batch_id: int, reason_code: str) -> None:
    """Quarantine of one batch in its own folder, so writing it again replaces it."""
    quarantine_rows(rows, reason_code).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def checkpoint_attempts(attempts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Log of processed batches: the first attempt of a checkpoint writes, later ones are redeliveries."""
    first = new_rows(attempts.select("checkpoint_id", "attempt_no"), done, ["checkpoint_id"], "attempt_no")
    marked = attempts.join(first.withColumnRenamed("attempt_no", "first_no"), "checkpoint_id", "left")
    kind = F.when(F.col("first_no") == F.col("attempt_no"), "processed").otherwise("redelivery")
    return marked.withColumn("kind", kind).drop("first_no")
