"""Lineage, audit and policy reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import latest_by
from .partitioned import broadcast_if_small, number_rows, time_bucket

NO_TRACE = "__no_trace__"
DIGEST_BLOCK = 10_000


def attach_qc(samples: DataFrame, reports: DataFrame) -> DataFrame:
    """Per-record quality by payload hash; the last report of a hash wins."""
    newest = latest_by(reports, ["payload_hash"], ["report_no"], ["usable", "confidence"])
    return samples.join(newest, "payload_hash", "left")


def provenance_chain(features: DataFrame, audit: DataFrame, raw: DataFrame, trace_id: Column | None = None) -> DataFrame:
    """Feature to audit to raw input; the newest audit row per (feature, raw row).

    A feature without audit or with unknown hashes keeps a row without raw input.
    A trace filter, where given, reaches the scans of both sides.
    """
    if trace_id is not None:
        features = features.where(F.col("trace_id") == trace_id)
        audit = audit.where(F.col("trace_id") == trace_id)
    noted = features.join(audit, ["handoff_id", "trace_id"], "left")
    hashes = noted.withColumn("payload_hash", F.explode_outer("input_hashes")).drop("input_hashes")
    traced = hashes.join(raw.select("payload_hash", "raw_id", "station_id"), "payload_hash", "left")
    newest = traced.groupBy("feature_id", "raw_id").agg(
        F.max(F.struct("recorded_us", "audit_id", "trace_id", "handoff_id", "station_id")).alias("_b")
    )
    return newest.select("feature_id", "raw_id", "_b.recorded_us", "_b.audit_id", "_b.trace_id", "_b.handoff_id", "_b.station_id")


def query_audit(
    audit: DataFrame, event_id: int | None = None, event_type: str | None = None, trace_id: str | None = None, producer: str | None = None
) -> DataFrame:
    """Conjunction of the filters that are given; all reach the scan."""
    for name, wanted in (("event_id", event_id), ("event_type", event_type), ("trace_id", trace_id), ("producer", producer)):
        if wanted is not None:
            audit = audit.where(F.col(name) == wanted)
    return audit


def audit_page(audit: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return audit.orderBy(F.desc("recorded_us"), F.desc("audit_id")).offset(offset).limit(limit)


def lineage_by_event(audit: DataFrame, bucket: Column) -> DataFrame:
    """All entries of each event, numbered in time order within the event and within its trace, with both sizes.

    Entries without a trace form one group per event; any group may be most of the
    log, so rows are ranked per time bucket first and none is sorted or gathered whole.
    """
    named = audit.withColumn("trace", F.coalesce("trace_id", F.lit(NO_TRACE)))
    whole = number_rows(named, ["event_id"], ["recorded_us", "audit_id"], bucket, "event_position", "total_entries")
    return number_rows(whole, ["event_id", "trace"], ["recorded_us", "audit_id"], bucket, "position", "entry_count")


def activity_report(audit: DataFrame, key: str) -> DataFrame:
    """Counts per entry type and sums out of the JSON payload."""
    amount = F.get_json_object("data", "$.k").cast("long")
    return audit.groupBy(key, "event_type").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum(amount).alias("total_k"), F.count_if(amount >= 50).alias("n_high")
    )


def offset_ranges(messages: DataFrame, batch: str) -> DataFrame:
    return messages.groupBy(batch, "topic", "partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def checkpoint_id(messages: DataFrame, batch: str, consumer_group: str) -> DataFrame:
    """Identity of each consumed batch from its offset ranges and rejected markers.

    Rejected offsets are digested per block of offsets, so the identity covers all
    of them while no row holds more than one block.
    """
    ranges = offset_ranges(messages, batch)
    listed = ranges.groupBy(batch).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("topic", "partition", "first_offset", "last_offset")))).alias("ranges")
    )
    block = F.floor(F.col("offset") / DIGEST_BLOCK).cast("long")
    blocks = messages.where("rejected").groupBy(batch, "topic", "partition", block.alias("block")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("offset")), lambda x: x.cast("string")), ","), 256).alias("digest")
    )
    rejected = blocks.groupBy(batch).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("topic", "partition", "block", "digest")))).alias("rejected")
    )
    joined = listed.join(rejected, batch, "left")
    text = F.concat_ws("|", F.lit(consumer_group), "ranges", F.coalesce("rejected", F.lit("[]")))
    return joined.select(batch, F.sha2(text, 256).alias("checkpoint_id"))


def policy_audit(requests: DataFrame, agents: DataFrame, allowed: DataFrame, gated: Sequence[str], gated_states: Sequence[str]) -> DataFrame:
    """Verdict of each logged request: unknown agent, capability, human approval, else allowed."""
    known = requests.join(broadcast_if_small(agents.select("agent").distinct().withColumn("_known", F.lit(True))), "agent", "left")
    pairs = allowed.select("agent", "capability").distinct().withColumn("_may", F.lit(True))
    judged = known.join(broadcast_if_small(pairs), ["agent", "capability"], "left")
    held = F.col("capability").isin(*gated) & F.col("state").isin(*gated_states) & ~F.col("human_decision")
    return judged.withColumn(
        "verdict",
        F.when(F.col("_known").isNull(), "AGENT_NOT_REGISTERED")
        .when(F.col("_may").isNull(), "CAPABILITY_NOT_ALLOWED")
        .when(held, "HUMAN_APPROVAL_REQUIRED")
        .otherwise("ALLOWED"),
    ).drop("_known", "_may")


def packet_of_record(packets: DataFrame, assessed: DataFrame) -> DataFrame:
    """Packet of the earliest assessment of each event, newest renderer."""
    mine = packets.join(assessed.select("event_id").distinct(), "event_id", "left_semi")
    best = mine.groupBy("event_id").agg(F.min(F.struct("assessment_id", (-F.col("renderer")).alias("r"), "packet_id")).alias("_b"))
    return best.select("event_id", "_b.assessment_id", (-F.col("_b.r")).alias("renderer"), "_b.packet_id")


def event_provenance(bound: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Each input hash once per event, ranked by first use, with the number of hashes of the event."""
    once = bound.groupBy("event_id", "payload_hash").agg(F.min("ts_us").alias("first_us"))
    return number_rows(once, ["event_id"], ["first_us", "payload_hash"], time_bucket("first_us", bucket_seconds), "rank", "n_hashes")


def similar_events(events: DataFrame, history: DataFrame, k: int = 3) -> DataFrame:
    """The k historical events nearest in magnitude; ties go to the earlier position.

    Each distinct magnitude is answered once and joined back. Magnitudes and history
    are sorted together in ranges of the value; a range also sees the 2k rows of history
    before and after it, so no range needs the whole history.
    """
    per_value = Window.partitionBy("value").orderBy("position")
    # Of equal magnitudes only the first k positions can be among the nearest.
    past = history.where("mw is not null").select(F.round("mw", 9).alias("value"), "position", "name").withColumn("_n", F.row_number().over(per_value)).where(F.col("_n") <= k).drop("_n")
    asked = events.select(F.col("magnitude").alias("value"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("name")).where("value is not null").distinct()
    both = past.withColumn("position", F.col("position").cast("long")).unionByName(asked)
    order = ["value", "position"]
    ranges = cut_lineage(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last = pd.DataFrame(), pd.DataFrame()
        for batch in batches:
            rows = batch[batch["position"].notna()]
            first = pd.concat([first, rows]).head(2 * k)
            last = pd.concat([last, rows]).tail(2 * k)
        for side, rows in enumerate((first, last)):
            if len(rows):
                yield rows.assign(side=side).astype({"position": "int64"})

    # At most 4k rows per range.
    ends = ranges.mapInPandas(edges, "value double, position long, name string, part int, side int").toPandas()
    after, before = (ends[ends["side"] == side].sort_values(["part", "value", "position"], kind="stable") for side in (0, 1))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts)
            part = rows["part"].iloc[0]
            around = (before[before["part"] < part].tail(2 * k), rows, after[after["part"] > part].head(2 * k))
            yield _nearest(pd.concat([x[x["position"].notna()] for x in around]), rows[rows["position"].isna()]["value"], k)

    near = ranges.mapInPandas(answer, "value double, rank int, name string, difference double")
    return events.select("event_id", F.col("magnitude").alias("value")).join(broadcast_if_small(near), "value").drop("value")


def _nearest(past: pd.DataFrame, asked: pd.Series, k: int) -> pd.DataFrame:
    """The k nearest rows of `past` (in order of value and position) of each asked value."""
    values, positions, names = past["value"].to_numpy(float), past["position"].to_numpy(float), past["name"].to_numpy()
    out = []
    for value in asked:
        at = int(np.searchsorted(values, value))
        near = np.arange(max(0, at - 2 * k), min(len(values), at + 2 * k))
        off = np.round(np.abs(values[near] - value), 9)
        out += [(value, r, names[near[i]], off[i]) for r, i in enumerate(np.lexsort((positions[near], off))[:k])]
    return pd.DataFrame(out, columns=["value", "rank", "name", "difference"])

