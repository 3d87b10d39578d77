"""URL filters with dated lists: validity intervals and an as-of join.

A list is a log of changes (entry, day, action). Changes become intervals in which an
entry is valid. A capture is evaluated against the entries valid on its fetch day: its
candidate entries are the suffixes of its host and the prefixes of its path, and for
each candidate the last interval that began by that day decides.

Captures meet intervals as distinct (entry, day) pairs, so an entry has at most two
rows per calendar day in the as-of step, however many captures a hot host has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", "")


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")


def candidates(host: Column, segments: Column) -> Column:
    """Entries that can match: host suffixes of two labels or more, host and path prefixes."""
    labels = F.split(host, r"\.")
    empty = F.array().cast("array<string>")
    suffixes = F.when(
        F.size(labels) > 1,
        F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(empty)
    prefixes = F.when(
        (F.size(segments) > 0) & (host != ""),
        F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))),
    ).otherwise(empty)
    return F.concat(suffixes, prefixes)


def validity(changes: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to) from changes (entry, day, action 'add' or 'remove').

    Repeated changes count once; of an add and a remove on one day the remove wins; a
    second add or remove in a row changes nothing; an interval without an end has a null
    valid_to. Rows with a null are left out.
    """
    daily = changes.where("entry is not null and day is not null and action in ('add', 'remove')").groupBy("entry", "day").agg(
        F.max("action").alias("action")  # remove is the larger text
    )
    by_entry = Window.partitionBy("entry").orderBy("day")
    turns = daily.withColumn("_before", F.coalesce(F.lag("action").over(by_entry), F.lit("remove"))).where("action != _before")
    ends = turns.withColumn("valid_to", F.lead("day").over(by_entry))
    return ends.where("action = 'add'").select("entry", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, changes: DataFrame, capture_id: str = "page_id", url: str = "url", day: str = "day") -> DataFrame:
    """(capture_id, day, blocked, n_matches, entry, valid_from): one row per capture.

    `entry` is the longest valid entry (ties: the smallest), with the start of its
    interval. A null or malformed URL and a null day match nothing. Repeated captures
    are repeated in the result; a null id stays null. Extra columns are ignored; an
    empty list blocks nothing.
    """
    rows = captures.select(
        F.col(capture_id).alias("capture_id"), F.col(day).alias("day"), F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.coalesce(F.array_join(segments_of(F.col(url)), "/"), F.lit("")).alias("path"),
    )
    asked = rows.where("day is not null and host != ''").select("day", "host", "path").distinct()
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    keyed = asked.select("day", "host", "path", F.explode(candidates(F.col("host"), parts)).alias("entry"))
    starts = validity(changes).select("entry", F.col("valid_from").alias("day"), F.struct("valid_from", "valid_to").alias("interval"))
    pairs = keyed.select("entry", "day").distinct().withColumn("interval", F.lit(None).cast(starts.schema["interval"].dataType))
    upto = Window.partitionBy("entry").orderBy("day", F.col("interval").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asof = starts.unionByName(pairs).withColumn("last", F.last("interval", ignorenulls=True).over(upto)).where("interval is null")
    valid = asof.where((F.col("day") < F.col("last.valid_to")) | (F.col("last").isNotNull() & F.col("last.valid_to").isNull()))
    hits = (
        keyed.join(valid.select("entry", "day", F.col("last.valid_from").alias("valid_from")), ["entry", "day"])
        .groupBy("day", "host", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.length("entry")).alias("l"), "entry", "valid_from")).alias("m"))
    )
    return rows.join(hits, ["day", "host", "path"], "left").select(
        F.col("capture_id").alias(capture_id), "day", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"),
        F.col("m.entry").alias("entry"), F.col("m.valid_from").alias("valid_from"),
    )
