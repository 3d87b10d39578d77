"""Ordered work on series whose keys may be arbitrarily hot.

A window partitioned by station alone puts a whole station in one task. Here a
series is cut into time buckets, each bucket is sorted on its own, and only one
small row per (key, bucket) crosses bucket borders. Buckets are a rule on the
order column, never a sample, so a recomputed task sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKET = "_bucket"
# Rows of one key that a single aggregate buffer may hold.
GATHER_LIMIT = 2_000_000
# Rows of a side that may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side keeps a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def settle(per_key: DataFrame) -> DataFrame:
    """Compute a small table of one row per key once, and broadcast it if it is small.

    Joining it back then leaves the rows of a hot key where they are, instead of
    sending them all to one task; with very many keys the join shuffles.
    """
    return broadcast_if_small(cut_lineage(per_key))


def time_bucket(ts_us: str, seconds: int) -> Column:
    return F.floor(F.col(ts_us) / F.lit(seconds * 1_000_000)).cast("long")


def _carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The last row of each bucket, addressed to the next bucket that has rows."""
    tail_cols = [*order, *[c for c in payload if c not in order]]
    tails = df.groupBy(*keys, BUCKET).agg(F.max(F.struct(*tail_cols)).alias("_tail"))
    by_key = Window.partitionBy(*keys).orderBy(BUCKET)
    return tails.withColumn("_next", F.lead(BUCKET).over(by_key)).where(F.col("_next").isNotNull())


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], bucket: Column
) -> DataFrame:
    """Add struct `prev` of `payload` from the row before in (keys, order)."""
    rows = df.withColumn(BUCKET, bucket)
    carry = _carry(rows, keys, order, payload)
    tail_cols = [*order, *[c for c in payload if c not in order]]
    carried = carry.select(
        *keys, F.col("_next").alias(BUCKET), *[F.col("_tail")[c].alias(c) for c in tail_cols], F.lit(True).alias("_ctx")
    )
    both = rows.withColumn("_ctx", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    # A carried row sorts before every row of its new bucket because its bucket is earlier.
    by_bucket = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    return (
        both.withColumn("prev", F.lag(F.struct(*payload)).over(by_bucket))
        .where(~F.col("_ctx"))
        .drop("_ctx", BUCKET)
    )


def with_next(
    df: DataFrame, keys: Sequence[str], payload: Sequence[str], bucket_seconds: int, ts_us: str = "ts_us", tie: str | None = None
) -> DataFrame:
    """Add struct `next` of `payload` from the row after in (keys, time)."""
    order = ["_back", *(["_back_tie"] if tie else [])]
    turned = df.withColumn("_back", -F.col(ts_us))
    if tie:
        turned = turned.withColumn("_back_tie", -F.col(tie))
    out = with_previous(turned, keys, order, payload, time_bucket("_back", bucket_seconds))
    return out.withColumnRenamed("prev", "next").drop("_back", "_back_tie")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, into: str = "rn", total: str | None = None
) -> DataFrame:
    """Exact 1-based row number in (keys, order); `bucket` must rise with the order."""
    rows = df.withColumn(BUCKET, bucket)
    by_key = Window.partitionBy(*keys).orderBy(BUCKET)
    sizes = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys,
        BUCKET,
        (F.sum("_n").over(by_key) - F.col("_n")).alias("_offset"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    by_bucket = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    return (
        rows.join(offsets, [*keys, BUCKET])
        .withColumn(into, F.row_number().over(by_bucket) + F.col("_offset"))
        .drop(BUCKET, "_offset")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, value: Column, into: str
) -> DataFrame:
    """Inclusive running sum of `value` in (keys, order), one task per bucket."""
    rows = df.withColumn(BUCKET, bucket).withColumn("_v", value)
    by_key = Window.partitionBy(*keys).orderBy(BUCKET)
    sums = rows.groupBy(*keys, BUCKET).agg(F.sum("_v").alias("_s"))
    offsets = sums.select(*keys, BUCKET, (F.sum("_s").over(by_key) - F.col("_s")).alias("_offset"))
    by_bucket = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*keys, BUCKET])
        .withColumn(into, F.sum("_v").over(by_bucket) + F.col("_offset"))
        .drop(BUCKET, "_offset", "_v")
    )


def with_halo(df: DataFrame, rn: str, chunk_rows: int, before: int, after: int) -> DataFrame:
    """Repeat border rows so each chunk of `chunk_rows` row numbers sees its neighbours.

    Adds `chunk` and `own` (true once per input row).
    """
    home = F.floor((F.col(rn) - 1) / F.lit(chunk_rows)).cast("long")
    first = F.floor((F.col(rn) - 1 - F.lit(after)) / F.lit(chunk_rows)).cast("long")
    last = F.floor((F.col(rn) - 1 + F.lit(before)) / F.lit(chunk_rows)).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
        .withColumn("own", F.col("chunk") == F.col("_home"))
        .drop("_home")
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    counted: DataFrame | None = None,
    gather_limit: int = GATHER_LIMIT,
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated percentiles per key, whatever the size of a key.

    The largest key is counted first (on `counted`, a cheaper table with at least
    as many rows per key, where given). Up to `gather_limit` rows Spark's own exact
    aggregate is used; beyond it the values are located in ranks without gathering
    a key in one task. Both give the same numbers.
    """
    if largest_group(df if counted is None else counted, keys) <= gather_limit:
        return df.groupBy(*keys).agg(*[F.percentile(value, p).alias(name) for name, p in probabilities.items()])
    return ranked_percentiles(df, keys, value, probabilities, accuracy)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def ranked_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], accuracy: int = 10_000, zero_based: bool = False
) -> DataFrame:
    """Percentiles by distributed rank selection.

    With `zero_based` the value at rank int(n * p) is taken, without interpolation.

    A bounded sketch proposes cuts around each rank; rows are counted per region
    exactly; only the regions that hold a wanted rank are sorted. The cuts steer
    the cost, never the answer.
    """
    if not keys:
        whole = df.select(F.lit(0).alias("_all"), value)
        return ranked_percentiles(whole, ["_all"], value, probabilities, accuracy).drop("_all")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 4.0 / accuracy
    ps = list(probabilities.values())
    grid = sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-slack, slack)})
    cuts = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", grid, accuracy).alias("_cuts"),
        F.count(F.lit(1)).alias("_n"),
    )
    region = sum((F.when(F.col("_v") > F.col("_cuts")[i], 1).otherwise(0) for i in range(len(grid))), F.lit(0))
    placed = rows.join(settle(cuts), list(keys)).select(*keys, "_v", "_n", region.alias("_region"))
    by_key = Window.partitionBy(*keys).orderBy("_region")
    sizes = placed.groupBy(*keys, "_region", "_n").agg(F.count(F.lit(1)).alias("_m"))
    sizes = sizes.withColumn("_below", F.sum("_m").over(by_key) - F.col("_m"))

    def rank(p: float, up: bool) -> Column:
        if zero_based:
            return F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1).cast("long")
        place = (F.col("_n") - 1) * F.lit(p)
        return (F.ceil(place) if up else F.floor(place)).cast("long")

    holds = [
        (rank(p, up) >= F.col("_below")) & (rank(p, up) < F.col("_below") + F.col("_m")) for p in ps for up in (False, True)
    ]
    wanted = holds[0]
    for h in holds[1:]:
        wanted = wanted | h
    wanted_regions = settle(sizes.where(wanted).select(*keys, "_region", "_below"))
    counted = (
        placed.join(wanted_regions, [*keys, "_region"])
        .groupBy(*keys, "_region", "_below", "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    by_region = Window.partitionBy(*keys, "_region").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.withColumn("_end", F.sum("_c").over(by_region) + F.col("_below"))
    picks = []
    for i, p in enumerate(ps):
        for side, up in (("lo", False), ("hi", True)):
            r = rank(p, up)
            inside = (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}{i}"))
    found = ends.groupBy(*keys, "_n").agg(*picks)
    out = []
    for i, (name, p) in enumerate(probabilities.items()):
        # The same two-weight form as the engine's own percentile, so both paths give equal bits.
        place = (F.col("_n") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)
        mixed = (high - place) * F.col(f"_lo{i}") + (place - low) * F.col(f"_hi{i}")
        out.append(F.when((low == high) | (F.col(f"_lo{i}") == F.col(f"_hi{i}")), F.col(f"_lo{i}")).otherwise(mixed).alias(name))
    return found.select(*keys, *out)
