"""Source inversion from summed moments: no waveform passes through one task.

Waveforms reduce to one block of products per (event, station). Solving,
resampling and dropping sources all work on sums of those blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import strike_consensus
from .partitioned import exact_percentiles

ACTIVE_ABOVE = 1e-10
SHIFT_CONCERN = 0.30
# What `select_sources` needs to know of a source.
FAULT = ("zone", "segment", "strike")


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def gram_blocks(greens: DataFrame, waveforms: DataFrame, sources: Sequence[int]) -> DataFrame:
    """Per (event, station): sums of h_i h_j, h_i d and d^2 over time, and the sample count.

    `greens` (station_id, t, source_id, h) turns into one row of k responses per
    (station, t), so products need no self-join.
    """
    responses = greens.groupBy("station_id", "t").agg(
        *[F.sum(F.when(F.col("source_id") == s, F.col("h"))).alias(f"h{i}") for i, s in enumerate(sources)]
    )
    rows = waveforms.join(responses, ["station_id", "t"])
    k = len(sources)
    h = [F.coalesce(f"h{i}", F.lit(0.0)) for i in range(k)]
    sums = [F.sum(h[i] * h[j]).alias(f"_g{n}") for n, (i, j) in enumerate(pairs(k))]
    sums += [F.sum(h[i] * F.col("d")).alias(f"_r{i}") for i in range(k)]
    out = rows.groupBy("event_id", "station_id").agg(*sums, F.sum(F.col("d") * F.col("d")).alias("dd"), F.count(F.lit(1)).alias("n"))
    gram = F.array(*[F.col(f"_g{n}") for n in range(len(pairs(k)))])
    rhs = F.array(*[F.col(f"_r{i}") for i in range(k)])
    return out.select("event_id", "station_id", gram.alias("gram"), rhs.alias("rhs"), "dd", "n")


def sum_blocks(blocks: DataFrame, keys: Sequence[str], k: int, times: Column | None = None) -> DataFrame:
    """Sum blocks per key, each taken `times` times."""
    times = F.lit(1) if times is None else times
    size = len(pairs(k))
    out = blocks.groupBy(*keys).agg(
        *[F.sum(F.col("gram")[n] * times).alias(f"_g{n}") for n in range(size)],
        *[F.sum(F.col("rhs")[i] * times).alias(f"_r{i}") for i in range(k)],
        F.sum(F.col("dd") * times).alias("dd"),
        F.sum(F.col("n") * times).alias("n"),
        F.count_distinct("station_id").alias("n_stations"),
    )
    gram = F.array(*[F.col(f"_g{n}") for n in range(size)])
    rhs = F.array(*[F.col(f"_r{i}") for i in range(k)])
    return out.select(*keys, gram.alias("gram"), rhs.alias("rhs"), "dd", "n", "n_stations")


def full_gram(packed: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = packed
    return out + np.triu(out, 1).T


def nonnegative_weights(gram: np.ndarray, rhs: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Active-set non-negative least squares of one small system given by its moments."""
    k = len(rhs)
    weights, free = np.zeros(k), np.zeros(k, dtype=bool)
    slack = 1e-12 * max(1.0, float(np.max(np.abs(rhs), initial=0.0)))
    for _ in range(rounds):
        pull = rhs - gram @ weights
        pull[free] = -np.inf
        if pull.max(initial=-np.inf) <= slack:
            break
        free[int(np.argmax(pull))] = True
        while free.any():
            trial = np.zeros(k)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], rhs[free], rcond=None)[0]
            if trial[free].min() > 0:
                weights = trial
                break
            # Walk towards the trial until the first weight reaches zero, and fix that one.
            down = free & (trial <= 0)
            reach = weights[down] / np.maximum(weights[down] - trial[down], 1e-300)
            weights = weights + reach.min() * (trial - weights)
            free &= weights > 1e-15
            weights[~free] = 0.0
    return weights


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solved_weights(gram: pd.Series, rhs: pd.Series, dropped: pd.Series) -> pd.Series:
    """Weights of each row's system, with the source `dropped` left out (-1 for none)."""
    out = []
    for g, r, skip in zip(gram, rhs, dropped):
        rhs_all = np.asarray(r)
        system = full_gram(np.asarray(g), len(rhs_all))
        keep = np.arange(len(rhs_all)) != skip
        weights = np.zeros(len(rhs_all))
        weights[keep] = nonnegative_weights(system[np.ix_(keep, keep)], rhs_all[keep])
        out.append(weights)
    return pd.Series(out)


def quadratic_misfit(gram: Column, rhs: Column, dd: Column, weights: Column, k: int) -> Column:
    """Squared residual norm w'Gw - 2 w'r + d'd, never below zero."""
    terms = [weights[i] * weights[j] * gram[n] * (1.0 if i == j else 2.0) for n, (i, j) in enumerate(pairs(k))]
    terms += [weights[i] * rhs[i] * -2.0 for i in range(k)]
    return F.greatest(F.lit(0.0), sum(terms, dd))


def moment_magnitude(weights: Column, areas_m2: Sequence[float], rigidities_pa: Sequence[float]) -> Column:
    moment = sum((weights[i] * (a * r) for i, (a, r) in enumerate(zip(areas_m2, rigidities_pa))), F.lit(0.0))
    return F.when(moment > 0, F.greatest(F.lit(0.0), F.lit(2.0 / 3.0) * (F.log10(moment) - 9.1))).otherwise(0.0)


def invert_sources(blocks: DataFrame, k: int, areas: Sequence[float], rigidities: Sequence[float]) -> DataFrame:
    """Best non-negative weights per event, with misfit, RMSE in cm and magnitude."""
    total = sum_blocks(blocks, ["event_id"], k)
    fitted = total.withColumn("weights", solved_weights("gram", "rhs", F.lit(-1)))
    norm = F.sqrt(quadratic_misfit(F.col("gram"), F.col("rhs"), F.col("dd"), F.col("weights"), k))
    return fitted.withColumn("residual_norm", norm).select(
        "event_id",
        "n_stations",
        "weights",
        "residual_norm",
        (F.col("residual_norm") / F.sqrt("n") * 100).alias("rmse_cm"),
        moment_magnitude(F.col("weights"), areas, rigidities).alias("mw"),
    )


def bootstrap_inversion(blocks: DataFrame, k: int, iterations: int = 500, seed: int = 42) -> DataFrame:
    """Weights of resampled station sets, one row per (event, iteration).

    A draw is a hash of (seed, event, iteration, slot), so it does not depend on
    partitioning; resampling only changes how often a block counts.
    """
    by_event = Window.partitionBy("event_id")
    indexed = blocks.withColumn("slot", F.row_number().over(by_event.orderBy("station_id")) - 1).withColumn(
        "n_slots", F.count(F.lit(1)).over(by_event)
    ).where(F.col("n_slots") >= 2)
    sizes = indexed.groupBy("event_id").agg(F.max("n_slots").alias("n_slots"))
    draws = (
        sizes.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1)))
        .withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "event_id", "iteration", "draw"), F.col("n_slots")).cast("int"))
        .groupBy("event_id", "iteration", "slot")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    taken = draws.join(indexed.drop("n_slots"), ["event_id", "slot"])
    sums = sum_blocks(taken, ["event_id", "iteration"], k, F.col("times"))
    return sums.select("event_id", "iteration", solved_weights("gram", "rhs", F.lit(-1)).alias("weights"))


def leave_one_out(blocks: DataFrame, k: int) -> DataFrame:
    """Stability of the active sources when each source is left out in turn."""
    total = sum_blocks(blocks, ["event_id"], k)
    cases = total.withColumn("dropped", F.explode(F.array(*[F.lit(i) for i in range(-1, k)])))
    weights = cases.select("event_id", "dropped", solved_weights("gram", "rhs", "dropped").alias("w"))
    base = weights.where(F.col("dropped") == -1).select("event_id", F.col("w").alias("base"))
    both = weights.where(F.col("dropped") >= 0).join(base, "event_id")
    index = F.sequence(F.lit(0), F.lit(k - 1))
    active = F.filter(index, lambda i: (F.col("base")[i] > ACTIVE_ABOVE) & (i != F.col("dropped")))
    again = F.filter(index, lambda i: F.col("w")[i] > ACTIVE_ABOVE)
    base_active = F.filter(index, lambda i: F.col("base")[i] > ACTIVE_ABOVE)
    named = both.withColumn("kept", active).withColumn("found", again).withColumn("base_active", base_active)

    def total_of(column: str, over: str) -> Column:
        return F.aggregate(F.transform(over, lambda i: F.col(column)[i]), F.lit(0.0), lambda a, x: a + x)

    summed = named.withColumn("_sw", total_of("w", "kept")).withColumn("_sb", total_of("base", "base_active"))
    moved = F.exists(
        "kept", lambda i: F.abs(F.col("w")[i] / F.col("_sw") - F.col("base")[i] / F.col("_sb")) > SHIFT_CONCERN * F.col("base")[i] / F.col("_sb")
    )
    out = summed.withColumn("flipped", F.col("kept") != F.col("found")).withColumn("shifted", (F.col("_sw") > 0) & moved)
    result = (
        F.when(F.max(F.size("base_active")) == 0, F.lit(None).cast("string"))
        .when(F.bool_or("flipped"), "FAIL")
        .when(F.bool_or("shifted"), "CONCERN")
        .otherwise("PASS")
    )
    return out.groupBy("event_id").agg(
        F.max(F.size("base_active")).alias("n_active"), F.count_if("flipped").alias("n_flipped"), F.count_if("shifted").alias("n_shifted"), result.alias("result")
    )


def pattern_posterior(samples: DataFrame, k: int, totals: DataFrame | None = None) -> DataFrame:
    """Resampled solutions grouped by active sources: share, mean weights and misfit, all ranked.

    Without `totals` the misfit is null.
    """
    index = F.sequence(F.lit(0), F.lit(k - 1))
    active = F.array_join(F.transform(F.filter(index, lambda i: F.col("weights")[i] > ACTIVE_ABOVE), lambda i: i.cast("string")), ",")
    means = [F.avg(F.col("weights")[i]).alias(f"_w{i}") for i in range(k)]
    sizes = samples.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_all"), *means)
    groups = samples.groupBy("event_id", active.alias("active")).agg(F.count(F.lit(1)).alias("n_iterations"), *means)
    packed = F.array(*[F.col(f"_w{i}") for i in range(k)]).alias("weights")
    shares = groups.join(sizes.select("event_id", "n_all"), "event_id").withColumn("share", F.col("n_iterations") / F.col("n_all"))
    listed = shares.select("event_id", "active", "share", packed)
    if totals is None:
        fitted = listed.withColumn("rmse_cm", F.lit(None).cast("double"))
    else:
        known = listed.join(totals.select("event_id", "gram", "rhs", "dd", "n"), "event_id")
        misfit = quadratic_misfit(F.col("gram"), F.col("rhs"), F.col("dd"), F.col("weights"), k)
        fitted = known.withColumn("rmse_cm", F.sqrt(misfit / F.col("n")) * 100).drop("gram", "rhs", "dd", "n")
    best = Window.partitionBy("event_id").orderBy(F.desc("share"), "rmse_cm", "active")
    return fitted.withColumn("rank", F.row_number().over(best))


def coastal_proxies(weights: DataFrame, factors: DataFrame, tides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(site percentiles and arrivals, largest amplitude per iteration) from long weights x factors.

    `weights` (event_id, iteration, source_id, w) and `factors` (site_id,
    source_id, peak_m, travel_sec) join on the source.
    """
    joined = weights.join(factors, "source_id")
    per = joined.groupBy("event_id", "iteration", "site_id").agg(
        F.sum(F.col("w") * F.col("peak_m")).alias("_a"), F.min(F.when(F.col("w") > ACTIVE_ABOVE, F.col("travel_sec"))).alias("arrival_sec")
    )
    if tides is not None:
        per = per.join(tides, "site_id", "left").withColumn("_a", F.col("_a") * (1 + F.coalesce("correction", F.lit(0.0))))
    amplitude = per.select("event_id", "iteration", "site_id", F.greatest(F.lit(0.0), F.col("_a")).alias("amplitude_m"), "arrival_sec")
    keys = ["event_id", "site_id"]
    shape = exact_percentiles(amplitude, keys, "amplitude_m", {"p10_m": 0.1, "p50_m": 0.5, "p90_m": 0.9})
    arrivals = amplitude.where(F.col("arrival_sec").isNotNull())
    middle = exact_percentiles(arrivals, keys, "arrival_sec", {"arrival_sec": 0.5})
    spread = arrivals.groupBy(*keys).agg(((F.max("arrival_sec") - F.min("arrival_sec")) / 60.0).alias("arrival_spread_min"))
    sites = shape.join(middle, keys, "left").join(spread, keys, "left").na.fill({"arrival_sec": 0.0, "arrival_spread_min": 0.0})
    largest = amplitude.groupBy("event_id", "iteration").agg(F.max("amplitude_m").alias("max_amplitude_m"))
    return sites, largest


def seismic_only_weights(near: DataFrame) -> DataFrame:
    """Slip of each nearby source from magnitude and distance alone (`magnitude`, `km`)."""
    slip = F.pow(F.lit(10.0), 0.5 * F.col("magnitude") - 3.0)
    sigma = F.greatest(F.lit(1.0), F.pow(F.lit(10.0), 0.69 * F.col("magnitude") - 3.22) / 3.0)
    return near.withColumn("weight", slip * F.exp(-F.col("km") * F.col("km") / (2 * sigma * sigma)))


def select_sources(near: DataFrame, sources: DataFrame, limit: int = 15) -> DataFrame:
    """Of each event's nearby sources: consistent strike, the longest run of one fault, nearest `limit`.

    An event has few nearby sources, so all is judged in windows by event: rows dealt by event
    stay where they are. `near` may bring `FAULT` along; otherwise it meets the sources here.
    """
    known = near if set(FAULT) <= set(near.columns) else near.join(sources.select("source_id", *FAULT), "source_id")
    by_event = Window.partitionBy("event_id")
    judged = strike_consensus(known, "event_id", few=True).withColumn("_any", F.bool_or("kept").over(by_event))
    oriented = judged.where(F.col("kept") | ~F.col("_any")).drop("_any", "kept", "mean_strike")
    # A run is a stretch of segments without a gap: segment less place is the same for all of it.
    by_zone = Window.partitionBy("event_id", "zone").orderBy("segment")
    island = oriented.withColumn("_place", F.dense_rank().over(by_zone)).withColumn("_island", F.col("segment") - F.col("_place"))
    run = Window.partitionBy("event_id", "zone", "_island")
    length = F.when(F.col("segment").isNull(), 0).otherwise(F.max("_place").over(run) - F.min("_place").over(run) + 1)
    runs = island.withColumn("_len", length).withColumn("_start", F.min("segment").over(run))
    longest = F.min(F.struct((-F.col("_len")).alias("l"), "zone", "_start", "_island")).over(by_event)
    chosen = runs.withColumn("_b", longest).where((F.col("zone") == F.col("_b.zone")) & (F.col("_island") == F.col("_b._island")))
    nearest = Window.partitionBy("event_id").orderBy("km", "source_id")
    ranked = chosen.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= limit)
    return ranked.drop("_island", "_place", "_len", "_start", "_b")


def carried_faults(sources: DataFrame) -> list[str]:
    """`FAULT` if each source has one row, whose strike survives being carried; else nothing, and a join has to find all rows."""
    odd = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.isnan("strike")).alias("_nan"))
    return [] if odd.where("_n > 1 OR _nan").limit(1).count() else list(FAULT)
