"""Evaluation and operations reports over scored windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ensemble_score, statistical_score
from ..schemas import T1, T2, T3
from .partitioned import exact_percentiles, with_next

TIERS = (("t1", T1), ("t2", T2), ("t3", T3))
DAYS_PER_MONTH = 30.0


def false_trigger_report(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per station: windows, triggers per tier, monthly rates and the score distribution."""
    basic = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        *[F.count_if(F.col("score") >= level).alias(f"triggers_{name}") for name, level in TIERS],
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(86_400_000_000.0 * DAYS_PER_MONTH)).alias("_months"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
    )
    shape = exact_percentiles(scores, keys, "score", {"p95_score": 0.95, "p99_score": 0.99})
    out = basic.join(shape, list(keys))
    for name in ("t1", "t2"):
        rate = F.when(F.col("_months") > 0, F.col(f"triggers_{name}") / F.col("_months")).otherwise(0.0)
        out = out.withColumn(f"{name}_per_month", rate)
    return out.drop("_months")


def false_trigger_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("n_windows").alias("n_windows"),
        *[F.sum(f"triggers_{name}").alias(f"triggers_{name}") for name, _ in TIERS],
        F.max("max_score").alias("max_score"),
    )


# Weight configurations compared (threshold, statistical, third detector).
WEIGHTS = {
    "full_ensemble": (0.50, 0.35, 0.15),
    "threshold_only": (1.0, 0.0, 0.0),
    "statistical_only": (0.0, 1.0, 0.0),
    "threshold_statistical": (0.588, 0.412, 0.0),
    "equal_weights": (1.0, 1.0, 1.0),
}


def first_times(score: Column, minutes: Column) -> list[Column]:
    """First minute at or after the origin with the score at each tier."""
    return [F.min(F.when((minutes >= 0) & (score >= level), minutes)).alias(f"first_{name}_min") for name, level in TIERS]


def ablation(scores: DataFrame, weights: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Recomputed ensemble per weight configuration; the list rides on each row, no join."""
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("config"), *[F.lit(float(v)).alias(k) for k, v in zip("abc", w)])
            for name, w in (weights or WEIGHTS).items()
        ]
    )
    each = scores.withColumn("_w", F.explode(listed))
    stat = statistical_score(F.col("wavelet_score"), F.col("bocpd_score"))
    again = ensemble_score(F.col("threshold_score"), stat, F.col("ml_score"), tuple(F.col(f"_w.{k}") for k in "abc"))
    rescored = each.select(F.col("_w.config").alias("config"), "station_id", "minutes", again.alias("_e"))
    return rescored.groupBy("config", "station_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        *[F.count_if(F.col("_e") >= level).alias(f"crosses_{name}") for name, level in TIERS],
        *first_times(F.col("_e"), F.col("minutes")),
    )


def threshold_sweep(scores: DataFrame, levels: Sequence[float]) -> DataFrame:
    """For each level: stations crossing it, and the earliest and latest first crossing."""
    each = scores.withColumn("t1", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    per_station = each.groupBy("t1", "station_id").agg(
        F.max("score").alias("_top"), F.min(F.when((F.col("minutes") >= 0) & (F.col("score") >= F.col("t1")), F.col("minutes"))).alias("_first")
    )
    return per_station.groupBy("t1").agg(
        F.count_if(F.col("_top") >= F.col("t1")).alias("stations_crossing"),
        F.min("_first").alias("earliest_min"),
        F.max("_first").alias("latest_min"),
    )


def first_crossing(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(*first_times(F.col("score"), F.col("minutes")))


def sensitivity_grid(runs: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Amplitude by period table of the highest tier reached."""
    ladder = F.when(F.col("score") >= T3, 3).when(F.col("score") >= T2, 2).when(F.col("score") >= T1, 1).otherwise(0)
    wide = runs.withColumn("_l", ladder).groupBy("amplitude").pivot("period", list(periods)).agg(F.max("_l"))
    names = F.array(*[F.lit(n) for n in ("MONITOR", "INVESTIGATE", "ASSESS", "ESCALATE")])
    return wide.select("amplitude", *[names[F.col(str(p))].alias(f"p{p}") for p in periods])


def least_detectable(runs: DataFrame) -> DataFrame:
    cells = runs.groupBy("period", "amplitude").agg(F.max("score").alias("_top"))
    return cells.groupBy("period").agg(F.min(F.when(F.col("_top") >= T1, F.col("amplitude"))).alias("least_amplitude"))


def detection_rates(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_runs"), *[F.avg((F.col("score") >= level).cast("double")).alias(f"rate_{name}") for name, level in TIERS]
    )


def duplicate_sensitivity(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest score change against the `first` policy per station, and whether the tier flips."""
    base = F.max(F.when(F.col("policy") == "first", F.col("score")))
    out = scored.groupBy(*keys).agg(
        base.alias("base_score"),
        F.max("score").alias("_hi"),
        F.min("score").alias("_lo"),
        F.countDistinct("tier").alias("_tiers"),
    )
    delta = F.greatest(F.col("_hi") - F.col("base_score"), F.col("base_score") - F.col("_lo"))
    return out.withColumn("max_abs_delta", delta).withColumn("tier_flip", F.col("_tiers") > 1).drop("_hi", "_lo", "_tiers")


def windowed_counts(events: DataFrame, label: str, ts: str) -> DataFrame:
    """Counts per label over 5 min, 1 h and 24 h; the wider ones fold the 5-minute counts."""
    fine = events.groupBy(F.window(ts, "5 minutes").alias("w"), label).agg(F.count(F.lit(1)).alias("n"))
    flat = fine.select(F.unix_micros(F.col("w.start")).alias("start_us"), label, "n")
    spans = F.array(*[F.struct(F.lit(name).alias("span"), F.lit(us).alias("width")) for name, us in (("5m", 300_000_000), ("1h", 3_600_000_000), ("24h", 86_400_000_000))])
    spread = flat.withColumn("_s", F.explode(spans))
    start = F.col("start_us") - F.pmod(F.col("start_us"), F.col("_s.width"))
    return spread.groupBy(F.col("_s.span").alias("span"), start.alias("start_us"), label).agg(F.sum("n").alias("n"))


def dwell_times(transitions: DataFrame, keys: Sequence[str], bucket_seconds: int = 86_400) -> DataFrame:
    """Time in each state: the next transition less this one; null while the state is open."""
    out = with_next(transitions, keys, ["ts_us"], bucket_seconds, tie="step")
    return out.withColumn("dwell_sec", (F.col("next")["ts_us"] - F.col("ts_us")) / F.lit(1_000_000.0)).drop("next")
