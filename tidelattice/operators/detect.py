"""Window features from the detectors, and their scores.

A window is bounded by its six hours. It becomes one row with two arrays on the JVM
side; Arrow then carries many windows per batch and the kernels run across the
windows of a batch at once. Growing prefixes of a window share one causal pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as score
from ..functions import signals
from ..functions.tides import basis_matrix, fit_robust, fit_robust_on
from ..schemas import T1, T2, T3, WINDOW_HOURS, WINDOW_MIN_SAMPLES
from .partitioned import broadcast_if_small

STATION = ["source_type", "station_id"]
SLICE = 64
ENERGY_FLOOR = 1e-10
# What a record without a quiet series is compared with.
EARLY_SEC, EARLY_MIN_SAMPLES = 1800.0, 10

FEATURES = T.StructType(
    [
        T.StructField("source_type", T.StringType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("window_no", T.LongType()),
        T.StructField("window_end_us", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("step_sec", T.DoubleType()),
        T.StructField("peak_m", T.DoubleType()),
        T.StructField("wavelet_energy", T.DoubleType()),
        T.StructField("bocpd_score", T.DoubleType()),
        T.StructField("energy_5min", T.DoubleType()),
        T.StructField("energy_15min", T.DoubleType()),
        T.StructField("max_step_m", T.DoubleType()),
        T.StructField("early_energy", T.DoubleType()),
        T.StructField("fit_source", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)


def collect_windows(df: DataFrame, value: str = "value_m", hours: int = WINDOW_HOURS) -> DataFrame:
    """One row per (station, window) holding all its samples in time order, one per instant."""
    width = hours * 3_600_000_000
    single = df.groupBy(*STATION, "ts_us").agg(F.min_by(value, "seq").alias("_v"))
    placed = single.withColumn("window_no", F.floor(F.col("ts_us") / width).cast("long"))
    # A fixed number of partitions keeps the costly detector pass on all cores.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, *STATION, "window_no").groupBy(*STATION, "window_no").agg(
        F.array_sort(F.collect_list(F.struct("ts_us", "_v"))).alias("_s"), F.max("ts_us").alias("window_end_us")
    ).select(*STATION, "window_no", "window_end_us", F.col("_s.ts_us").alias("times"), F.col("_s._v").alias("samples"))


def window_features(windows: DataFrame) -> DataFrame:
    """Detector features per window; optional columns `coefficients` and `t0_us` give a separate tide fit."""
    have = set(windows.columns)
    full = windows
    for name, kind in (("coefficients", "array<double>"), ("t0_us", "long")):
        if name not in have:
            full = full.withColumn(name, F.lit(None).cast(kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(_n=[len(v) for v in batch["samples"]]).sort_values("_n")
            for start in range(0, len(batch), SLICE):
                yield _slice_features(batch.iloc[start : start + SLICE])

    return full.select(*STATION, "window_no", "window_end_us", "times", "samples", "coefficients", "t0_us").mapInPandas(run, FEATURES)


def _slice_features(part: pd.DataFrame) -> pd.DataFrame:
    """Features of a few windows of similar length, padded to one width."""
    lengths = part["_n"].to_numpy()
    residuals = np.zeros((len(part), lengths.max()))
    steps, sources, status = np.full(len(part), np.nan), [], []
    for i, row in enumerate(part.itertuples(index=False)):
        values, times = np.asarray(row.samples, dtype=float), np.asarray(row.times, dtype=float)
        separate = row.coefficients is not None
        sources.append("separate calibration series" if separate else "event window")
        if len(values) < WINDOW_MIN_SAMPLES:
            status.append("INSUFFICIENT_DATA")
            continue
        if not np.all(np.isfinite(values)):
            status.append("SCORING_FAILED")
            continue
        hours = (times - (row.t0_us if separate else times[0])) / 3.6e9
        fit = np.asarray(row.coefficients) if separate else fit_robust(hours, values)
        left = values - basis_matrix(hours) @ fit
        residuals[i, : len(left)] = left
        residuals[i, len(left) :] = left[-1]
        steps[i] = np.median(np.diff(times)) / 1e6
        status.append("SCORING_SUCCEEDED")
    good = np.isfinite(steps) & (steps > 0)
    out = part[[*STATION, "window_no", "window_end_us"]].copy()
    out["n_samples"], out["step_sec"], out["fit_source"], out["status"] = lengths, steps, sources, status
    names = ["peak_m", "wavelet_energy", "bocpd_score", "energy_5min", "energy_15min", "max_step_m", "early_energy"]
    found = np.full((len(part), len(names)), np.nan)
    if good.any():
        at = np.flatnonzero(good)
        filtered = signals.bandpass(residuals[at].copy(), 1.0 / steps[at], lengths[at])
        change = signals.change_scores(residuals[at], lengths[at])
        for j, i in enumerate(at):
            y, n, step = filtered[j, : lengths[i]], lengths[i], steps[i]
            tail = [float(np.mean(y[-max(1, int(sec / step)) :] ** 2)) for sec in (300.0, 900.0)]
            jump = float(np.max(np.abs(np.diff(y)))) if n > 1 else 0.0
            early = y[: early_samples(n, step)]
            found[i] = (
                np.max(np.abs(y)), signals.wavelet_energy(y, step), change[j], *tail, jump,
                signals.wavelet_energy(early, step) / max(len(early), 1),
            )
    out[names] = found
    return out[FEATURES.names].astype({"n_samples": "int64"})


def early_samples(n: int, step_sec: float) -> int:
    """The first 30 minutes of a record, at least 10 samples, at most half of it."""
    return min(max(EARLY_MIN_SAMPLES, int(EARLY_SEC / step_sec)), n // 2)


def calibrate_baseline(features: DataFrame, quiet_until_us: int) -> DataFrame:
    """Quiet-time wavelet energy per sample of each buoy.

    It is the mean over all windows that end before `quiet_until_us`; a buoy without
    such a window uses the first 30 minutes of its first one. Gauges have no quiet
    series and no baseline.
    """
    good = features.where((F.col("status") == "SCORING_SUCCEEDED") & (F.col("source_type") == "dart"))
    quiet = F.col("window_end_us") < quiet_until_us
    mean = F.sum(F.when(quiet, F.col("wavelet_energy"))) / F.sum(F.when(quiet, F.col("n_samples")))
    first = F.min_by("early_energy", "window_no")
    return good.groupBy(*STATION).agg(F.coalesce(mean, first).alias("quiet_energy"))


PREFIXES = T.StructType(
    [
        *[f for f in FEATURES.fields if f.name in (*STATION, "window_no", "window_end_us")],
        T.StructField("prefix", T.LongType()),
        T.StructField("minutes", T.DoubleType()),
        *[f for f in FEATURES.fields if f.name in ("n_samples", "step_sec", "peak_m", "wavelet_energy", "bocpd_score", "fit_source", "status")],
    ]
)


def prefix_features(windows: DataFrame, step_min: int = 5, max_min: int = 360) -> DataFrame:
    """Detector features of every growing prefix of a window, one row each.

    Prefix k ends after k steps of `step_min` minutes of samples, before the window's
    last sample; `window_end_us` is its newest sample. With a separate tide fit
    (columns `coefficients`, `t0_us`) the filter, the run lengths of the change-point
    detector and the peak are read off one causal pass over the window. Without one
    each prefix has its own robust fit and the prefixes are filtered together; a few
    hours cannot tell the constituents apart, so that system is solved anew each time
    (an updated factor gives other residuals).
    """
    full = windows
    for name, kind in (("coefficients", "array<double>"), ("t0_us", "long")):
        if name not in set(windows.columns):
            full = full.withColumn(name, F.lit(None).cast(kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                part = _window_prefixes(row, step_min, max_min)
                if len(part):
                    yield part

    return full.select(*STATION, "window_no", "times", "samples", "coefficients", "t0_us").mapInPandas(run, PREFIXES)


def _window_prefixes(row, step_min: int, max_min: int) -> pd.DataFrame:
    values, times = np.asarray(row.samples, dtype=float), np.asarray(row.times, dtype=float)
    step = float(np.median(np.diff(times)) / 1e6) if len(times) > 1 else np.nan
    if not step > 0:
        return pd.DataFrame(columns=PREFIXES.names)
    size = max(1, int(step_min * 60 / step))
    ends = np.arange(size, len(values), size)
    ends = ends[(times[ends - 1] - times[0]) / 6e7 <= max_min]
    separate = row.coefficients is not None
    out = pd.DataFrame({"prefix": ends // size, "minutes": (times[ends - 1] - times[0]) / 6e7, "n_samples": ends, "window_end_us": times[ends - 1].astype("int64")})
    found = np.full((len(ends), 3), np.nan)
    enough = (ends >= WINDOW_MIN_SAMPLES) & np.array([np.all(np.isfinite(values[:e])) for e in ends], bool)
    at = np.flatnonzero(enough)
    if len(at):
        longest = ends[at[-1]]
        if separate:
            hours = (times[:longest] - row.t0_us) / 3.6e9
            left = (values[:longest] - basis_matrix(hours) @ np.asarray(row.coefficients))[None, :]
            filtered = signals.bandpass(left.copy(), np.array([1.0 / step]), np.array([longest]))[0]
            surprise = signals.change_surprise(left, np.array([longest]))[0]
            parts = [(signals.settled(filtered[:e]), signals.change_score(surprise[:e])) for e in ends[at]]
        else:
            hours = (times[:longest] - times[0]) / 3.6e9
            left = np.zeros((len(at), longest))
            basis = basis_matrix(hours)
            for i, e in enumerate(ends[at]):
                left[i, :e] = values[:e] - basis[:e] @ fit_robust_on(basis[:e], values[:e])
                left[i, e:] = left[i, e - 1]
            filtered = signals.bandpass(left.copy(), np.full(len(at), 1.0 / step), ends[at])
            parts = [(f[:e], s) for f, s, e in zip(filtered, signals.change_scores(left, ends[at]), ends[at])]
        found[at] = [(np.max(np.abs(y)), signals.wavelet_energy(y, step), s) for y, s in parts]
    out[["peak_m", "wavelet_energy", "bocpd_score"]] = found
    finite = np.array([np.all(np.isfinite(values[:e])) for e in ends], bool)
    out["status"] = np.where(enough, "SCORING_SUCCEEDED", np.where(finite, "INSUFFICIENT_DATA", "SCORING_FAILED"))
    out["step_sec"], out["fit_source"] = step, "separate calibration series" if separate else "event window"
    for name in (*STATION, "window_no"):
        out[name] = getattr(row, name)
    return out[PREFIXES.names]


def with_first_crossings(scores: DataFrame) -> DataFrame:
    """Add the minutes at which each window's growing score first reached each threshold; a window has few prefixes."""
    window = Window.partitionBy(*STATION, "window_no")
    reached = {f"t{i}_min": F.min(F.when(F.col("ensemble_score") >= t, F.col("minutes"))).over(window) for i, t in enumerate((T1, T2, T3), 1)}
    return scores.withColumns(reached)


def score_features(features: DataFrame, baselines: DataFrame, quiet: Column, ml: Column | None = None) -> DataFrame:
    """All score components of each window; failed windows stay as rows with null scores."""
    out = features.join(broadcast_if_small(baselines), STATION, "left")
    ok = F.col("status") == "SCORING_SUCCEEDED"
    # The energy is a sum over samples: the baseline is that of a quiet window of the same length.
    expected = F.greatest(F.lit(ENERGY_FLOOR), F.col("quiet_energy") * F.col("n_samples"))
    out = out.withColumn("baseline_energy", F.when(F.col("quiet_energy").isNotNull(), expected))
    parts = (
        out.withColumn("quiet", quiet)
        .withColumn(
            "threshold_score",
            F.when(ok, score.threshold_score(F.col("peak_m"), score.detect_threshold_m(F.col("source_type")), F.col("quiet"))),
        )
        .withColumn("wavelet_score", F.when(ok, F.coalesce(score.wavelet_score(F.col("wavelet_energy"), F.col("baseline_energy")), F.lit(0.0))))
        .withColumn("statistical_score", F.when(ok, score.statistical_score(F.col("wavelet_score"), F.col("bocpd_score"))))
        .withColumn("ml_score", F.lit(None).cast("double") if ml is None else ml)
    )
    combined = score.ensemble_score(F.col("threshold_score"), F.col("statistical_score"), F.col("ml_score"))
    return parts.withColumn("ensemble_score", F.when(ok, combined)).withColumn(
        "filter_degraded", F.col("step_sec") >= 150.0
    ).withColumn("tier", F.when(ok, score.reached_tier(F.col("ensemble_score"))))


def fit_forest(features: DataFrame, columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation trees, one row each: nodes as arrays, grown from a seeded sample per tree.

    Every row draws a hash-based rank per tree and only the first `sample` of a
    tree are kept, so the draw does not depend on partitioning and a tree's rows
    are bounded.
    """
    keyed = features.withColumn("_row", F.xxhash64(*[F.col(c) for c in [*STATION, "window_no"]]))
    # Keep a few times the wanted rows by hash first, then cut exactly by rank. Which trees
    # draw a row is decided on the row, so only drawn copies leave the scan.
    odds = min(1.0, 4.0 * sample / max(features.count(), 1))
    rank = lambda tree: F.pmod(F.xxhash64("_row", tree, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    numbers = F.array(*[F.lit(t) for t in range(trees)])
    near = keyed.withColumn("tree", F.explode(F.filter(numbers, lambda t: rank(t) < odds))).withColumn("_rank", rank(F.col("tree")))
    by_tree = Window.partitionBy("tree").orderBy("_rank", "_row")
    rows = near.withColumn("_place", F.row_number().over(by_tree)).where(F.col("_place") <= sample)
    names = list(columns)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        data = part.sort_values("_place")[names].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(data), 2))))
        nodes: list[list[float]] = []

        def split(block: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1.0, 0.0, -1.0, -1.0, float(len(block)), float(depth)])
            low, high = block.min(axis=0), block.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(block) > 1 and len(open_):
                column = int(rng.choice(open_))
                cut = float(rng.uniform(low[column], high[column]))
                left = block[:, column] <= cut
                nodes[at][:4] = [float(column), cut, float(split(block[left], depth + 1)), float(split(block[~left], depth + 1))]
            return at

        split(data, 0)
        return pd.DataFrame({"tree": [tree], "n_rows": [len(data)], "nodes": [np.asarray(nodes).ravel().tolist()]})

    return rows.groupBy("tree").applyInPandas(grow, "tree int, n_rows long, nodes array<double>")


def _unsuccessful_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def score_forest(features: DataFrame, forest: DataFrame, columns: Sequence[str], contamination: float = 0.01) -> DataFrame:
    """Add `ml_score` from trees held as one bounded broadcast (100 trees of at most 511 nodes)."""
    trees = [(int(r["n_rows"]), np.asarray(r["nodes"]).reshape(-1, 6)) for r in forest.orderBy("tree").collect()]

    def path(x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for _, nodes in trees:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = nodes[at, 0] >= 0
                if not inner.any():
                    break
                i = np.flatnonzero(inner)
                node = nodes[at[i]]
                goes_left = x[i, node[:, 0].astype(int)] <= node[:, 1]
                at[i] = np.where(goes_left, node[:, 2], node[:, 3]).astype(int)
            depth += nodes[at, 5] + _unsuccessful_path(nodes[at, 4])
        return depth / len(trees)

    if not trees:
        return features.withColumn("ml_score", F.lit(None).cast("double"))
    scale = float(_unsuccessful_path(np.array([trees[0][0]]))[0])

    @F.pandas_udf("double")
    def isolation(*cols: pd.Series) -> pd.Series:
        return pd.Series(-np.power(2.0, -path(np.column_stack([c.to_numpy(dtype=float) for c in cols])) / scale))

    raw = features.withColumn("_raw", isolation(*[F.col(c) for c in columns]))
    offset = raw.agg(F.percentile("_raw", contamination)).scalar()
    return raw.withColumn("ml_score", score.forest_score_map(F.col("_raw") - offset)).drop("_raw")
