"""Tide, detector and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as score
from ..functions.tides import SPEEDS, amplitude, drift_basis, predict_tide, tide_basis
from ..operators import detect as D
from ..operators import joins as J
from ..operators import series as S
from ..operators import tide as T
from ..session import cut_lineage
from . import Catalog
from .adapters import EPOCH_2024_US, OBS, SCORES, observations, quakes, registry, scores, series, with_cte

C = Catalog()
STATION = ["source_type", "station_id"]
CAL_END_US = EPOCH_2024_US + 10 * 86_400_000_000
FIXED_FIT = [0.5] + [0.01 * (i + 1) for i in range(16)]

HOURS = OBS + f""",
hours AS (SELECT *, (ts_us - {EPOCH_2024_US}) / 3600000000.0::DOUBLE AS h FROM obs)"""
BASIS_SQL = ["1.0::DOUBLE"] + [
    f"{fn}(h * {speed!r}::DOUBLE)" for speed in SPEEDS for fn in ("cos", "sin")
]


def with_hours(df):
    return df.withColumn("hours", (F.col("ts_us") - EPOCH_2024_US) / F.lit(3_600_000_000.0))


@C.add(
    "tide_basis",
    with_cte(HOURS, body="SELECT seq, " + ", ".join(f"round({b}, 6) AS b{i}" for i, b in enumerate(BASIS_SQL)) + " FROM hours"),
)
def tide_basis_query(spark, sf_dir):
    rows = with_hours(observations(spark, sf_dir))
    return rows.select("seq", *[F.round(b, 6).alias(f"b{i}") for i, b in enumerate(tide_basis(F.col("hours")))])


@C.add(
    "predict_tide",
    with_cte(HOURS, body="SELECT seq, round(" + " + ".join(f"{c!r}::DOUBLE * {b}" for c, b in zip(FIXED_FIT, BASIS_SQL)) + ", 6) AS tide FROM hours"),
)
def predict_tide_query(spark, sf_dir):
    fit = F.array(*[F.lit(c) for c in FIXED_FIT])
    return with_hours(observations(spark, sf_dir)).select("seq", F.round(predict_tide(F.col("hours"), fit), 6).alias("tide"))


_MOMENTS = [f"sum({BASIS_SQL[i]} * {BASIS_SQL[j]})" for i in range(17) for j in range(i, 17)] + [
    f"sum({b} * value_m)" for b in BASIS_SQL
]


@C.add(
    "tide_moments",
    with_cte(HOURS, body=f"""SELECT source_type, station_id, k, round(m, 4) + 0.0 AS m FROM (
  SELECT source_type, station_id, unnest(range({len(_MOMENTS)})) AS k, unnest([{', '.join(_MOMENTS)}]) AS m FROM hours GROUP BY 1, 2)"""),
)
def tide_moments(spark, sf_dir):
    rows = with_hours(observations(spark, sf_dir))
    sums = T.tide_moments(rows, STATION, "value_m")
    long = sums.select(*STATION, F.posexplode(F.concat("gram", "rhs")).alias("k", "m"))
    return long.select(*STATION, F.col("k").cast("long").alias("k"), (F.round("m", 4) + 0.0).alias("m"))


DRIFT_SQL = HOURS + """,
frames AS (SELECT source_type, station_id, avg(h) AS t_mean, max(h) - min(h) AS t_range FROM hours GROUP BY 1, 2),
scaled AS (SELECT hours.*, (h - t_mean) / CASE WHEN t_range < 1e-6 THEN 1 ELSE t_range END AS u FROM hours JOIN frames USING (source_type, station_id))"""
_WIDE = [*BASIS_SQL, "u", "u * u"]
_DRIFT_MOMENTS = [f"sum({_WIDE[i]} * {_WIDE[j]})" for i in range(19) for j in range(i, 19)] + [f"sum({b} * value_m)" for b in _WIDE]


def framed(spark, sf_dir):
    rows = with_hours(observations(spark, sf_dir))
    return rows.join(J.broadcast_if_small(T.fit_clock(rows, STATION)), STATION)


@C.add("drift_basis", with_cte(DRIFT_SQL, body="SELECT seq, round(u, 6) AS linear, round(u * u, 6) AS quadratic FROM scaled"))
def drift_basis_query(spark, sf_dir):
    linear, quadratic = drift_basis(F.col("hours"), F.col("t_mean"), F.col("t_range"))
    return framed(spark, sf_dir).select("seq", F.round(linear, 6).alias("linear"), F.round(quadratic, 6).alias("quadratic"))


@C.add(
    "drift_moments",
    with_cte(DRIFT_SQL, body=f"""SELECT source_type, station_id, k, round(m, 4) + 0.0 AS m FROM (
  SELECT source_type, station_id, unnest(range({len(_DRIFT_MOMENTS)})) AS k, unnest([{', '.join(_DRIFT_MOMENTS)}]) AS m FROM scaled GROUP BY 1, 2)"""),
)
def drift_moments(spark, sf_dir):
    """Sums of products of the 19 columns of tide and drift."""
    sums = T.tide_moments(framed(spark, sf_dir), STATION, "value_m", drift=True)
    long = sums.select(*STATION, F.posexplode(F.concat("gram", "rhs")).alias("k", "m"))
    return long.select(*STATION, F.col("k").cast("long").alias("k"), (F.round("m", 4) + 0.0).alias("m"))


@C.add("fit_tide_drift")
def fit_tide_drift(spark, sf_dir):
    """Tide and drift fitted together, robustly, on readings whose slope was not taken out before."""
    fits = T.fit_tide_robust(with_hours(calibration(spark, sf_dir)), STATION, "value", drift=True)
    return fits.select(*STATION, "n_fit", "t_mean", "t_range", F.posexplode("coefficients").alias("k", "coefficient"))


@C.add("detide_drift")
def detide_drift(spark, sf_dir):
    """Calibration readings less the tide and drift fitted to them."""
    rows = cut_lineage(with_hours(calibration(spark, sf_dir)))
    fits = T.fit_tide_robust(rows, STATION, "value", drift=True)
    return T.detide(rows, fits, STATION, "value").select(*STATION, "ts_us", "predicted", "residual")


@C.add("fit_tide")
def fit_tide(spark, sf_dir):
    rows = with_hours(observations(spark, sf_dir))
    return T.fit_tide(rows, STATION, "value_m").select(*STATION, "n_fit", F.posexplode("coefficients").alias("k", "coefficient"))


def calibration(spark, sf_dir):
    """Standard-cadence buoy readings before the scored period."""
    rows = observations(spark, sf_dir).where((F.col("ts_us") < CAL_END_US) & (F.col("measurement_type") == 1))
    return rows.groupBy(*STATION, "ts_us").agg(F.min_by("value_m", "seq").alias("value"))


def calibration_fits(spark, sf_dir):
    clean = cut_lineage(S.clean_calibration(calibration(spark, sf_dir), STATION))
    fits = T.fit_tide_robust(clean, STATION, "clean")
    start = clean.groupBy(*STATION).agg(F.min("ts_us").alias("t0_us"))
    return fits.join(start, STATION)


@C.add("fit_tide_robust")
def fit_tide_robust(spark, sf_dir):
    return calibration_fits(spark, sf_dir).select(*STATION, "n_fit", "t0_us", F.posexplode("coefficients").alias("k", "coefficient"))


@C.add("detide")
def detide(spark, sf_dir):
    fits = cut_lineage(calibration_fits(spark, sf_dir))
    rows = observations(spark, sf_dir).where(F.col("source_type") == "dart")
    clock = rows.join(J.broadcast_if_small(fits.select(*STATION, "t0_us")), STATION).withColumn(
        "hours", (F.col("ts_us") - F.col("t0_us")) / F.lit(3_600_000_000.0)
    )
    return T.detide(clock, fits, STATION, "value_m").select("seq", *STATION, "predicted", "residual")


@C.add(
    "align_calibration",
    with_cte(OBS, body=f"""SELECT seq, round((ts_us - t0) / 3600000000.0::DOUBLE, 6) AS hours, t0 IS NOT NULL AS calibrated FROM obs
LEFT JOIN (SELECT source_type, station_id, min(ts_us) AS t0 FROM obs WHERE ts_us < {CAL_END_US} AND measurement_type = 1 GROUP BY 1, 2)
USING (source_type, station_id)"""),
)
def align_calibration(spark, sf_dir):
    out = T.on_calibration_clock(observations(spark, sf_dir), calibration(spark, sf_dir), STATION)
    return out.select("seq", F.round("hours", 6).alias("hours"), "calibrated")


@C.add("holdout_detide_report")
def holdout_detide_report(spark, sf_dir):
    rows = with_hours(calibration(spark, sf_dir))
    numbered = cut_lineage(S.number_series(rows, STATION, total="n"))
    return T.holdout_report(numbered, STATION, "value")


@C.add("tide_amplitudes")
def tide_amplitudes(spark, sf_dir):
    fits = T.fit_tide(with_hours(observations(spark, sf_dir)), STATION, "value_m")
    return fits.select(*STATION, *[amplitude(F.col("coefficients"), n).alias(n) for n in ("M2", "S2", "K1", "O1")])


@C.add("robust_baseline")
def robust_baseline(spark, sf_dir):
    one = S.dedup_series(series(spark, sf_dir), ["station_id"], "first")
    return T.drift_baseline(S.number_series(one, ["station_id"], total="n"), ["station_id"], "value")


def features(spark, sf_dir):
    """Window features; buoys use their calibration fit, gauges their own window."""
    windows = D.collect_windows(observations(spark, sf_dir))
    fits = cut_lineage(calibration_fits(spark, sf_dir)).select(*STATION, "coefficients", "t0_us")
    return D.window_features(windows.join(J.broadcast_if_small(fits), STATION, "left"))


@C.add("bandpass")
def bandpass(spark, sf_dir):
    return D.window_features(D.collect_windows(observations(spark, sf_dir))).select(*STATION, "window_no", "n_samples", "step_sec", "peak_m", "status")


@C.add("wavelet_energy")
def wavelet_energy(spark, sf_dir):
    return D.window_features(D.collect_windows(observations(spark, sf_dir))).select(*STATION, "window_no", "n_samples", "wavelet_energy")


@C.add("bocpd_score")
def bocpd_score(spark, sf_dir):
    return D.window_features(D.collect_windows(observations(spark, sf_dir))).select(*STATION, "window_no", "n_samples", "bocpd_score")


@C.add("calibrate_baseline")
def calibrate_baseline(spark, sf_dir):
    return D.calibrate_baseline(features(spark, sf_dir), CAL_END_US)


@C.add("score_windows")
def score_windows(spark, sf_dir):
    """Every window scored, with fit provenance and the surface-wave flag where it can be judged."""
    found = cut_lineage(features(spark, sf_dir), once=True)
    quake = quakes(spark, sf_dir)
    timed = J.with_quiet(found.withColumn("ts_us", F.col("window_end_us")), quake)
    scored = D.score_features(timed, D.calibrate_baseline(found, CAL_END_US), F.col("quiet"))
    placed = J.with_coordinates(scored, registry(spark, sf_dir)).withColumn("_key", F.concat_ws(":", *STATION, "window_no"))
    firing = placed.where((F.col("ensemble_score") > 0) & F.col("lat").isNotNull())
    hits = J.rayleigh_suspects(firing, quake, "_key").withColumn("_hit", F.lit(True))
    judged = (F.col("ensemble_score") > 0) & F.col("lat").isNotNull()
    return placed.join(hits, "_key", "left").withColumn(
        "rayleigh_suspect", F.when(judged, F.coalesce("_hit", F.lit(False)))
    ).select(
        *STATION, "window_no", "n_samples", "status", "fit_source", "quiet", "filter_degraded", "threshold_score", "wavelet_score",
        "bocpd_score", "statistical_score", "ensemble_score", "tier", "rayleigh_suspect",
    )


@C.add("score_prefixes")
def score_prefixes(spark, sf_dir):
    """The score of every growing prefix of each window, and when it first reached each threshold.

    A prefix is judged by the earthquakes known at its newest sample.
    """
    windows = D.collect_windows(observations(spark, sf_dir))
    fits = cut_lineage(calibration_fits(spark, sf_dir)).select(*STATION, "coefficients", "t0_us")
    fitted = windows.join(J.broadcast_if_small(fits), STATION, "left")
    found = cut_lineage(D.prefix_features(fitted).withColumn("ts_us", F.col("window_end_us")), once=True)
    quake = quakes(spark, sf_dir)
    # Only buoys have a baseline; held, as the join counts it before it is sent out.
    baselines = cut_lineage(D.calibrate_baseline(D.window_features(fitted.where(F.col("source_type") == "dart")), CAL_END_US))
    scored = D.score_features(J.with_quiet_then(found, quake), baselines, F.col("quiet"))
    return D.with_first_crossings(scored).select(
        *STATION, "window_no", "prefix", F.round("minutes", 1).alias("minutes"), "n_samples", "status", "quiet",
        "threshold_score", "wavelet_score", "bocpd_score", "ensemble_score", "tier", "t1_min", "t2_min", "t3_min",
    )


FOREST = ["energy_5min", "energy_15min", "max_step_m", "spatial"]


@C.add("forest_features")
def forest_features(spark, sf_dir):
    found = D.window_features(D.collect_windows(observations(spark, sf_dir)))
    return found.where(F.col("status") == "SCORING_SUCCEEDED").select(
        *STATION, "window_no", "energy_5min", "energy_15min", "max_step_m", F.lit(0.0).alias("spatial")
    )


@C.add("forest_scores")
def forest_scores(spark, sf_dir):
    rows = cut_lineage(forest_features(spark, sf_dir), once=True)
    return D.score_forest(rows, D.fit_forest(rows, FOREST), FOREST).select(*STATION, "window_no", "ml_score")


@C.add(
    "threshold_score",
    with_cte(OBS, body="""SELECT source_type, station_id, day, round(CASE WHEN r <= 1 THEN 0 ELSE least(1.0::DOUBLE, r - 1) END, 6) AS score FROM (
  SELECT *, peak / (CASE WHEN source_type = 'dart' THEN 3.0::DOUBLE ELSE 3.5::DOUBLE END * CASE WHEN day % 2 = 0 THEN 1.3::DOUBLE ELSE 1 END) AS r FROM (
    SELECT source_type, station_id, ts_us // 86400000000 AS day, max(abs(value_m)) AS peak FROM obs GROUP BY 1, 2, 3))"""),
)
def threshold_score(spark, sf_dir):
    peaks = observations(spark, sf_dir).groupBy(*STATION, F.expr("ts_us div 86400000000").alias("day")).agg(
        F.max(F.abs("value_m")).alias("peak")
    )
    level = F.when(F.col("source_type") == "dart", 3.0).otherwise(3.5)
    return peaks.select(*STATION, "day", F.round(score.threshold_score(F.col("peak"), level, F.col("day") % 2 == 0), 6).alias("score"))


ENSEMBLE_SQL = """ens AS (
  SELECT *, greatest(wavelet_score, bocpd_score) AS stat,
    CASE WHEN ml_score IS NULL THEN (0.5::DOUBLE * threshold_score + 0.35::DOUBLE * greatest(wavelet_score, bocpd_score)) / (0.5::DOUBLE + 0.35::DOUBLE)
      ELSE 0.5::DOUBLE * threshold_score + 0.35::DOUBLE * greatest(wavelet_score, bocpd_score) + 0.15::DOUBLE * ml_score END AS ensemble
  FROM scores)"""


@C.add(
    "ensemble_score",
    with_cte(SCORES, ENSEMBLE_SQL, body="""SELECT window_id, stat AS statistical, round(ensemble, 6) AS ensemble,
  round(1 / (1 + exp(5 * (threshold_score - 0.5))), 6) AS forest_map,
  CASE WHEN score >= 0.85 THEN 'ESCALATE' WHEN score >= 0.60 THEN 'ASSESS' WHEN score >= 0.35 THEN 'INVESTIGATE' ELSE 'MONITOR' END AS tier,
  CASE WHEN score >= 0.85 THEN 'T3' WHEN score >= 0.60 THEN 'T2' WHEN score >= 0.35 THEN 'T1' END AS threshold FROM ens"""),
)
def ensemble_score(spark, sf_dir):
    s = F.col("score")
    stat = score.statistical_score(F.col("wavelet_score"), F.col("bocpd_score"))
    return scores(spark, sf_dir).select(
        "window_id",
        stat.alias("statistical"),
        F.round(score.ensemble_score(F.col("threshold_score"), stat, F.col("ml_score")), 6).alias("ensemble"),
        F.round(score.forest_score_map(F.col("threshold_score") - 0.5), 6).alias("forest_map"),
        score.reached_tier(s).alias("tier"),
        score.reached_threshold(s).alias("threshold"),
    )


@C.add(
    "wavelet_score",
    with_cte(SCORES, body="""SELECT window_id, CASE WHEN bocpd_score <= 0 OR wavelet_score <= bocpd_score THEN 0.0
  ELSE round(1 - bocpd_score / wavelet_score, 6) END AS score FROM scores"""),
)
def wavelet_score(spark, sf_dir):
    return scores(spark, sf_dir).select(
        "window_id", F.round(score.wavelet_score(F.col("wavelet_score"), F.col("bocpd_score")), 6).alias("score")
    )
