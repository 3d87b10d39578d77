"""Detector score maps and alert tiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DETECT_THRESHOLD_M, QUIET_FACTOR, T1, T2, T3, WEIGHT_ML, WEIGHT_STATISTICAL, WEIGHT_THRESHOLD


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def detect_threshold_m(source_type: Column) -> Column:
    return F.when(source_type == "dart", DETECT_THRESHOLD_M["dart"]).otherwise(DETECT_THRESHOLD_M["coops"])


def threshold_score(peak: Column, threshold_m: Column, quiet: Column) -> Column:
    """0 up to the threshold, 1 from twice the threshold on, linear between."""
    ratio = peak / (threshold_m * F.when(quiet, QUIET_FACTOR).otherwise(1.0))
    return F.when(ratio <= 1.0, 0.0).otherwise(F.least(F.lit(1.0), ratio - 1.0))


def wavelet_score(energy: Column, baseline: Column) -> Column:
    """1 - baseline/energy where the energy exceeds a positive baseline, else 0."""
    return F.when((F.coalesce(baseline, F.lit(0.0)) <= 0) | (energy <= baseline), 0.0).otherwise(1.0 - baseline / energy)


def statistical_score(wavelet: Column, change: Column) -> Column:
    return F.greatest(wavelet, change)


def ensemble_score(
    threshold: Column,
    statistical: Column,
    ml: Column,
    weights: tuple[Column, Column, Column] | None = None,
) -> Column:
    """Weighted mean of the detectors; without the third one the other two are renormalised."""
    w_t, w_s, w_m = weights or (F.lit(WEIGHT_THRESHOLD), F.lit(WEIGHT_STATISTICAL), F.lit(WEIGHT_ML))
    two = F.when(w_t + w_s > 0, (w_t * threshold + w_s * statistical) / (w_t + w_s)).otherwise(0.0)
    return clip01(F.when(ml.isNull(), two).otherwise(w_t * threshold + w_s * statistical + w_m * ml))


def forest_score_map(raw: Column) -> Column:
    return 1.0 / (1.0 + F.exp(raw * 5.0))


def reached_tier(score: Column) -> Column:
    return F.when(score >= T3, "ESCALATE").when(score >= T2, "ASSESS").when(score >= T1, "INVESTIGATE").otherwise("MONITOR")


def reached_threshold(score: Column) -> Column:
    return F.when(score >= T3, "T3").when(score >= T2, "T2").when(score >= T1, "T1")
